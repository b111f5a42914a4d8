"""Quality rules by repetition coverage (operator 10).

A document's words are hashed once; rolling hashes of several n-gram lengths, made in numpy from prefix sums, find the
n-grams that occur twice or more in the document. The characters inside such n-grams, and inside repeated lines, are
measured against all its word characters. The measures are those of Rae et al., "Scaling Language Models: Methods,
Analysis & Insights from Training Gopher" (2021), table A1; the thresholds are looser than the published ones (15 to
10 percent for 5- to 10-grams), which reject short clean texts that repeat a single line.

Defined results: a null text has no words, so it fails the base rule (fewer than ``MIN_WORDS`` words), as an empty one
does. Null ids, repeated rows and ties need no care, as each row is judged alone. Only ``doc_id`` and ``text`` are
read, so further columns can't clash. A text of any length is judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidelake.llm.common import byte_texts, sliced, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: n-gram length: percent of word characters that may lie in duplicated n-grams.
NGRAM_PERCENT = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
#: Percent of lines that may repeat an earlier one, and of their characters.
LINE_PERCENT, LINE_CHAR_PERCENT = 40, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_chars long, dup_line_chars long"
    + "".join(f", dup_chars_{n} long" for n in NGRAM_PERCENT)
)

SYMBOLS, SPACES, CONTINUED = b"#*$%&|<>", b" \t\n\r\x0b\x0c", bytes(range(0x80, 0xC0))
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the rolling base and of its inverse modulo 2**64, for as many positions as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE_INVERSE, np.uint64)])
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of small numbers (the finaliser of splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, n: int, powers: Powers, prefix: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``n`` words."""
    _, down = powers.of(len(ids) + 1)
    return (prefix[n:] - prefix[:-n]) * down[: len(ids) - n + 1]


def covered(hashes: np.ndarray, n: int, size: int) -> np.ndarray | None:
    """Which of ``size`` words lie in a window of ``n`` words whose hash occurs twice or more; None if none does."""
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    starts = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: bytes | None, powers: Powers) -> tuple:
    """The measures of one text, in the order of SCHEMA without the id."""
    text = text or b""
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, CONTINUED + SPACES))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_chars = dup_line_chars = 0
    seen: set[bytes] = set()
    n_dup = 0
    for line in lines:
        chars = len(line.translate(None, CONTINUED))
        line_chars += chars
        if line in seen:
            n_dup += 1
            dup_line_chars += chars
        else:
            seen.add(line)
    n_repeat, dup_chars = 0, [0] * len(NGRAM_PERCENT)
    shortest = min(NGRAM_PERCENT)
    if n > shortest:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n)
        with np.errstate(over="ignore"):
            up, _ = powers.of(n + 1)
            prefix = np.r_[np.uint64(0), np.cumsum(mixed(ids) * up[:n])]
            sizes = None
            for k, length in enumerate(sorted(NGRAM_PERCENT)):
                if n <= length:
                    break
                hit = covered(rolling(ids, length, powers, prefix), length, n)
                if hit is None:  # a longer n-gram repeats only if the shorter ones in it do
                    break
                if sizes is None:
                    sizes = np.fromiter((len(w.translate(None, CONTINUED)) for w in words), np.int64, n)
                dup_chars[k] = int(sizes[hit].sum())
                if length == WINDOW:
                    n_repeat = int(hit.sum())
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
    kept = not (
        failed
        or any(100 * c > p * word_chars for c, (_, p) in zip(dup_chars, sorted(NGRAM_PERCENT.items()), strict=True))
        or 100 * n_dup > LINE_PERCENT * len(lines)
        or 100 * dup_line_chars > LINE_CHAR_PERCENT * line_chars
    )
    return n, word_chars, n_symbols, n_dup, n_repeat, failed, kept, line_chars, dup_line_chars, *dup_chars


def judge(docs: DataFrame) -> DataFrame:
    """One row of measures and verdicts for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.bool_() if x.endswith(" boolean") else pa.int64() for x in SCHEMA.split(", ")]
        for whole in batches:
            for batch in sliced(whole, 2000):
                rows = [measure(x, powers) for x in byte_texts(batch.column("text"))]
                columns = list(zip(*rows, strict=True)) or [()] * (len(kinds) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64())] + [pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)], names=names
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that the rules reject.

    The verdict of a text depends on nothing else, so it is worked out in the row: no join by id, and rows whose id is
    null or repeated are kept or dropped one by one.
    """
    fields = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        for whole in batches:
            for batch in sliced(whole, 2000):
                yield batch.filter(pa.array([measure(x, powers)[6] for x in byte_texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, fields)


def _sql() -> str:
    grams = " UNION ALL ".join(f"SELECT row_id, {n} AS n, i, words[i:i+{n - 1}] AS g FROM pos WHERE i <= n_words - {n - 1}" for n in NGRAM_PERCENT)
    tests = " OR ".join(f"100 * coalesce(c{n}, 0) > {p} * word_chars" for n, p in NGRAM_PERCENT.items())
    sums = ", ".join(f"sum(chars) FILTER (n = {n}) AS c{n}" for n in NGRAM_PERCENT)
    lists = ", ".join(f"coalesce(c{n}, 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_PERCENT)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
a AS (SELECT *, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
ln AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d),
lg AS (SELECT row_id, line, count(*) AS k FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id, line),
l AS (SELECT row_id, sum(k) AS n_lines, sum(k - 1) AS n_dup_lines, sum(k * length(line)) AS line_chars, sum((k - 1) * length(line)) AS dup_line_chars FROM lg GROUP BY row_id),
pos AS (SELECT row_id, words, n_words, unnest(range(1, n_words + 1)) AS i FROM a),
g AS ({grams}),
hit AS (SELECT row_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY row_id, n, g) > 1),
cov AS (SELECT DISTINCT row_id, n, unnest(range(i, i + n)) AS p FROM hit),
cc AS (SELECT cov.row_id, cov.n, count(*) AS k, sum(length(a.words[cov.p])) AS chars FROM cov JOIN a USING (row_id) GROUP BY ALL),
s AS (SELECT row_id, sum(k) FILTER (n = {WINDOW}) AS rep, {sums} FROM cc GROUP BY row_id),
j AS (SELECT a.*, coalesce(n_dup_lines, 0) AS dl, coalesce(rep, 0) AS rp, coalesce(l.n_lines, 0) AS nl, coalesce(l.line_chars, 0) AS lc, coalesce(l.dup_line_chars, 0) AS dlc, s.* EXCLUDE (row_id, rep)
  FROM a LEFT JOIN l USING (row_id) LEFT JOIN s USING (row_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, dl::BIGINT AS n_dup_lines, rp::BIGINT AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * rp > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * rp > {MAX_REPEAT_PERCENT} * n_words OR {tests} OR 100 * dl > {LINE_PERCENT} * nl OR 100 * dlc > {LINE_CHAR_PERCENT} * lc) AS kept,
  lc::BIGINT AS line_chars, dlc::BIGINT AS dup_line_chars, {lists}
FROM j"""


SQL = _sql()
