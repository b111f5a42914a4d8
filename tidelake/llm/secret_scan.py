"""Secret scans with a trigram inverted index (operator 5). DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived (``trigram_query``, after Cox, "Regular Expression Matching with
a Trigram Index", 2012): every match holds all trigrams of one of the query's alternatives. The index holds a posting
(trigram, row key) for each trigram that any query asks for; intersecting postings gives each rule's candidate rows, and
the pattern itself verifies them. A rule without mandatory trigrams (``hex``) scans every row.

Only the candidates' texts are read again; what goes into joins are row keys and spans, never the texts of all rows.

Spans come from the gaps: splitting a text by a pattern and extracting its matches walk over the same matches, so the
running sum of lengths gives each match's start, in code points. The sums run in blocks of ``STEP`` matches, as appending
to one long array would copy it for each match.

Defined results: a null text is an empty one without spans, a null id stays null. Rows with equal id and text are alike;
the row key has 128 bits of them. Extra columns aren't read. Texts are scanned whole. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as regex_parser
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import dropped, if_small, row_key, table, written


def either_case(word: str) -> str:
    """A pattern for ``word`` with its ASCII letters in either case (flags for that differ between engines)."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: A query is a set of alternatives, each a set of trigrams that a text must hold; ANY asks for nothing.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Texts and alternatives up to which they are told apart; beyond, a query asks for less, which is never wrong.
MOST = 64


def _least(alternatives: Iterable[frozenset[str]]) -> Query:
    """Without alternatives that ask for more than another one."""
    found = sorted(set(alternatives), key=len)
    kept = [x for k, x in enumerate(found) if not any(y <= x for y in found[:k])]
    return frozenset(kept) if len(kept) <= MOST else ANY


def _both(a: Query, b: Query) -> Query:
    return _least(x | y for x in a for y in b) if len(a) * len(b) <= MOST * MOST else a


def _holding(texts: Iterable[str]) -> Query:
    """What a text must hold in which one of ``texts`` occurs."""
    return _least(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


@dataclass(frozen=True)
class Facts:
    """About the matches of a part of a pattern: all of them if there are few (``exact``), else how they may begin and end;
    and the query that they fulfil."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query

    def loose(self) -> Facts:
        """The same without ``exact``: of a text of which this is a part."""
        if self.exact is None:
            return self
        return Facts(None, self.exact, self.exact, _both(self.query, _holding(self.exact)))


def _exactly(texts: Iterable[str]) -> Facts:
    found = frozenset(texts)
    return Facts(found, found, found, ANY)


UNKNOWN = Facts(None, frozenset([""]), frozenset([""]), ANY)


def _then(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _exactly(x + y for x, y in itertools.product(a.exact, b.exact))
    across = _holding(x + y for x, y in itertools.product(a.ends, b.begins)) if len(a.ends) * len(b.begins) <= MOST else ANY
    joined = lambda x, y: frozenset(p + q for p, q in itertools.product(x, y)) if len(x) * len(y) <= MOST else None
    begins = joined(a.exact, b.begins) if a.exact is not None else None
    ends = joined(a.ends, b.exact) if b.exact is not None else None
    query = _both(_both(a.loose().query, b.loose().query), across)
    return Facts(None, a.begins if begins is None else begins, b.ends if ends is None else ends, query)


def _either(parts: list[Facts]) -> Facts:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return _exactly(x for p in parts for x in p.exact)
    loose = [p.loose() for p in parts]
    return Facts(None, frozenset().union(*[p.begins for p in loose]), frozenset().union(*[p.ends for p in loose]), _least(x for p in loose for x in p.query))


def _of_parsed(parsed) -> Facts:
    out = _exactly([""])
    for op, value in parsed:
        if op is sre.LITERAL:
            part = _exactly([folded(chr(value))])
        elif op is sre.IN and not any(kind is sre.NEGATE or kind is sre.CATEGORY for kind, _ in value):
            codes = [c for kind, x in value for c in ((x,) if kind is sre.LITERAL else range(x[0], x[1] + 1))]
            letters = {folded(chr(c)) for c in codes}
            part = _exactly(letters) if len(letters) <= 8 else UNKNOWN
        elif op is sre.BRANCH:
            part = _either([_of_parsed(x) for x in value[1]])
        elif op is sre.SUBPATTERN:
            part = _of_parsed(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _of_parsed(inner)
            if (least, most) == (0, 1):
                part = _either([once, _exactly([""])])
            else:
                part = once.loose() if least else UNKNOWN
        elif op is sre.AT:
            part = _exactly([""])
        else:
            part = UNKNOWN
        out = _then(out, part)
    return out


def folded(text: str) -> str:
    """With A-Z in lower case, as the index has it."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams (folded) of which every match of the pattern holds one; ANY if nothing is mandatory."""
    return _of_parsed(regex_parser.parse(pattern)).loose().query


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans. A match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int

    def query(self) -> list[frozenset[str]]:
        """Alternatives of trigrams, all of which a match must hold; empty if nothing is mandatory: scan fully."""
        found = trigram_query(self.pattern)
        return [] if found == ANY else sorted(found, key=sorted)


WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + f"|{either_case('api')}_?{either_case('key')}"
ASSIGN = Rule("assign", rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 18)
# The matches of [0-9a-f]+ are the maximal runs, so that those of 16 and more are the matches of [0-9a-f]{16,}.
HEX = Rule("hex", r"[0-9a-f]{16,}", 0, 16)
BASE_RULES = (ASSIGN, ACCESS, HEX)
#: What the method adds: published token formats.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
)
RULES = BASE_RULES + ADDED_RULES


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, row_key) of ``docs`` (row_key, text), case folded, for the trigrams that queries ask for."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # The folded text is bound once for all trigrams.
    wanted = F.array(*[F.lit(t) for t in trigrams])
    held = F.transform(F.array(folded), lambda text: F.filter(wanted, lambda t: F.contains(text, t)))
    return docs.select(F.explode(held[0]).alias("trigram"), "row_key")


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """For each row with a candidate: row_key and the kinds of the rules whose trigram query it fulfils."""
    rows = postings.groupBy("row_key").agg(F.collect_set("trigram").alias("held"))  # at most one entry for each trigram asked for
    fulfilled = []
    for rule in rules:
        if query := rule.query():
            any_of = F.lit(False)
            for alternative in query:
                wanted = F.array(*[F.lit(t) for t in sorted(alternative)])
                any_of = any_of | (F.size(F.array_except(wanted, "held")) == 0)
            fulfilled.append(F.when(any_of, F.lit(rule.kind)))
    return rows.select("row_key", F.array_compact(F.array(*fulfilled)).alias("kinds")).filter(F.size("kinds") > 0)


SPAN = "struct<start:int,kind_order:int,end:int,kind:string>"
STEP = 64


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: names in a lambda are bound, other expressions are evaluated anew for
    each element that they are used for."""
    return F.transform(F.array(value), use)[0]


def spans(rule: Rule, order: int) -> Column:
    """Array of (start, kind_order, end, kind) of the rule's matches in ``text``."""
    found, gaps = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), F.split("text", rule.pattern, -1)
    counts = F.length if rule.group == 0 else lambda match: F.length(F.regexp_extract(match, rule.pattern, rule.group))
    steps = F.transform(
        F.filter(F.arrays_zip(found.alias("match"), gaps.alias("gap")), lambda x: x["match"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), (counts(x["match"]) >= rule.least).alias("counts")),
    )
    after = lambda at, x: at + x["gap"] + x["size"]
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STEP).cast("int")), lambda b: F.slice(steps, b * STEP + 1, F.lit(STEP)))

    def starts(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), after))
        return F.aggregate(
            lengths, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"],
        )

    def of_block(block: Column, start: Column) -> Column:
        one = lambda at, x: F.array(F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("kind_order"), after(at, x).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.aggregate(
            block, F.struct(start.alias("at"), none.alias("spans")),
            lambda a, x: F.struct(after(a["at"], x).alias("at"), F.when(x["counts"], F.concat(a["spans"], one(a["at"], x))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"],
        )

    walked = lambda b: F.flatten(F.transform(F.arrays_zip(b.alias("block"), starts(b).alias("start")), lambda x: of_block(x["block"], x["start"])))
    return bound(steps, lambda s: F.when(F.size(s) > 0, bound(blocks(s), walked)).otherwise(none))


def joined(column: str) -> Column:
    """kind:start:end of the spans by start, then the kinds' order."""
    return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text) with an array column of spans for each rule, named by its kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", row_key().alias("row_key"))
    queried = [r for r in rules if r.query()]
    asked = sorted({t for rule in queried for alternative in rule.query() for t in alternative})
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    order = {rule.kind: k for k, rule in enumerate(rules)}
    hits = written(candidates(index(rows, asked), queried).withColumnRenamed("row_key", "hit_key"))
    read = rows.join(if_small(hits), rows.row_key == hits.hit_key)
    verified = read.select("row_key", *[F.when(F.array_contains("kinds", r.kind), spans(r, order[r.kind])).otherwise(none).alias(r.kind) for r in queried])
    found = written(verified.filter(" or ".join(f"size({r.kind}) > 0" for r in queried)).dropDuplicates(["row_key"]).withColumnRenamed("row_key", "found_key"))
    dropped(hits)
    scanned = rows.select("doc_id", "row_key", *[spans(r, order[r.kind]).alias(r.kind) for r in rules if r not in queried])
    side = if_small(found, 50_000)  # of a few spans each
    return scanned.join(side, scanned.row_key == found.found_key, "left").select(
        "doc_id", *[F.coalesce(r.kind, none).alias(r.kind) if r in queried else F.col(r.kind) for r in rules]
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base, every = [r.kind for r in BASE_RULES], [r.kind for r in RULES]
    return found.withColumn("base", F.concat(*base)).withColumn("every", F.concat(*every)).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("every").alias("spans"),
    )


def _sql() -> str:
    """Plain scans of every row; the same spans by splitting at the matches."""

    def of(k: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return (
            f"SELECT row_id, '{rule.kind}' AS kind, {k} AS kind_order, unnest(regexp_extract_all(text, '{p}', 0)) AS m, unnest(list_slice(string_split_regex(text, '{p}'), 1, -2)) AS gap, "
            f"unnest(range(len(regexp_extract_all(text, '{p}', 0)))) AS i, {rule.group} AS grp, {rule.least} AS least, '{p}' AS p FROM d"
        )

    kept = " OR ".join(f"(kind = '{r.kind}' AND length(regexp_extract(m, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})) >= {r.least})" for r in RULES)
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(of(k, r) for k, r in enumerate(RULES))}),
w AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row_id, kind ORDER BY i) AS e FROM m),
f AS (SELECT *, e - length(m) AS s FROM w WHERE {kept}),
g AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg({text}, ',' ORDER BY s, kind_order) FILTER (kind_order < {len(BASE_RULES)}) AS base, string_agg({text}, ',' ORDER BY s, kind_order) AS spans FROM f GROUP BY row_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_id)"""


SQL = _sql()
