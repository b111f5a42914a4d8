"""Benchmark decontamination by size-partitioned MinHash containment search (operator 4).

Benchmark items are partitioned by the size of their shingle set into classes whose bound doubles. For each class a
document is read in overlapping windows of one and a half times the bound, so that an item that occurs lies whole in a
window of about its own size, however long the document is. Windows and items share MinHash functions; a window whose
minimum equals an item's under any function makes a candidate. Window minima of all classes come from minima of blocks
of eight shingles, joined pairwise. Candidates are verified by exact containment: the share of the item's distinct
shingles that the whole document holds.

A window of an item that is contained to 0.8 agrees with the item under one function with a probability of 0.25 at
least (the item at the low end of its class), so that 64 functions miss it with one of 1e-8. The smallest class, of items
of up to ``FEW`` shingles, is too small for that; its items are looked up by each of their shingles, which misses none. An
item of fewer than ``WORDS`` words is one shingle, its whole sequence of words.

The items of the benchmark are sent to the executors in blocks of bounded size (``BLOCK_BYTES``): one block at a time is on
the driver and on the executors, and the documents are read once for each; documents never move.

Defined results: a null text is an empty one; texts and items without words contain nothing and are contained in nothing.
Repeated rows give repeated pairs; a null id stays null. Only ids and texts are read, so that further columns can't clash;
``clean`` refuses a column ``__row_key``. Texts are searched whole. Empty tables give empty ones, and no items remove nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import byte_texts, if_small, row_key, shingle_hashes, sliced, table, word_hashes, written

WORDS = 5
LEAST_PERCENT = 80
FUNCTIONS = 64
BLOCK = 8
#: Shingles of an item up to which it is looked up by each of them.
FEW = 8
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
#: Shingles of a document that are looked at at a time; a multiple of every window step that occurs, or the largest is taken.
SPAN = 4096


class Items:
    """Shingle sets of benchmark items and their MinHash values by size class."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        self.ids, self.sets, self.words = [], [], []
        for item_id, text in rows:
            words = word_hashes((text or "").encode())
            size = min(WORDS, len(words))
            if size:
                self.ids.append(item_id)
                self.sets.append(np.unique(shingle_hashes(words, size)))
                self.words.append(size)
        self.multipliers = np.random.default_rng(7).integers(1, 1 << 62, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_level: dict[int, list[int]] = {}
        by_words: dict[int, list[int]] = {}
        for k, found in enumerate(self.sets):  # level: the class's bound is 2 * BLOCK << level
            if len(found) <= FEW:
                by_words.setdefault(self.words[k], []).append(k)
            else:
                by_level.setdefault(max(0, math.ceil(math.log2(len(found) / (2 * BLOCK)))), []).append(k)
        #: By words in a shingle: shingles of small items in order, and whose they are.
        self.small: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, members in by_words.items():
            values, owners = np.concatenate([self.sets[k] for k in members]), np.repeat(members, [len(self.sets[k]) for k in members])
            order = np.argsort(values, kind="stable")
            self.small[size] = values[order], owners[order]
        with np.errstate(over="ignore"):
            for level, members in by_level.items():
                values = np.concatenate([(self.sets[k][None, :] * self.multipliers[:, None]).min(axis=1) for k in members])
                owners = np.repeat(members, FUNCTIONS)
                order = np.argsort(values, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[(values >> np.uint64(12)) & np.uint64((1 << 20) - 1)] = True
                self.classes[level] = values[order], owners[order], seen

    def holding(self, size: int, held: np.ndarray) -> set[int]:
        """Small items of which the document's shingles (sorted, of ``size`` words) have one."""
        values, owners = self.small[size]
        at = np.minimum(np.searchsorted(held, values), len(held) - 1)
        return set(owners[held[at] == values].tolist())

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that a window of the document agrees with under some function."""
        if not self.classes or not len(shingles):
            return set()
        top = max(self.classes)
        step = BLOCK << top
        span = max(SPAN, 4 * step)
        found: set[int] = set()
        # Windows have three steps; each span reads two further steps, so that none is lost between spans.
        for at in range(0, len(shingles), span):
            part = shingles[at : at + span + 2 * step]
            if at and len(part) <= 2 * step:
                break
            blocks = max(1, -(-len(part) // BLOCK))
            values = np.full((FUNCTIONS, blocks * BLOCK), ~np.uint64(0))
            np.multiply(part[None, :], self.multipliers[:, None], out=values[:, : len(part)])
            for level in range(-3, top + 1):
                if level > -3:
                    if values.shape[1] % 2:
                        values = np.concatenate([values, np.full((FUNCTIONS, 1), ~np.uint64(0))], axis=1)
                    values = np.minimum(values[:, 0::2], values[:, 1::2])
                if level in self.classes:
                    windows = values
                    if values.shape[1] > 2:
                        windows = np.minimum(np.minimum(values[:, :-2], values[:, 1:-1]), values[:, 2:])
                    else:
                        windows = values.min(axis=1, keepdims=True)
                    wanted, owners, seen = self.classes[level]
                    likely = windows[seen[(windows >> np.uint64(12)) & np.uint64((1 << 20) - 1)]]
                    if len(likely):
                        left, right = np.searchsorted(wanted, likely, "left"), np.searchsorted(wanted, likely, "right")
                        for a, b in zip(left[right > left], right[right > left], strict=True):
                            found.update(owners[a:b].tolist())
        return found

    def contained(self, text: bytes | None) -> list[tuple]:
        """(item_id, shingles of the item, how many the text holds, share) of the items that the text contains."""
        out, held = [], {}
        with np.errstate(over="ignore"):
            words = word_hashes(text or b"")
            shingles = shingle_hashes(words, WORDS)
            near = self.candidates(shingles)
            for size in self.small:
                held[size] = np.unique(shingles if size == WORDS else shingle_hashes(words, size))
                if len(held[size]):
                    near |= self.holding(size, held[size])
        for k in sorted(near):
            item, size = self.sets[k], self.words[k]
            if size not in held:
                held[size] = np.unique(shingles)
            at = np.minimum(np.searchsorted(held[size], item), len(held[size]) - 1)
            shared = int((held[size][at] == item).sum())
            if 100 * shared >= LEAST_PERCENT * len(item):
                out.append((self.ids[k], len(item), shared, shared / len(item)))
        return out


def blocks_of(items: DataFrame) -> Iterator[Items]:
    """The items (item_id, text) in blocks of about BLOCK_BYTES bytes of text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    count = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(count):
        yield Items([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()])


def by_block(rows: DataFrame, items: DataFrame, schema: str, found) -> DataFrame:
    """``found(items, batch)`` for each batch of ``rows`` and each block of items, as written tables."""
    out = None
    for block in blocks_of(items):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator, sent=sent) -> Iterator:
            for whole in batches:
                for batch in sliced(whole, 2000):
                    yield found(sent.value, batch)

        part = written(rows.mapInArrow(run, schema))
        sent.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and an item that it contains to LEAST_PERCENT percent."""

    def found(block: Items, batch):
        import pyarrow as pa

        pairs = [(i, *x) for i, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True) for x in block.contained(text)]
        columns = list(zip(*pairs, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"]
        )

    return by_block(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), items, SCHEMA, found)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with null or repeated ids are judged one by one."""
    if "__row_key" in docs.columns:
        raise ValueError("a column __row_key is a name of this operator")

    def found(block: Items, batch):
        import pyarrow as pa

        return batch.filter(pa.array([bool(block.contained(x)) for x in byte_texts(batch.column("text"))], pa.bool_())).select(["found_key"])

    rows = docs.select(row_key().alias("found_key"), F.col("text").cast("string").alias("text"))
    hits = by_block(rows, items, "found_key binary", found)
    keys = written(hits.distinct())
    keyed = docs.withColumn("__row_key", row_key())
    return keyed.join(if_small(keys), F.col("__row_key") == F.col("found_key"), "left_anti").select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ik AS (SELECT *, least(len(w), {WORDS}) AS k FROM i WHERE len(w) > 0),
ip AS (SELECT r, id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM ik),
si AS (SELECT DISTINCT r, id, k, w[p:p+k-1] AS g FROM ip),
dp AS (SELECT r, id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k),
sd AS (SELECT DISTINCT r, id, k, w[p:p+k-1] AS g FROM dp),
n AS (SELECT r, count(*) AS n FROM si GROUP BY r),
m AS (SELECT sd.r AS dr, si.r AS ir, any_value(sd.id) AS doc_id, any_value(si.id) AS item_id, count(*) AS k FROM sd JOIN si ON sd.k = si.k AND sd.g = si.g GROUP BY sd.r, si.r)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, k::BIGINT AS n_shared, k::DOUBLE / n AS containment FROM m JOIN n ON n.r = m.ir WHERE 100 * k >= {LEAST_PERCENT} * n"""
