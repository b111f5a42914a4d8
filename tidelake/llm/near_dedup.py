"""MinHash near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped
candidate edges, exact confirmation (operator 8).

A text's set holds the distinct shingles of ``words`` words (with fewer words, the whole sequence as one). Texts with
equal sets collapse to one node first, so copies cost nothing afterwards. A node's signature has ``BINS`` values: the
least hash in each bin, empty bins filled by optimal densification (Shrivastava, "Optimal Densification for Fast and
Accurate Minwise Hashing", 2017): each empty bin goes through the bins in an order of its own until it meets a full one.
The same holds for sets of any size: two bins agree with a probability of the sets' similarity, and the fewer bins are
full, the more evenly their elements are spread over the others.

Bands of ``ROWS`` values make buckets. In a bucket of up to ``FEW`` nodes all pairs are candidates; in a larger one the
star around the node with the most copies, so that candidates grow in proportion to the bucket. Candidates whose
signatures agree too little (``LEAST_AGREEING``) can't be linked but with a chance that the tests bound, the rest is
confirmed on the full sets. A larger bucket whose nodes are then still in several components is gone through again, in
blocks of at most ``BLOCK`` nodes: first signatures alone tell which nodes may be linked with one of another component,
then only these nodes' texts are sent, and confirmed on the full sets right there, each pair in the first bucket that it
shares. A link leaves the task only if it joins two components. So no link between components is lost, and nothing is
spent where a bucket is one component already.

With similarity 0.8, a pair misses all bands with a probability of (1 - 0.8**5)**40 = 1.2e-7 if bins are independent. As
measured for pairs of exactly 0.8 (``tests/llm/test_corpus_operators.py`` repeats it on fewer), see the README.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and is its own component. Texts
whose id is null are nodes like others but give no component its id; a component without any id has a null one, and its
rows are kept. Rows with equal id and text are alike; ``stage`` keeps one of them. An empty table gives an empty one. Only
ids and texts are read, so extra columns can't clash; ``stage`` refuses a column ``__row_key``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import byte_texts, dropped, if_small, mixed, row_key, shingle_hashes, sliced, table, word_hashes, written
from tidelake.llm.components import components

PERCENT = 80
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
FEW = 6
#: Of BINS signature bytes; 0.8 of them agree on average, 0.6 is seven standard deviations less.
LEAST_AGREEING = BINS * 6 // 10
#: Nodes of a bucket that one task holds twice at most.
BLOCK = 1024


class Signer:
    """Signatures of shingle sets; the same in every process."""

    def __init__(self) -> None:
        random = np.random.default_rng(11)
        self.edges = np.array([((k << 64) // BINS) for k in range(BINS)], np.uint64)
        #: Place of each bin (column) in the order in which an empty bin (row) goes through them.
        self.place = np.argsort(random.random((BINS, BINS)), axis=1).astype(np.int16)
        self.weights = random.integers(1, 1 << 62, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = random.integers(1, 1 << 62, BANDS, np.uint64)

    def values(self, found: np.ndarray) -> np.ndarray:
        """A value for each bin. ``found``: sorted distinct hashes, one at least."""
        at = np.searchsorted(found, self.edges)
        full = at < np.append(at[1:], len(found))
        values = found[np.minimum(at, len(found) - 1)]
        if not full.all():
            lends, lacks = np.flatnonzero(full), np.flatnonzero(~full)
            values[lacks] = values[lends[self.place[np.ix_(lacks, lends)].argmin(axis=1)]]
        return values

    def keys(self, values: np.ndarray) -> np.ndarray:
        """A key for each band."""
        return mixed((values.reshape(BANDS, ROWS) * self.weights).sum(axis=1) + self.band).view(np.int64)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    found = word_hashes(text or b"")
    return np.unique(shingle_hashes(found, min(words, len(found)) or 1))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key, node (digest of the set, null if it is empty), n_shingles, keys and signature bytes of each row."""
    import struct

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", row_key().alias("row_key"), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        signer = Signer()
        for whole in batches:
            for batch in sliced(whole, 1000):
                nodes, sizes, keys, marks = [], [], [], []
                with np.errstate(over="ignore"):
                    for text in byte_texts(batch.column("text")):
                        found = shingle_set(text, words)
                        n = len(found)
                        sizes.append(n)
                        if not n:
                            nodes.append(None)
                            keys.append([])
                            marks.append(None)
                            continue
                        nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                        values = signer.values(found)
                        keys.append(signer.keys(values))
                        marks.append(struct.pack("<i", n) + mixed(values).astype(np.uint8).tobytes() + keys[-1].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row_key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["doc_id", "row_key", "node", "n_shingles", "keys", "mark"],
                )

    return rows.mapInArrow(run, "doc_id long, row_key binary, node binary, n_shingles long, keys array<long>, mark binary")


def _size(mark: bytes) -> int:
    return int.from_bytes(mark[:4], "little")


def _signature(mark: bytes) -> np.ndarray:
    return np.frombuffer(mark, np.uint8, BINS, 4)


def _keys(mark: bytes) -> np.ndarray:
    """The low halves of the bucket keys; a mark holds the size, a byte of each value, then these."""
    return np.frombuffer(mark, np.uint32, BANDS, 4 + BINS)


def _may_link(a: bytes, b: bytes) -> bool:
    """Whether sizes and signatures leave a link possible."""
    n, m = _size(a), _size(b)
    return 100 * min(n, m) >= PERCENT * max(n, m) and int((_signature(a) == _signature(b)).sum()) >= LEAST_AGREEING


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes asked for, each once."""
    keys = written(wanted.join(nodes.select("node", "row_key"), "node"))
    rows = docs.select(row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    # No text moves but those asked for, if these are few.
    out = written(rows.join(if_small(keys), "row_key").dropDuplicates(["node"]).select("node", "text"))
    dropped(keys)
    return out


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Of ``pairs`` (u, v), those whose sets are similar enough. ``nodes``: node, row_key of one of its rows, mark."""
    marks = nodes.select("node", "mark")

    def likely(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("mark_u").to_pylist(), batch.column("mark_v").to_pylist()
            keep = pa.array([_may_link(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(keep)

    both = pairs.join(marks.toDF("u", "mark_u"), "u").join(marks.toDF("v", "mark_v"), "v")
    rest = written(both.mapInArrow(likely, "u binary, v binary"))
    texts = texts_of(rest.select(F.col("u").alias("node")).unionAll(rest.select("v")).distinct(), nodes, docs)
    held = rest.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v").sortWithinPartitions("u")

    def similar(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, own = None, None
        for whole in batches:
            for batch in sliced(whole, 200):
                keep = []
                us = batch.column("u").to_pylist()
                with np.errstate(over="ignore"):
                    for u, a, b in zip(us, byte_texts(batch.column("text_u")), byte_texts(batch.column("text_v")), strict=True):
                        if u != last:
                            last, own = u, shingle_set(a, words)
                        keep.append(_similar(own, shingle_set(b, words)))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    out = written(held.mapInArrow(similar, "u binary, v binary"))
    dropped(rest, texts)
    return out


def _pairs(members: DataFrame) -> DataFrame:
    """First candidates from bucket members (key, node): all pairs of small buckets, the star of larger ones."""
    few = members.filter(F.col("size") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # FEW at most
    at = F.sequence(F.lit(1), F.size("nodes") - 1)
    all_pairs = few.select(F.explode(F.flatten(F.transform(at, lambda i: F.transform(F.slice("nodes", i + 1, F.lit(FEW)), lambda v: F.struct(v.alias("u"), F.element_at("nodes", i).alias("v")))))).alias("p")).select("p.u", "p.v")
    star = members.filter(F.col("size") > FEW).filter(F.col("node") != F.col("centre"))
    return all_pairs.unionAll(star.select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v"))).distinct()


class Block:
    """Nodes of one pair of blocks of a bucket that may be linked across components. rows: (half, node, component, mark)."""

    def __init__(self, key: int, rows: list[tuple]) -> None:
        names = {c: k for k, c in enumerate(dict.fromkeys(r[2] for r in rows))}
        self.components = len(names)
        self.own = np.array([names[r[2]] for r in rows])
        self.half = np.array([r[0] for r in rows])
        self.crossing = self.half.min() != self.half.max()
        self.sizes = np.array([_size(r[3]) for r in rows])
        self.marks, self.keys = np.stack([_signature(r[3]) for r in rows]), np.stack([_keys(r[3]) for r in rows])
        self.band = int(np.flatnonzero((self.keys == np.uint32(key & 0xFFFFFFFF)).all(axis=0))[0])

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows of other components whose signatures leave a link possible, the likeliest first)."""
        if self.components < 2:
            return
        main, rows = int(np.bincount(self.own).argmax()), np.arange(len(self.own))
        for i in np.flatnonzero(self.own != main).tolist():
            other = (self.own != self.own[i]) & ((self.own == main) | (rows > i))
            other &= 100 * np.minimum(self.sizes, self.sizes[i]) >= PERCENT * np.maximum(self.sizes, self.sizes[i])
            if self.crossing:
                other &= self.half != self.half[i]
            at = np.flatnonzero(other)
            if self.band:  # a pair that shares an earlier bucket is compared there
                at = at[~(self.keys[at, : self.band] == self.keys[i, : self.band]).any(axis=1)]
            agree = (self.marks[at] == self.marks[i]).sum(axis=1)
            at, agree = at[agree >= LEAST_AGREEING], agree[agree >= LEAST_AGREEING]
            if len(at):
                yield i, at[np.argsort(-agree, kind="stable")]


def likely(key: int, rows: list[tuple]) -> list[tuple]:
    """The rows that are in a pair which may be linked; their texts are needed."""
    needed: set[int] = set()
    for i, at in Block(key, rows).pairs():
        needed.add(i)
        needed.update(at.tolist())
    return [rows[k] for k in sorted(needed)]


def resolved(key: int, rows: list[tuple], words: int) -> list[tuple[bytes, bytes]]:
    """Links that join components of one pair of blocks. rows: (half, node, component, mark, text)."""
    block = Block(key, rows)
    parent = list(range(block.components))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(rows[i][4], words)
        return sets[i]

    out = []
    for i, at in block.pairs():
        for j in at.tolist():
            a, b = root(block.own[i]), root(block.own[j])
            if a != b and _similar(set_of(i), set_of(j)):
                parent[a] = b
                out.append((rows[i][1], rows[j][1]))
    return out


def _joining(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links that the stars of large buckets didn't find: (u, v) of nodes in different components; a written table."""
    named = members.filter(F.col("size") > FEW).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # The centre's component stands for the bucket; a bucket with another one is gone through.
    of_centre = labels.select(F.col("node").alias("centre"), F.col("component").alias("centre_component"))
    split = named.join(of_centre, "centre", "left").filter(F.col("component") != F.coalesce("centre_component", "centre")).select("key").distinct()
    named = written(named.join(split, "key").select("key", "node", "component", "size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (
        named.join(nodes.select("node", "mark"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), F.when(F.col("block") > F.col("with"), 1).otherwise(0).alias("half"), "node", "component", "mark")
    )
    needed = written(_by_block(dealt, lambda key, rows: likely(key, rows), None))
    texts = texts_of(needed.select("node").distinct(), nodes, docs)
    with_texts = needed.join(texts, "node").select("key", "a", "b", "half", "node", "component", "mark", "text")
    out = written(_by_block(with_texts, None, lambda key, rows: resolved(key, rows, words)))
    dropped(named, needed, texts)
    return out


def _by_block(rows: DataFrame, keep, link) -> DataFrame:
    """Applies a function to the rows of each pair of blocks: ``keep`` gives rows again, ``link`` gives (u, v)."""
    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, held = None, []

        def done() -> pa.RecordBatch:
            if keep is not None:
                out = [(*last, *r) for r in keep(last[0], held)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=names)
            out = link(last[0], held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["u", "v"])

        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in sliced(whole, 500):
                    columns = [byte_texts(batch.column(c)) if c == "text" else batch.column(c).to_pylist() for c in names]
                    for key, a, b, *rest in zip(*columns, strict=True):
                        if (key, a, b) != last:
                            if held:
                                yield done()
                            last, held = (key, a, b), []
                        held.append(tuple(rest))
            if held:
                yield done()

    ordered = rows.repartition(F.col("key"), F.col("a"), F.col("b")).sortWithinPartitions("key", "a", "b")
    return ordered.mapInArrow(run, rows.schema if keep is not None else "u binary, v binary")


def links(docs: DataFrame, rows: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(confirmed links (u, v) that connect each component, component of each linked node). ``rows``: of signatures(), written."""
    # Equal sets have equal marks and keys; these aggregates are joined in part before the shuffle.
    nodes = written(
        rows.filter("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"), F.max("mark").alias("mark"), F.max("keys").alias("keys"), F.count("*").alias("copies"))
    )
    spread = nodes.select(F.explode("keys").alias("key"), "node", "copies")
    # Counted in part before the shuffle; the join has one row for a bucket on this side, so that a large one can be split.
    buckets = spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    centres = spread.join(buckets, "key").filter(F.col("size") > FEW).groupBy("key").agg(F.max(F.struct("copies", "node")).alias("most")).select("key", F.col("most.node").alias("centre"))
    members = written(spread.join(buckets, "key").join(centres, "key", "left").select("key", "node", "size", "centre"))
    found = confirmed(_pairs(members), nodes, docs, words)
    labels = written(components(found))
    more = _joining(members, labels, nodes, docs, words)
    if not more.isEmpty():
        found = found.unionAll(more)
        labels = written(components(found))
    dropped(nodes, members)
    return found, labels


def groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    rows = written(signatures(docs, words))
    _, labels = links(docs, rows, words)
    ids = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(least, "component").select(F.col("node").alias("of_node"), "component_id")
    return rows.join(by_node, rows.node == by_node.of_node, "left").select(
        "doc_id", "row_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), words=4).drop("row_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words; of equal rows one."""
    keep = groups(docs).filter("kept").select(F.col("row_key").alias("kept_key")).distinct()
    if "__row_key" in docs.columns:
        raise ValueError("a column __row_key is a name of this operator")
    keyed = docs.withColumn("__row_key", row_key())
    return keyed.join(keep, keyed["__row_key"] == keep.kept_key, "left_semi").dropDuplicates(["__row_key"]).select(*docs.columns)


#: Links on full sets by a join of shingles, components by repeated propagation.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT r, w[i:i+3] AS g FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
f AS (SELECT r, md5(string_agg(array_to_string(g, ' '), chr(10) ORDER BY g)) AS f FROM s GROUP BY r),
c AS (SELECT f, min(r) AS c FROM f GROUP BY f),
t AS (SELECT s.r, s.g, n.n FROM s JOIN n USING (r) WHERE s.r IN (SELECT c FROM c)),
l AS (SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT c.c, f.r FROM f JOIN c USING (f) UNION ALL SELECT f.r, c.c FROM f JOIN c USING (f)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM d JOIN m ON m.a = d.r LEFT JOIN n ON n.r = d.r"""
