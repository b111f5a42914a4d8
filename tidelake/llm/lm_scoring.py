"""LM scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation (operator 7).

Tokens are the words of a text with A-Z in lower case, then one end. Counts of all training tokens are gathered from the
whole corpus. The ``CLASSES`` most frequent tokens are classes of their own; all others, known or not, share ``TAIL``
classes by their last two bytes, so that the context tells what kind of rare word comes, as of which language.

Model (Mnih and Hinton, "Three new graphical models for statistical language modelling", 2007): the two tokens before a
token, through context weights, predict a vector; the score of a class is its product with the class's vector, plus a
bias. Training by noise-contrastive estimation (Mnih and Teh, 2012), minibatch by minibatch with noise shared in the
minibatch, so that all is matrix products. The training documents are dealt by a hash of id and text into shards of about
``SHARD_TOKENS`` tokens, in ``ROUNDS`` rounds: in a round each of its shards is trained on from the same start, then
parameters are averaged by the tokens seen, in the order of the shards. So the number of shards follows the corpus, and the
model doesn't depend on partitions or on the order in which tasks end.

Scores are normalised over classes for each context (the normaliser of a context is worked out once by a product with
all class vectors and kept), and over the tokens of a shared class by add-one unigram probability, unseen tokens being
one further kind. So the probabilities of all tokens after any context sum up to 1.

Counts are applied to texts in two tiers: the most frequent tokens, at most ``HEAD``, are sent to all executors;
the others go by a join on the token's hash, in which no key has more rows than the last head token has occurrences.

Defined results: a null text is an empty one, that is one end token. A null id counts as an empty string for crc32. Rows
are scored one by one; repeated rows count as often as they occur. With no training tokens all scores follow the
smoothed, empty counts. Only ``doc_id`` and ``text`` are read. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import byte_texts, dropped, row_key, sliced, table, written

CLASSES = 1023
TAIL = 512
DIMENSIONS = 16
NOISE = 32
BATCH = 2048
RATE = 0.1
ROUNDS = 4
SHARD_TOKENS = 1 << 21
MIXERS = 16
HEAD = 1 << 18
END = b""  # no word is empty


def crc_remainder(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 7


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", crc_remainder() == 2)


def counts(docs: DataFrame) -> DataFrame:
    """(token, hash, c): occurrences of every token in the training documents."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        found: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])
            found.clear()
            return batch

        for whole in batches:
            for batch in sliced(whole, 1000):
                for text in byte_texts(batch.column("text")):
                    found.update(tokens(text))
                if len(found) > 400_000:
                    yield out()
        yield out()

    train = rows_of(docs).filter(~F.col("held_out")).select("text")
    summed = train.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))
    return summed.select("token", F.xxhash64("token").alias("hash"), "c")


def tail_class(token: bytes, tail: int) -> int:
    """Which of ``tail`` shared classes a token is of; ``tail_class_of`` is the same as a column."""
    import xxhash

    return xxhash.xxh64_intdigest(token[-2:], 42) % tail


def tail_class_of(token: str):
    return F.pmod(F.xxhash64(F.expr(f"substring({token}, greatest(octet_length({token}) - 1, 1), 2)")), F.lit(TAIL))


class Model:
    """Vectors, context weights and biases of the classes; the context after the last class is the start of a text."""

    def __init__(self, share: np.ndarray) -> None:
        random, classes = np.random.default_rng(5), len(share)
        self.share = share / share.sum()  # of each class among training tokens
        self.context = random.normal(0, 0.1, (classes + 1, DIMENSIONS)).astype(np.float32)
        self.target = random.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
        self.weights = np.ones((2, DIMENSIONS), np.float32)
        self.bias = np.log(np.maximum(self.share, 1e-12)).astype(np.float32)
        #: Sums of squared gradients, which set the steps.
        self.squares = [np.full_like(x, 1e-3) for x in self.arrays()]

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.weights, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.arrays(), *self.squares)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.arrays(), *self.squares):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def predicted(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.context[before] * self.weights[0] + self.context[last] * self.weights[1]


class Trainer:
    """Adagrad over minibatches of (token before the last, last token, token)."""

    def __init__(self, model: Model, seed: int) -> None:
        self.model, self.random, self.seen = model, np.random.default_rng(seed), 0
        self.noise_log = np.log(NOISE * np.maximum(model.share, 1e-12)).astype(np.float32)
        self.cumulated = np.cumsum(model.share)

    def step(self, before: np.ndarray, last: np.ndarray, token: np.ndarray) -> None:
        m, n = self.model, len(token)
        noise = np.minimum(np.searchsorted(self.cumulated, self.random.random(NOISE)), len(m.share) - 1)
        a, b = m.context[before], m.context[last]
        q = a * m.weights[0] + b * m.weights[1]
        own = (q * m.target[token]).sum(axis=1) + m.bias[token] - self.noise_log[token]
        other = q @ m.target[noise].T + (m.bias[noise] - self.noise_log[noise])
        g_own = (1 / (1 + np.exp(-np.clip(own, -30, 30))) - 1) / n
        g_other = 1 / (1 + np.exp(-np.clip(other, -30, 30))) / n
        g_q = g_own[:, None] * m.target[token] + g_other @ m.target[noise]
        g_target = scattered(token, g_own[:, None] * q, len(m.target))
        np.add.at(g_target, noise, g_other.T @ q)
        g_bias = np.bincount(token, g_own, len(m.bias)).astype(np.float32)
        np.add.at(g_bias, noise, g_other.sum(axis=0))
        g_context = scattered(before, g_q * m.weights[0], len(m.context)) + scattered(last, g_q * m.weights[1], len(m.context))
        g_weights = np.stack([(g_q * a).sum(axis=0), (g_q * b).sum(axis=0)])
        for x, square, g in zip(m.arrays(), m.squares, [g_context, g_target, g_weights, g_bias], strict=True):
            square += g * g
            x -= RATE * g / np.sqrt(square)
        self.seen += n


def scattered(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``index``."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((size, values.shape[1]), np.float32)
    out[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def windows(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two tokens before each token of one text, and the tokens."""
    padded = np.concatenate([np.full(2, start, ids.dtype), ids])
    return padded[:-2], padded[1:-1], ids


def encoded(docs: DataFrame, numbers: dict[bytes, int], shards: int) -> DataFrame:
    """(shard, key, ids) of the training documents: classes of their tokens, two bytes each."""
    sent, tail = docs.sparkSession.sparkContext.broadcast(numbers), TAIL

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, ends = sent.value, {}
        head, get = len(numbers), numbers.get

        def shared(token: bytes) -> int:
            end = token[-2:]
            if end not in ends:
                ends[end] = head + tail_class(end, tail)
            return ends[end]

        for whole in batches:
            for batch in sliced(whole, 500):
                found = [np.array([k if (k := get(t)) is not None else shared(t) for t in tokens(text)], np.uint16).tobytes() for text in byte_texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("key"), pa.array(found, pa.binary())], names=["shard", "key", "ids"])

    rows = rows_of(docs).filter(~F.col("held_out")).select(row_key().alias("key"), "text")
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "text")
    return rows.mapInArrow(run, "shard int, key binary, ids binary")


def train(rows: DataFrame, model: Model, shards: int) -> None:
    """Goes over ``rows`` (of encoded(), written) once, a part of the shards in every round; changes ``model``."""
    context = rows.sparkSession.sparkContext
    for round_ in range(ROUNDS):
        sent = context.broadcast(model)

        def learn(batches: Iterator, sent=sent, round_=round_) -> Iterator:
            import copy

            import pyarrow as pa

            start = sent.value
            trainer, last, held, size = None, None, [], 0

            def done() -> pa.RecordBatch:
                if size:
                    trainer.step(*[np.concatenate(x) for x in zip(*held, strict=True)])
                sums = trainer.model.flat().astype(np.float64) * trainer.seen
                return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([trainer.seen], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["shard", "seen", "sums"])

            for whole in batches:
                for shard, data in zip(whole.column("shard").to_pylist(), whole.column("ids").to_pylist(), strict=True):
                    if shard != last:
                        if trainer is not None:
                            yield done()
                        trainer, last, held, size = Trainer(copy.deepcopy(start), shard), shard, [], 0
                    held.append(windows(np.frombuffer(data, np.uint16).astype(np.int32), len(start.share)))
                    size += len(held[-1][2])
                    if size >= BATCH:
                        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
                        for at in range(0, size - BATCH + 1, BATCH):
                            trainer.step(*[x[at : at + BATCH] for x in joined])
                        at = size - size % BATCH
                        held, size = [tuple(x[at:] for x in joined)], size % BATCH
            if trainer is not None:
                yield done()

        def mix(batches: Iterator) -> Iterator:
            import pyarrow as pa

            first, seen, sums = None, 0, None
            for batch in batches:
                for shard, n, x in zip(batch.column("shard").to_pylist(), batch.column("seen").to_pylist(), batch.column("sums"), strict=True):
                    first, seen, sums = shard if first is None else first, seen + n, x.values.to_numpy() + (0 if sums is None else sums)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([seen], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["shard", "seen", "sums"])

        kind = "shard int, seen long, sums array<double>"
        dealt = rows.filter(F.col("shard") % ROUNDS == round_).repartition(max(1, shards // ROUNDS), "shard").sortWithinPartitions("shard", "key")
        # MIXERS sums at most come to the driver, added up in the order of the shards.
        got = dealt.mapInArrow(learn, kind).repartition(MIXERS, "shard").sortWithinPartitions("shard").mapInArrow(mix, kind).toArrow()
        if got.num_rows:
            parts = sorted(zip(got.column("shard").to_pylist(), got.column("seen").to_pylist(), [x.values.to_numpy() for x in got.column("sums").combine_chunks()], strict=True), key=lambda x: x[0])
            model.load(sum(x for _, _, x in parts) / sum(n for _, n, _ in parts))
        sent.destroy()


class Scorer:
    """Normalised log probabilities of classes; keeps the normaliser of each context."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, len(model.context)
        self.norm = np.full(self.width * self.width, np.nan, np.float32)

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Natural logs for each token of one text."""
        m = self.model
        before, last, token = windows(ids, len(m.share))
        code = before.astype(np.int64) * self.width + last
        missing = np.unique(code[np.isnan(self.norm[code])])
        for at in range(0, len(missing), 512):
            part = missing[at : at + 512]
            s = m.predicted(part // self.width, part % self.width) @ m.target.T + m.bias
            top = s.max(axis=1, keepdims=True)
            self.norm[part] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        return (m.predicted(before, last) * m.target[token]).sum(axis=1, dtype=np.float64) + m.bias[token] - self.norm[code]


def frequent(counted: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent tokens and their counts: HEAD at most, those from a count on which a histogram of counts (of a
    fixed number of bins) tells, so that nothing is sorted as a whole; CLASSES at least if there are as many."""
    bins = F.floor(F.log2("c") * 16)
    histogram = counted.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    held, least = 0, None
    for row in histogram:
        held += row["n"]
        if held > HEAD:
            break
        least = row["least"]
    chosen = counted.filter(F.col("c") >= least) if least is not None else counted.limit(0)
    if not histogram or sum(r["n"] for r in histogram if least is not None and r["least"] >= least) < CLASSES:
        chosen = counted.orderBy(F.desc("c"), "token").limit(CLASSES)
    found = chosen.select("token", "c").toArrow()
    rows = sorted(zip(found.column("token").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [t for t, _ in rows], np.array([c for _, c in rows], np.int64)


@dataclass
class Learned:
    """What scoring needs: the model, counts of training tokens, and of each shared class log10 of its add-one mass."""

    model: Model
    counted: DataFrame
    tokens: int
    distinct: int
    head: list[tuple[bytes, int]]
    classes: int
    log_rest: np.ndarray


def learned(docs: DataFrame) -> Learned:
    counted = written(counts(docs))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    head_tokens, head_counts = frequent(counted)
    classes = min(CLASSES, len(head_tokens))
    # Tokens, occurrences of each shared class: TAIL rows, less what the classes of their own make up.
    sums = counted.groupBy(tail_class_of("token").cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(TAIL), np.zeros(TAIL)
    for row in sums:
        mass[row["k"]], kinds[row["k"]] = row["c"], row["v"]
    for token, c in zip(head_tokens[:classes], head_counts[:classes].tolist(), strict=True):
        mass[tail_class(token, TAIL)] -= c
        kinds[tail_class(token, TAIL)] -= 1
    model = Model(np.concatenate([head_counts[:classes].astype(float), np.maximum(mass, 0.5)]))
    shards = ROUNDS * max(1, math.ceil(n / (ROUNDS * SHARD_TOKENS)))
    rows = written(encoded(docs, {t: k for k, t in enumerate(head_tokens[:classes])}, shards))
    train(rows, model, shards)
    dropped(rows)
    return Learned(model, counted, n, v, list(zip(head_tokens, head_counts.tolist(), strict=True)), classes, np.log10(mass + kinds + 1))


def score(docs: DataFrame, found: Learned | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    context = docs.sparkSession.sparkContext
    found = found or learned(docs)
    n, v, counted, classes, log_rest = found.tokens, found.distinct, found.counted, found.classes, found.log_rest
    known = {t: (k if k < classes else classes + tail_class(t, TAIL), math.log10(c + 1)) for k, (t, c) in enumerate(found.head)}
    sent, n_tail = context.broadcast((found.model, known)), TAIL

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        model, known = sent.value
        scorer, uid = Scorer(model), TaskContext.get().partitionId() << 40
        digest, get, ends = xxhash.xxh64_intdigest, known.get, {}

        def shared_class(token: bytes) -> int:
            end = token[-2:]
            if end not in ends:
                ends[end] = classes + tail_class(end, n_tail)
            return ends[end]

        for whole in batches:
            for batch in sliced(whole, 500):
                rows = []
                for text in byte_texts(batch.column("text")):
                    found = tokens(text)
                    at = [get(t) for t in found]
                    tail = [digest(t, seed=42) for t, x in zip(found, at, strict=True) if x is None]
                    ids = np.array([shared_class(t) if x is None else x[0] for t, x in zip(found, at, strict=True)], np.int32)
                    logs = math.fsum(x[1] for x in at if x is not None)
                    shared = math.fsum(x[1] for x in at if x is not None and x[0] >= classes)
                    lbl = float(scorer.log_probabilities(ids).sum()) / math.log(10) - float(log_rest[ids[ids >= classes] - classes].sum()) + shared
                    uid += 1
                    rows.append((uid, len(found), len(found) - len(tail), logs, lbl, np.array(tail, np.uint64).view(np.int64)))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "held_out", "uid", "n_tokens", "n_head", "logs", "lbl", "tail"],
                )

    partial = written(rows_of(docs).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, uid long, n_tokens long, n_head long, logs double, lbl double, tail array<long>"))
    rare = partial.select("uid", F.explode("tail").alias("tail_hash")).groupBy("uid", "tail_hash").agg(F.count("*").alias("times"))
    matched = rare.join(counted.select("hash", "c"), F.col("tail_hash") == F.col("hash"))
    # Sums of decimals don't depend on the order in which rows meet.
    sums = matched.groupBy("uid").agg(
        F.sum("times").alias("n_tail"), F.sum(F.col("times").cast("decimal(18,0)") * F.log10(F.col("c") + 1).cast("decimal(18,15)")).cast("double").alias("tail_logs")
    ).withColumnRenamed("uid", "tail_uid")
    tail_logs = F.coalesce(F.col("tail_logs"), F.lit(0.0))
    return partial.join(sums, partial.uid == sums.tail_uid, "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("lbl") + tail_logs).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
