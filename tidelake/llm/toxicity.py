"""Toxicity by cumulative-link ordinal regression (operator 3).

Severity grades 0 < 1 < ... < K share one weight vector over sparse word features; ordered thresholds t_1 < ... < t_K
separate them: P(grade >= k) = sigmoid(w.x - t_k). The expected severity is the sum of these probabilities. The model is
fitted in numpy on the driver, on a bounded sample of the labelled documents (``MAX_LABELLED`` rows, chosen by a hash of
the id), whose size doesn't grow with the input; every document is scored by its whole text on the executors.

``graded`` derives grades from 0/1 labels: a toxic document is severe (2) if indicative words, those much more frequent
in toxic than in other documents, make up at least the median share among toxic documents, else mild (1).

Defined results: a null text is an empty one, with the score of the thresholds alone. Labels whose id or grade is null
are left out, a repeated label counts once with its highest grade. With fewer than two grades in the sample, every
document has severity 0. Repeated rows and null ids are scored as they are; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import byte_texts, dropped, sliced, table, written

MAX_LABELLED = 30_000
BUCKETS = 1 << 18
MAX_FEATURES = 8192
MIN_DOCUMENTS = 5  # that a feature must occur in
RIDGE = 3e-4
STEPS, RATE = 250, 0.1
TOXIC = 0.25  # expected severity from which a document counts as toxic
SCHEMA = "doc_id long, expected_severity double, grade int, toxic boolean"

_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0x20 if b < 128 and chr(b) not in "'" else b for b in range(256))


class Features:
    """Buckets of the words of a text, punctuation aside; remembers the buckets of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= 300_000:
            self.known.clear()
        found = self.known[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        known, bucket = self.known, self.bucket
        words = set((text or b"").translate(_FOLD).split())
        found = [known[w] if w in known else bucket(w) for w in words]
        return np.unique(np.array(found, np.int32))


@dataclass
class Model:
    """Weights of the buckets that were selected (sorted), and the thresholds."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.buckets] = self.weights
        return out

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Fits the model to feature sets and grades (0 to K) by Adam on the full sample; equal sets count once."""
    first_of = {(r.tobytes(), int(g)): k for k, (r, g) in reversed(list(enumerate(zip(rows, grades, strict=True))))}
    chosen = sorted(first_of.values())
    rows, grades = [rows[k] for k in chosen], grades[chosen]
    present = np.unique(grades)
    if len(present) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(1, 40.0))
    n, top = len(rows), int(grades.max())
    sizes = np.fromiter(map(len, rows), np.int64, n)
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    # Features are ranked by how far their count among positive grades is from what chance gives (in standard errors).
    share = (grades > 0).mean()
    total = np.bincount(flat, minlength=BUCKETS)
    positive = np.bincount(flat, (grades > 0)[owner].astype(float), BUCKETS)
    signal = np.where(total >= MIN_DOCUMENTS, (positive - share * total) ** 2 / np.maximum(share * (1 - share) * total, 1e-9), 0)
    buckets = np.sort(np.argsort(-signal, kind="stable")[:MAX_FEATURES])
    buckets = buckets[signal[buckets] > 0]
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    chosen = place[flat] >= 0
    owner, column = owner[chosen], place[flat[chosen]]

    levels = np.arange(1, top + 1)
    reached = (grades[:, None] >= levels[None, :]).mean(axis=0)
    start = -np.log(np.maximum(reached, 0.5 / n) / np.maximum(1 - reached, 0.5 / n))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    x = np.concatenate([np.zeros(len(buckets)), start[:1], gaps])
    first, second = np.zeros_like(x), np.zeros_like(x)
    d = len(buckets)
    for step in range(1, STEPS + 1):
        w, t = x[:d], np.concatenate([x[d : d + 1], x[d] + np.cumsum(np.exp(x[d + 1 :]))])
        score = np.bincount(owner, w[column], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(edges[np.arange(n), grades] - edges[np.arange(n), grades + 1], 1e-12)
        slope = edges * (1 - edges)
        upper, lower = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
        by_score = -(upper - lower) / n
        by_t = np.zeros((n, top + 2))
        by_t[np.arange(n), grades] += upper / n
        by_t[np.arange(n), grades + 1] -= lower / n
        by_t = by_t[:, 1 : top + 1].sum(axis=0)
        after = by_t[::-1].cumsum()[::-1]  # a threshold moves all those above it
        gradient = np.concatenate([np.bincount(column, by_score[owner], d) + RIDGE * w, after[:1], after[1:] * np.exp(x[d + 1 :])])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        x -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(buckets, x[:d], np.concatenate([x[d : d + 1], x[d] + np.cumsum(np.exp(x[d + 1 :]))]))


def graded(toxic: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from 0/1 labels by the share of indicative words."""
    if not toxic.any() or toxic.all():
        return toxic.astype(np.int64)
    return np.where(toxic > 0, 1 + (shares >= np.median(shares[toxic > 0])), 0).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature sets, labels and shares of indicative words of a sample of about MAX_LABELLED labelled documents at most.

    Features are counted on the executors; the driver gets a row for each bucket (BUCKETS at most), then of each document of
    the sample only the MAX_FEATURES buckets that tell most, two bytes each.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), F.col("toxic").cast("int").alias("mark")).dropna().groupBy("mark_id").agg(F.max("mark").alias("mark"))
    count = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64("mark_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MAX_LABELLED / max(1, count))))
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    # The marks are MAX_LABELLED rows of two numbers, give or take a few percent: small enough for any executor.
    found = written(rows.join(F.broadcast(marks), rows.doc_id == marks.mark_id).select(F.when(F.col("mark") > 0, 1).otherwise(0).alias("mark"), "text"))

    def count_features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for whole in batches:
            for batch in sliced(whole, 500):
                total, positive = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
                for text, mark in zip(byte_texts(batch.column("text")), batch.column("mark").to_pylist(), strict=True):
                    held = features.of(text)
                    total[held] += 1
                    positive[held] += mark
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used]), pa.array(positive[used])], names=["bucket", "total", "positive"])

    counted = found.mapInArrow(count_features, "bucket int, total long, positive long").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    got = counted.filter(F.col("total") >= MIN_DOCUMENTS).toArrow()
    order = np.argsort(got.column("bucket").to_numpy())
    bucket, total, positive = (got.column(c).to_numpy()[order] for c in ("bucket", "total", "positive"))
    sizes = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("mark"), F.lit(0)).alias("toxic")).first()
    n, n_toxic = int(sizes["n"]), int(sizes["toxic"])
    # Indicative words are much more frequent in toxic documents than in others.
    odds = ((positive + 0.5) / (n_toxic + 1)) / ((total - positive + 0.5) / (n - n_toxic + 1))
    indicative = bucket[(odds > 8) & (positive >= MIN_DOCUMENTS)]
    share = n_toxic / max(1, n)
    signal = (positive - share * total) ** 2 / np.maximum(share * (1 - share) * total, 1e-9)
    chosen = np.sort(bucket[np.argsort(-signal, kind="stable")[:MAX_FEATURES]])
    sent = docs.sparkSession.sparkContext.broadcast((chosen, indicative))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        (chosen, indicative), features = sent.value, Features()
        place, tells = np.full(BUCKETS, -1, np.int32), np.zeros(BUCKETS, bool)
        place[chosen], tells[indicative] = np.arange(len(chosen)), True
        for whole in batches:
            for batch in sliced(whole, 500):
                sets = [features.of(x) for x in byte_texts(batch.column("text"))]
                kept = [place[s] for s in sets]
                kept = [k[k >= 0].astype(np.uint16).tobytes() for k in kept]
                shares = [float(tells[s].sum() / max(1, len(s))) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("mark").cast(pa.int32()), pa.array(kept, pa.binary()), pa.array(shares, pa.float64())], names=["mark", "features", "share"])

    got = found.mapInArrow(run, "mark int, features binary, share double").toArrow()
    dropped(found)
    # An order of its own, as that of the executors' answers may differ between runs.
    rows_of = sorted(zip(got.column("mark").to_pylist(), got.column("features").to_pylist(), got.column("share").to_pylist(), strict=True))
    sets = [chosen[np.frombuffer(x, np.uint16)].astype(np.int32) for _, x, _ in rows_of]
    return sets, np.array([m for m, _, _ in rows_of], np.int64), np.array([s for _, _, s in rows_of], float)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Expected severity, most probable grade and verdict for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, features = sent.value, Features()
        weights = model.dense()
        for whole in batches:
            for batch in sliced(whole, 500):
                scores = np.array([weights[features.of(x)].sum() for x in byte_texts(batch.column("text"))], float)
                above = model.above(scores) if len(scores) else np.zeros((0, len(model.thresholds)))
                edges = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
                expected = above.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(expected, pa.float64()), pa.array((edges[:, :-1] - edges[:, 1:]).argmax(axis=1), pa.int32()), pa.array(expected >= TOXIC, pa.bool_())],
                    names=["doc_id", "expected_severity", "grade", "toxic"],
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, toxic, shares = sample(docs, table(spark, sf_dir, "labels"))
    return score(docs, fit(rows, graded(toxic, shares)))
