"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature.

Every word falls in a bucket of a hashed vocabulary, and each bucket has a sparse random index vector. A word's
vector is its own index vector plus the normalised sum of the index vectors around it in all documents, labelled
or not. A document is the mean of its words' vectors and of their squares. A network of two layers is trained on the labelled sample; its logit over a temperature, fitted on a part kept
apart from training, is the probability.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_list, chunks, read_table, small, tidied
from .shingles import word_hashes

DIM, NONZERO, BUCKETS, WINDOW = 48, 6, 1 << 14, 2
#: Labelled documents that the network and its temperature are fitted on, at most.
SAMPLE = 12_000
HIDDEN, EPOCHS, RATE, BATCH, DECAY = 24, 60, 3e-3, 128, 1e-4
WIDTH = 2 * DIM


def _index() -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of the few plus and minus ones of each bucket."""
    rng = np.random.default_rng(11)
    return [(rng.integers(0, DIM, BUCKETS), rng.choice([-1.0, 1.0], BUCKETS).astype(np.int64)) for _ in range(NONZERO)]


def index_vectors() -> np.ndarray:
    """A sparse random vector of a few plus and minus ones for each bucket."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for place, sign in _index():
        out[np.arange(BUCKETS), place] += sign.astype(np.float32)
    return out / np.sqrt(NONZERO)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 14)).astype(np.int64)


@tidied
def _contexts(batches):
    """The task's sums of plus and minus ones around each bucket's words, whole numbers, in one row a block of buckets."""
    index, total = _index(), np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        texts = bytes_list(batch.column(0))
        for i, j in chunks(texts):
            h, bounds = word_hashes(texts[i:j])
            b = _buckets(h)
            doc = np.repeat(np.arange(j - i), np.diff(bounds))
            for step in range(1, WINDOW + 1):
                left, right = b[:-step], b[step:]
                same = doc[:-step] == doc[step:]
                left, right = left[same], right[same]
                for at, near in ((left * DIM, right), (right * DIM, left)):
                    for place, sign in index:
                        np.add.at(total, at + place[near], sign[near])
    size = BUCKETS * DIM // 16
    yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([zlib.compress(total[k * size : (k + 1) * size].tobytes(), 1) for k in range(16)], pa.binary())], ["k", "sums"])


@tidied
def _added(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(zlib.decompress(raw), np.int64)
            held[k] = held[k] + x if k in held else x
    for k, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["k", "sums"])


def word_vectors(texts: DataFrame, text_col: str) -> np.ndarray:
    """A vector for each bucket from all texts; the sums are of fixed size and exact, in whatever order they merge."""
    parts = texts.select(F.col(text_col).cast("string")).mapInArrow(_contexts, "k int, sums binary")
    sums = {r.k: np.frombuffer(r.sums, np.int64) for r in parts.repartition(16, "k").mapInArrow(_added, "k int, sums binary").collect()}
    index = index_vectors()
    if not sums:
        return index
    context = (np.concatenate([sums[k] for k in range(16)]).reshape(BUCKETS, DIM) / np.sqrt(NONZERO)).astype(np.float32)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + context / np.maximum(norm, 1)


def features(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """One row for each text: mean and mean square of its word vectors (zeros without words)."""
    h, bounds = word_hashes(texts)
    b, n = _buckets(h), np.diff(bounds)
    total = np.zeros((len(texts), WIDTH))
    doc = np.repeat(np.arange(len(texts)), n)
    for c in range(0, len(b), 8192):  # a slice of words at a time, so that a very long text needs no more
        v, d = vectors[b[c : c + 8192]].astype(np.float64), doc[c : c + 8192]
        at = np.flatnonzero(np.diff(d, prepend=-1))
        total[d[at], :DIM] += np.add.reduceat(v, at, axis=0)
        total[d[at], DIM:] += np.add.reduceat(v * v, at, axis=0)
    return (total / np.maximum(n, 1)[:, None]).astype(np.float32)


class Network:
    """Two layers; inputs are standardised, weights fitted by Adam on the log loss with L2 decay."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        z = self.standard(x)
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for i in range(0, len(z), BATCH):
                at = order[i : i + BATCH]
                step += 1
                for k, g in enumerate(self.gradient(z[at], y[at])):
                    g = g + DECAY * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def gradient(self, z: np.ndarray, y: np.ndarray):
        w1, b1, w2, b2 = self.w
        h = np.tanh(z @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - y) / len(y)
        back = np.outer(d, w2) * (1 - h * h)
        return z.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh(self.standard(x) @ w1 + b1) @ w2 + b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss, by golden-section search on its logarithm."""
        z = self.logit(x)

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, -np.where(y > 0.5, z, -z) / np.exp(t))))

        low, high, ratio = -2.5, 3.5, (5**0.5 - 1) / 2
        for _ in range(60):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


class Constant:
    """What is left to say without two kinds of labels: their share, by Laplace's rule."""

    def __init__(self, y: np.ndarray):
        self.share = (float(y.sum()) + 1) / (len(y) + 2)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


@tidied
def _featured(batches, vectors):
    for batch in batches:
        ids, y, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_list(batch.column(2))
        for i, j in chunks(texts):
            x = features(texts[i:j], vectors.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(y[i:j], pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])


@tidied
def _scored(batches, vectors, model, text_at: int, names: list[str]):
    for batch in batches:
        texts, p = bytes_list(batch.column(text_at)), []
        for i, j in chunks(texts):
            p += model.value.probability(features(texts[i:j], vectors.value)).tolist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The input with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Labels are learned from ids whose crc32 (of the id as text) modulo 3 is not 1; the others are held out.
    The word vectors come from all texts. The network takes at most `sample` labelled ids, those of the smallest
    hash; every fifth of them, by another hash, sets the temperature only. Words alone make a score.

    Null labels and ids are not learned from; of several labels of an id the largest counts. Null and empty
    texts are scored like any other. With labels of one kind, or none, every score is their smoothed share.
    A null id is not held out. Repeated rows are scored alike, texts of any length whole; an empty table gives none.
    Columns named like the new ones are replaced, all others pass through.
    """
    spark = docs.sparkSession
    data = docs.drop("held_out", "score", "predicted")
    part = lambda c: F.crc32(c.cast("string").cast("binary")) % 3 == 1
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~part(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample).cache()
    learned = data.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(small(chosen), "_id")
    vectors = spark.sparkContext.broadcast(word_vectors(data, text_col))
    fitted = learned.select("_id", "_y", "_text").mapInArrow(partial(_featured, vectors=vectors), "doc_id long, y int, x binary")
    # At most `sample` ids; rows that repeat an id count once.
    kept = fitted.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    chosen.unpersist()
    y = kept["y"].to_numpy(float)
    x = np.frombuffer(b"".join(kept["x"]), np.float32).reshape(len(y), WIDTH).astype(float)
    apart = (kept["doc_id"].to_numpy(np.int64) * 2654435761 >> 7) % 5 == 0
    if len(set(y[~apart])) == 2:
        net = Network(x[~apart], y[~apart])
        if len(set(y[apart])) == 2:
            net.calibrate(x[apart], y[apart])
    else:
        net = Constant(y)
    model = spark.sparkContext.broadcast(net)
    rows = data.withColumn(text_col, F.col(text_col).cast("string"))
    names = [*data.columns, "score"]
    scored = rows.mapInArrow(partial(_scored, vectors=vectors, model=model, text_at=data.columns.index(text_col), names=names), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    held = F.coalesce(part(F.col(id_col)), F.lit(False))
    return scored.select(*data.columns, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
