"""A quality classifier on random-indexing word vectors.

Random indexing: each word has a sparse random index vector (a few entries of +1 and -1), and the vector of a word is the
sum of the index vectors of its neighbours within `WINDOW` places, over the whole corpus. Words and runs of symbols are dealt into
`BUCKETS` buckets, so the table has a fixed size; tasks add up their own table and Spark adds up the tables, row by row.
The mean of all vectors is taken off and each gets unit length.

A document is the mean of its words' vectors. A two-layer network is fitted in numpy on the vectors of at most `SAMPLE` labelled documents,
four fifths of them; the others choose the number of steps and the temperature that calibrates the probabilities.

Null and empty texts have the zero vector and get the score that the network gives it. With no labelled rows of both kinds, every
score is the share of label 1 (0.5 with none). Labels that are null are ignored, and each of several labels of a document counts. Rows
without doc_id are scored and not learned from. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seeded, stored

TOKENS = re.compile(r"\w+|[^\w\s]+")
BUCKETS, WIDTH, ENTRIES, WINDOW, SEED = 1 << 14, 48, 4, 2, 5
#: Bound of the labelled rows that the network is fitted on; its inner width, steps, rows of a step, and the largest share of weight decay.
SAMPLE, HIDDEN, EPOCHS, BATCH, DECAY = 20_000, 32, 40, 128, 1e-4
#: Entries of a worker's cache of word buckets.
CACHE_ENTRIES = 200_000


class Bucket(dict):
    """Word -> bucket."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        at = self[word] = 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        return at


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :ENTRIES]
    return places, rng.choice([-1, 1], (BUCKETS, ENTRIES))


def words_of(text: str | None, bucket: Bucket) -> np.ndarray:
    """Buckets of a text's words; a word that repeats the one before it is the word "again", number 0."""
    tokens = TOKENS.findall(text) if text else []
    t = np.fromiter(map(bucket.__getitem__, tokens), np.int32, len(tokens))
    return np.where(np.r_[False, t[1:] == t[:-1]], 0, t) if len(t) else t


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of each bucket, from all texts."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        bucket, total = Bucket(), np.zeros(BUCKETS * WIDTH, np.int64)
        gap = np.full(WINDOW, -1, np.int32)
        for b in batches:
            t = np.concatenate([x for text in b["text"] for x in (words_of(text.as_py(), bucket), gap)] or [gap])
            for step in range(1, WINDOW + 1):
                x, y = t[:-step], t[step:]
                near = np.flatnonzero((x >= 0) & (y >= 0))
                for a in range(0, len(near), 1 << 20):
                    i = near[a : a + (1 << 20)]
                    for own, other in ((x[i], y[i]), (y[i], x[i])):
                        at = own.astype(np.int64)[:, None] * WIDTH + places[other]
                        total += np.bincount(at.ravel(), signs[other].ravel(), BUCKETS * WIDTH).astype(np.int64)
        rows = total.reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows[used].tolist(), pa.list_(pa.int64()))], names=["bucket", "v"])

    sums = docs.select("text").mapInArrow(add_up, "bucket int, v array<long>").groupBy("bucket").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(WIDTH)])
    got = sums.toPandas()  # BUCKETS rows at most
    vectors = np.zeros((BUCKETS, WIDTH))
    vectors[got["bucket"].to_numpy()] = got.drop(columns="bucket").to_numpy()
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    vectors = unit(vectors)
    return unit(vectors - vectors[got["bucket"].to_numpy()].mean(axis=0) if len(got) else vectors).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x (the mean of the words' vectors) of documents (doc_id, text)."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, v = Bucket(), table.value
        for b in batches:
            rows = []
            for text in b["text"]:
                t = words_of(text.as_py(), bucket)
                often = np.bincount(t, minlength=1)
                used = np.flatnonzero(often)
                rows.append((often[used] @ v[used] / len(t)).tolist() if len(t) else [0.0] * WIDTH)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


class Network(NamedTuple):
    """Standardisation, two layers, temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -500, 500)))


def loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(np.log(np.where(y == 1, p, 1 - p).clip(1e-12))))


def constant(p: float) -> Network:
    """A network that always says p."""
    return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), np.array(np.log(max(p, 1e-9) / max(1 - p, 1e-9))), 1.0)


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss; the step of the lowest loss on the rows left out, and the temperature that fits them best."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    out = np.arange(len(y)) % 5 == 4
    mean, scale = x[~out].mean(axis=0), x[~out].std(axis=0) + 1e-6
    z, t = (x[~out] - mean) / scale, y[~out].astype(float)
    p = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(2 / HIDDEN), np.zeros(())]
    m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, None
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for i in range(0, len(t), BATCH):
            at = order[i : i + BATCH]
            hidden = np.maximum(z[at] @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -500, 500))) - t[at]) / len(at)
            back = np.outer(error, p[2]) * (hidden > 0)
            slope = [z[at].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], error.sum()]
            step += 1
            for j in range(4):
                m[j], v[j] = 0.9 * m[j] + 0.1 * slope[j], 0.999 * v[j] + 0.001 * slope[j] ** 2
                p[j] = p[j] - 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        now = Network(mean, scale, *[np.copy(a) for a in p], 1.0)
        if best is None or loss(now.probability(x[out]), y[out]) < loss(best.probability(x[out]), y[out]):
            best = now
    return min((best._replace(temperature=s) for s in np.geomspace(0.25, 8, 61)), key=lambda n: loss(n.probability(x[out]), y[out]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (probability of label 1) of documents (doc_id, text); labels: doc_id, label (0 or 1)."""
    points = stored(pooled(docs, word_vectors(docs)))
    labels = labels.filter("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    sample = labels.orderBy(seeded(SEED, "doc_id"), "doc_id", "label").limit(SAMPLE)
    got = points.join(sample, "doc_id").orderBy(seeded(SEED, "doc_id"), "doc_id", "label").limit(SAMPLE).toPandas()
    network = fit(np.array(got["x"].tolist(), dtype=float).reshape(-1, WIDTH), got["label"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(-1, WIDTH).astype(float)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(network.probability(x))], names=["doc_id", "score"])

    return points.mapInArrow(run, "doc_id long, score double")
