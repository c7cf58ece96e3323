"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Word vectors: every word bucket (words are hashed into ``BUCKETS``) has a sparse random index vector of four
signs; a bucket's context vector is the sum of the index vectors of its neighbours up to two words away, over
the whole corpus (integer sums, so the result does not depend on partitioning). Partial sums have a fixed size
and are added up in a tree, so neither the driver nor a task gets more than a few of them.

Documents: mean and standard deviation of the normalised vectors of a document's words, over the whole text.
Network: tanh layer, sigmoid output, trained by Adam in numpy on the driver on at most ``per_class`` labelled
rows of each class (the documented bound of the training sample). A fifth of them is kept out of training and
sets the temperature by which the logits are divided.

Defined cases: a null text counts as empty; a text without words has zero features and is scored like any other;
repeated rows get equal scores; null ids are scored and never used for training; without labels of both
classes the score is the share of label 1 (0.5 if there is no label); empty tables give empty results. Other
columns are passed through unchanged by ``scored`` and ``keep_good``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from windlass.llm.common import batches, bounded_labels, labels_of, whole_text

BUCKETS, DIMS, SIGNS, NEAR = 8192, 32, 4, 2
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """Word -> bucket, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return out


def word_ids(texts, known: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of ``texts``, and the number of words of each text."""
    found = [[known[w] for w in TOKEN.findall(t)] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((w for ws in found for w in ws), np.int64, int(counts.sum())), counts


def index_vectors(seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's sparse random vector."""
    rng = np.random.default_rng(seed)
    return rng.random((BUCKETS, DIMS)).argsort(1)[:, :SIGNS], rng.choice([-1, 1], (BUCKETS, SIGNS))


def context_sums(ids: np.ndarray, counts: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(BUCKETS * DIMS)
    for step in range(1, NEAR + 1):
        same = doc[step:] == doc[:-step]
        left, right = ids[:-step][same], ids[step:][same]
        for word, other in ((left, right), (right, left)):
            for k in range(SIGNS):
                out += np.bincount(word * DIMS + places[other, k], signs[other, k], BUCKETS * DIMS)
    return out.astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over all of ``docs``, of length one (zero for unseen buckets)."""
    def partial(frames):
        known, (places, signs), total = Buckets(), index_vectors(), np.zeros(BUCKETS * DIMS, np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts):
                total += context_sums(*word_ids(texts[a:b], known), places, signs)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    sums = (docs.select(whole_text(F.col("text")).alias("text")).mapInPandas(partial, "sums binary")
            .rdd.map(lambda row: np.frombuffer(row[0], np.int64)))
    total = sums.treeReduce(np.add, 3) if sums.getNumPartitions() else np.zeros(BUCKETS * DIMS, np.int64)
    vectors = total.reshape(BUCKETS, DIMS).astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(texts, vectors: np.ndarray, known: Buckets) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text."""
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for a, b in batches(texts, 500_000):
        ids, counts = word_ids(texts[a:b], known)
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        starts, n = (np.cumsum(counts) - counts)[some], counts[some][:, None]
        words = vectors[ids]
        mean = np.add.reduceat(words, starts) / n
        square = np.add.reduceat(words * words, starts) / n
        out[a + some] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
    return out


class Network:
    """tanh(x W1 + b1) W2 + b2, its logit divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 8):
        x, y = x.astype(np.float64), y.astype(np.float64)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held = order[:len(x) // 5]
        fit = order[len(x) // 5:]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, hidden ** -0.5, hidden), np.zeros(())]
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                z, t = (x[part] - self.mean) / self.scale, y[part]
                h = np.tanh(z @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - t) / len(part)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z.T @ dh + 1e-4 * self.w[0], dh.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum())):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.005 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            logits = self.logits(x[held])
            grid = np.geomspace(0.25, 16, 121)
            loss = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


class Constant:
    def __init__(self, y: np.ndarray):
        self.value = float(y.mean()) if len(y) else 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000):
    """(vectors, network) learned from all texts, and from a bounded sample of the labelled ones."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = F.broadcast(bounded_labels(labels_of(labels, "quality"), per_class))  # 2 x per_class rows at most

    def features(frames):
        known = Buckets()
        for frame in frames:
            x = pooled(frame["text"].tolist(), shared.value, known)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": [r.tobytes() for r in x]})

    rows = (docs.select("doc_id", whole_text(F.col("text")).alias("text")).join(sample, "doc_id")
            .mapInPandas(features, "doc_id long, label int, x binary").collect())
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, 2 * DIMS)
    y = np.array([r["label"] for r in rows], np.int64)
    return vectors, (Network(x, y) if len(set(y.tolist())) > 1 else Constant(y))


def scored(docs: DataFrame, vectors: np.ndarray, network, name: str) -> DataFrame:
    """``docs`` with the score as a last column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    at = docs.columns.index("text")

    def score(parts):
        vectors, known = shared.value, Buckets()
        for part in parts:
            texts = [t or "" for t in part.column(at).to_pylist()]
            scores = network(pooled(texts, vectors, known)) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 5000) -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of ``docs``."""
    from windlass.llm.common import id_remainder

    model = fit(docs, labels, per_class)
    out = scored(docs.select("doc_id", "text"), *model, "score")
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 5000) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; columns unchanged."""
    return scored(docs, *fit(docs, labels, per_class), "__quality").filter(F.col("__quality") >= threshold).drop("__quality")
