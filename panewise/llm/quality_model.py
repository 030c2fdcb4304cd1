"""Quality classifier: random-indexing word vectors and a two-layer network.

A word (a run of letters, digits or one kind of sign) has a sparse ternary
index vector drawn from its hash. Its word vector is the sum of the index
vectors of its neighbours over the whole corpus, scaled to length one, beside
its own index vector. Words share ``BUCKETS`` slots by hash, so the vectors
have a fixed size however large the corpus. A document pools the mean and the
spread of its word vectors; a two-layer numpy network, trained on at most
``MAX_SAMPLE`` labelled rows outside the held-out fold (the first by a hash of
their id), gives a logit, and a temperature fitted on a part of those rows
that training did not see gives the probability.

Cases: null and empty texts pool to zeros and get that score; null labels are
not learned from; of labelled documents with one id one text is learned from;
every row is scored as it comes; a very long text is pooled by its counts of
buckets (some 30 bytes of memory for each byte); without labelled rows of both kinds every
score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import common
from .toxicity import labelled

BUCKETS = 1 << 14
DIM = 32
WINDOW = 2
BLOCKS = 64  # of buckets, for the sum over tasks
MAX_SAMPLE = 20_000
HIDDEN = 32
SLICE = 1 << 20


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs of each bucket's index vector."""
    rng = np.random.default_rng(17)
    return rng.integers(0, DIM, (BUCKETS, 2)), rng.integers(0, 2, (BUCKETS, 2)) * 2 - 1


PLACES, SIGNS = _index()
_KIND = np.full(256, 1, np.uint8)  # 0: space, 1: letter, 2: digit, then a kind for each sign
_KIND[list(range(0x21)) + [0x7F]] = 0
for _c in range(0x21, 0x7F):
    if not chr(_c).isalpha():
        _KIND[_c] = 2 if chr(_c).isdigit() else _c


def word_slots(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the first word of each text (n + 1). Capitals count as other words."""
    kind = _KIND[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[off[:-1][off[:-1] < len(raw)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    code = common.range_hashes(raw, starts, ends)
    return (code >> np.uint64(50)).astype(np.int64), np.searchsorted(starts, off)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM: for each bucket the sum of its neighbours' index vectors, over all documents.

    A task adds up its texts; what is shuffled is one fixed-size table for each task.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for b in common.slices(batch, limit=SLICE):
                raw, off = common.byte_view(common.texts(b))
                slot, first = word_slots(raw, off)
                doc = np.repeat(np.arange(b.num_rows), np.diff(first))
                for d in range(1, WINDOW + 1):
                    near = doc[d:] == doc[:-d]
                    x, y = slot[:-d][near], slot[d:][near]
                    for a, c in ((x, y), (y, x)):
                        for k in range(2):
                            sums += np.bincount(a * DIM + PLACES[c, k], weights=SIGNS[c, k], minlength=BUCKETS * DIM)
        part = sums.astype("<i8").reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in part], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("sums"), strict=True):
                x = np.frombuffer(data.as_buffer(), "<i8")
                total[k] = total[k] + x if k in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(common.tidy(local), schema).repartition(min(BLOCKS, common.partitions(docs.sparkSession)), "block").mapInArrow(common.tidy(add), schema)
    out = np.zeros((BLOCKS, BUCKETS * DIM // BLOCKS), np.int64)
    for r in parts.collect():  # BUCKETS x DIM numbers in all
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vector of length one, then the bucket's own index vector."""
    norm = np.linalg.norm(sums.astype(float), axis=1, keepdims=True)
    own = np.zeros((BUCKETS, DIM))
    for k in range(2):
        np.add.at(own, (np.arange(BUCKETS), PLACES[:, k]), SIGNS[:, k])
    return np.concatenate([sums / np.maximum(norm, 1), own], axis=1).astype(np.float32)


def pool(raw: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors, and the log of its number of words.

    A text's distinct buckets are weighed by their counts: one text is laid out
    at a time, of BUCKETS rows at most, and its numbers do not depend on the
    texts beside it.
    """
    slot, first = word_slots(raw, off)
    n = np.diff(first)
    out = np.zeros((len(n), 4 * DIM + 1))
    key, count = np.unique(np.repeat(np.arange(len(n)), n) * BUCKETS + slot, return_counts=True)
    doc, slot = np.divmod(key, BUCKETS)
    bounds = np.searchsorted(doc, np.arange(len(n) + 1)).tolist()
    weight = count / n[doc]
    for i in np.flatnonzero(n).tolist():
        here = slice(bounds[i], bounds[i + 1])
        x = vectors[slot[here]].astype(float)
        mean, square = np.einsum("i,ij->j", weight[here], x), np.einsum("i,ij,ij->j", weight[here], x, x)
        out[i] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), [np.log1p(n[i])]])
    return out


@dataclasses.dataclass
class Network:
    """Standardised input, one tanh layer, a logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, decay: float = 1e-4) -> Network:
    """Adam on the cross entropy; every fifth row only fits the temperature."""
    share = y.mean() if len(y) else 0.5
    flat = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if len(y) < 10 or share in (0, 1):
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[::5], np.setdiff1d(order, order[::5])
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), flat.b2)
    z = (x - mean) / scale
    moments: dict[str, list] = {k: [0.0, 0.0] for k in ("w1", "b1", "w2", "b2")}
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
            step += 1
            h = np.tanh(z[at] @ net.w1 + net.b1)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[at]) / len(at)
            dh = d[:, None] * net.w2 * (1 - h * h)
            grads = {"w1": z[at].T @ dh + decay * net.w1, "b1": dh.sum(0), "w2": h.T @ d + decay * net.w2, "b2": d.sum()}
            for k, g in grads.items():
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - 3e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
    logit = net.logit(x[held])
    grid = np.exp(np.linspace(-2, 3, 201))

    def loss(t: float) -> float:
        p = 1 / (1 + np.exp(-np.clip(logit / t, -30, 30)))
        return -float(np.mean(y[held] * np.log(p + 1e-12) + (1 - y[held]) * np.log(1 - p + 1e-12)))

    net.temperature = float(min(grid, key=loss))
    return net


def pooled(docs: DataFrame, vectors, carry: list[str], finish=None) -> DataFrame:
    """Carried columns with the pooled features, or with ``finish(features)`` as score; texts are in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch, limit=SLICE):
                x = pool(*common.byte_view(common.texts(b)), vectors.value[0])
                last = pa.array(list(x), pa.list_(pa.float64())) if finish is None else pa.array(finish(vectors.value[1], x))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), last], [*carry, "score"])

    return docs.mapInArrow(common.tidy(run), docs.select(*carry).schema.add("score", ArrayType(DoubleType()) if finish is None else DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; learns from ``labels.quality`` outside the held-out fold."""
    spark = docs.sparkSession
    vectors = word_vectors(context_sums(docs, text_col))
    shared = spark.sparkContext.broadcast((vectors, None))  # BUCKETS x 2 DIM floats
    rows = pooled(labelled(docs, labels, "quality", limit, id_col, text_col), shared, ["label"]).collect()  # limit rows at most
    x = np.array([r["score"] for r in rows]).reshape(-1, 4 * DIM + 1)
    y = np.array([r["label"] for r in rows], float)
    key = np.lexsort([*x.T[:3], y])  # the order of rows must not matter
    model = spark.sparkContext.broadcast((vectors, train(x[key], y[key])))
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = pooled(data, model, ["doc_id"], lambda net, z: net.score(z))
    return scored.select("doc_id", (common.crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

