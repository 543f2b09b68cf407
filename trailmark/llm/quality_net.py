"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network with calibrated probabilities.

Every word gives three units: itself, its ending with its kind of letters, and how it repeats what stands before it.
A unit has a sparse random index vector; its word vector is that plus what index vectors stood around it in the
sample (random indexing). A document is the mean of its words' vectors. The network (numpy) is trained on a bounded
sample of labelled rows: at most `fit_rows`, those with the smallest hashes of their ids. A part of them, which the
training does not see, sets the temperature by which the network's outputs are divided.

Only the text is an input of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .space import written

DIM = 64
BUCKETS = 1 << 14
BLOCK = 1 << 15
#: Buckets whose parts, one of each task, are summed in one place.
SUMMED = 256
KINDS = np.zeros(256, np.uint8)
KINDS[48:58], KINDS[65:91], KINDS[97:123], KINDS[128:] = 1, 2, 4, 4
KINDS[list(b"!?;:=+~^_@{}[]()/\\\"'")] = 8
KINDS[list(b"#*$%&|<>")] = 16


def index_vectors() -> np.ndarray:
    """Sparse ternary: 6 places of each bucket's vector are 1 or -1."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(6):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] = rng.choice([-1, 1], BUCKETS)
    return out / np.float32(np.sqrt(6))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word's three units, and the bounds of the texts' words."""
    start, end = B.spans(B.IN_WORD[data], offsets)
    of = B.bounds(start, offsets)
    owner = B.owners(of)
    whole = B.span_hash(data, start, end)
    kinds = np.bitwise_or.reduceat(KINDS[data], start) if len(start) else np.zeros(0, np.uint8)
    # reduceat runs to the next word's start; the spaces between are of kind 0
    ending = B.span_hash(data, np.maximum(start, end - 3), end) + kinds.astype(B.U) * B.U(0x9E3779B97F4A7C15)
    same = np.zeros(len(start), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    four = B.runs_of(whole, 4)
    at = np.flatnonzero(owner[: len(four)] == owner[3:]) if len(four) else np.zeros(0, np.int64)
    again = at[B.found_twice(four[at] ^ B.mix64(owner[at].astype(B.U)))]
    repeat = 1 + same + 2 * B.covered(again, again + 4, len(start))
    found = np.stack([whole, B.mix64(ending), B.mix64(repeat.astype(B.U))], axis=1)
    return (found >> B.U(64 - 14)).astype(np.int32), of


def blocks(of: np.ndarray):
    """Runs of words, bounded also within a long text: (first, last, text of each run's part, the parts' starts)."""
    n = int(of[-1])
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        first = np.searchsorted(of, lo, "right") - 1
        starts = np.unique(np.clip(of[first:], lo, hi))
        starts = starts[starts < hi]
        yield lo, hi, np.searchsorted(of, starts, "right") - 1, starts - lo


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text (zero without words) and, last, the log of its length."""
    found, of = units(data, offsets)
    total = np.zeros((len(of) - 1, DIM))
    for lo, hi, text, starts in blocks(of):
        word = vectors[found[lo:hi, 0]] + vectors[found[lo:hi, 1]] + vectors[found[lo:hi, 2]]
        np.add.at(total, text, np.add.reduceat(word, starts, axis=0))
    n = np.diff(of)
    return np.concatenate([total / np.maximum(n, 1)[:, None], np.log1p(np.minimum(n, 100))[:, None] / 5], axis=1)


def contexts(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the two words on each side."""
    found, of = units(data, offsets)
    owner, word = B.owners(of), found[:, 0]
    for lo in range(0, len(word), BLOCK):
        at = np.arange(lo, min(len(word), lo + BLOCK))
        around = np.zeros((len(at), DIM), np.float32)
        for step in (-2, -1, 1, 2):
            near = np.clip(at + step, 0, len(word) - 1)
            around += index[word[near]] * ((owner[near] == owner[at]) & (near == at + step))[:, None]
        order = np.argsort(word[at], kind="stable")
        sorted_ = word[at][order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        into[sorted_[first]] += np.add.reduceat(around[order], first, axis=0)


class Network:
    """x -> tanh -> a logit, by Adam on the cross entropy. Both classes count by their rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(DIM + 1), np.ones(DIM + 1))
        self.temperature = 1.0
        self.w = [rng.normal(0, 1 / np.sqrt(DIM), (DIM + 1, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        if not len(x):
            return
        z = (x - self.mean) / self.scale
        moment, square, t = [0.0 * w for w in self.w], [0.0 * w for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 128):
                at = order[lo : lo + 128]
                h = np.tanh(z[at] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[at]) / len(at)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [z[at].T @ dh + 1e-4 * self.w[0], dh.sum(0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    moment[i] = 0.9 * moment[i] + 0.1 * g
                    square[i] = 0.999 * square[i] + 0.001 * g * g
                    rate = 0.004 * (1 - epoch / epochs) + 1e-4
                    self.w[i] = self.w[i] - rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross entropy on rows that the training has not seen."""
        if len(x) < 20:
            return
        z = self.logit(x)
        loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
        self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out. -1 for a null id: not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(-1))


def pooled_rows(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    def run(rows, data, offsets):
        x = pooled(data, offsets, vectors)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "x"])

    return docs.mapInArrow(B.mapped(run), "doc_id long, x binary")


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Each bucket's index vector and, scaled, the sum of those around it in the sample's texts."""
    index = index_vectors()

    def gather(batches):
        into, n = np.zeros((BUCKETS, DIM)), 0
        for batch in batches:
            for _, data, offsets in B.pieces(batch):
                contexts(data, offsets, index, into)
                n += 1
        for lo in range(0, BUCKETS if n else 0, SUMMED):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([into[lo : lo + SUMMED].astype(np.float32).tobytes()], pa.binary())], ["first", "part"])

    def add(table: pa.Table) -> pa.Table:
        # ordered, so that the sum and with it the scores agree between runs
        total = np.zeros((SUMMED, DIM))
        for part in sorted(x.as_py() for x in table.column("part")):
            total += np.frombuffer(part, np.float32).reshape(-1, DIM)
        total *= 0.5 / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)
        return pa.table({"first": [table.column("first")[0].as_py()], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    vectors = index.copy()
    parts = sample.select("text").coalesce(8).mapInArrow(gather, "first long, part binary").groupBy("first").applyInArrow(add, "first long, part binary")
    for first, part in parts.collect():
        vectors[first : first + SUMMED] += np.frombuffer(bytes(part), np.float32).reshape(-1, DIM)
    if not np.isfinite(vectors).all():
        raise FloatingPointError("word vectors are not finite")
    return vectors


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most fit_rows labelled rows outside the held-out fold. docs: doc_id, text."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    # chosen and summed by tasks: only the rows chosen and one sum come to the driver
    few = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "quality-few")
    sample = written(docs.join(F.broadcast(few), "doc_id").select("doc_id", "text").repartition(8), "quality-sample")
    vectors = word_vectors(sample)

    ids = few.toPandas()
    rows = pooled_rows(sample, vectors).toPandas().drop_duplicates("doc_id").merge(ids, on="doc_id").sort_values("doc_id")
    x = np.stack([np.frombuffer(v) for v in rows.x]) if len(rows) else np.zeros((0, DIM + 1))
    y = rows.quality.to_numpy().astype(float)
    aside = rows.doc_id.to_numpy() % 5 == 0
    net = Network(x[~aside], y[~aside])
    net.calibrate(x[aside], y[aside])
    return vectors, net


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts score by the network's answer to no words; without labelled rows the network is untrained
    and its scores mean nothing, but are there. Rows of one text score alike. Rows with a null id are not held out.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vectors, net = trained(narrow, labels, **fit)

    def run(rows, data, offsets):
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(net.probability(pooled(data, offsets, vectors)))], ["doc_id", "score"])

    out = narrow.mapInArrow(B.mapped(run), "doc_id long, score double")
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **fit) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, in one pass over the texts."""
    vectors, net = trained(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), labels, **fit)
    return docs.mapInArrow(B.filtered(lambda *x: net.probability(pooled(*x, vectors)) >= 0.5, text), docs.schema)
