"""Quality rules: isolation forests on rule statistics.

Each text is summed up by counts (words, symbols, repeated lines and words, ...). Trees that split a random feature
at a random place isolate unusual documents after few splits; the anomaly score falls with the mean path length.
There is a forest for each rule, over the features that the rule looks at, and one over all of them: in a single
forest over everything, junk that makes up some hundredths of the rows and differs in one feature only is masked.
The score above which a rule rejects is calibrated on all labelled rows. The forests are fitted on a bounded sample
(`fit_rows` rows with the smallest hashes of their ids); statistics, scores and calibration cover all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .space import written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_digits", "n_same_words"]
SYMBOLS = np.isin(B.BYTES, list(b"#*$%&|<>"))
UPPER = (B.BYTES >= 65) & (B.BYTES <= 90)
MARKS = np.isin(B.BYTES, list(b"!?;:=+~^_@{}[]()/\\\"'"))
DIGITS = (B.BYTES >= 48) & (B.BYTES <= 57)
WINDOW = 8
BINS = 2000
#: Which columns of features() each rule's forest splits.
RULES = {"symbols": [2], "repeats": [3, 4], "same": [8], "case": [5, 6], "shape": [1, 7], "all": [0, 1, 2, 3, 4, 5, 6, 7, 8]}


def statistics(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    word = B.IN_WORD[data]
    start, end = B.spans(word, offsets)
    of = B.bounds(start, offsets)
    hashed = B.span_hash(data, start, end)
    owner = B.owners(of)
    window = B.runs_of(hashed, WINDOW)
    inside = owner[: len(window)] == owner[WINDOW - 1 :] if len(window) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    again = at[B.found_twice(window[at] ^ B.mix64(owner[at].astype(B.U)))]
    repeated = B.covered(again, again + WINDOW, len(start))

    line_start, line_end = B.lines(data, offsets)
    wordy = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[wordy], line_end[wordy]
    line_of = B.bounds(line_start, offsets)
    key = B.span_hash(data, line_start, line_end) ^ B.mix64(B.owners(line_of).astype(B.U))
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True

    counts = {
        "n_words": np.diff(of),
        "word_chars": B.sums(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": B.sums(SYMBOLS[data], offsets),
        "n_dup_lines": B.sums(~new, line_of),
        "n_repeat_words": B.sums(repeated, of),
        "n_lines": np.diff(line_of),
        "n_upper": B.sums(UPPER[data], offsets),
        "n_marks": B.sums(MARKS[data], offsets),
        "n_digits": B.sums(DIGITS[data], offsets),
        "n_same_words": B.sums(np.append((hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1]), [False] * (len(hashed) > 0)), of),
    }
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS + MORE)], ["doc_id", *COUNTS, *MORE])


def rule_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the counts of COUNTS and MORE, one row for each row of docs. Null texts count as empty."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(B.mapped(statistics), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(counts["n_words"], 1).astype(float)
    chars = np.maximum(counts["word_chars"], 1).astype(float)
    return np.stack(
        [
            np.log1p(np.minimum(counts["n_words"], 50)),
            chars / words,
            counts["n_symbols"] / words,
            counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
            counts["n_repeat_words"] / words,
            counts["n_upper"] / chars,
            counts["n_marks"] / chars,
            counts["n_digits"] / chars,
            counts["n_same_words"] / words,
        ],
        axis=1,
    )


class Forest:
    """Complete binary trees in arrays: feature and threshold of each inner node, path length at each place."""

    def __init__(self, x: np.ndarray, trees: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(rows, len(x)))))))
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.split = np.full((trees, nodes), np.inf)
        self.length = np.zeros((trees, nodes))
        self.norm = max(self._expected(min(rows, len(x))), 1e-9)
        for t in range(trees):
            picked = x[rng.choice(len(x), min(rows, len(x)), replace=False)] if len(x) else x
            self._grow(t, 0, 0, picked, rng)

    @staticmethod
    def _expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rng: np.random.Generator) -> None:
        low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
        can = np.flatnonzero(high > low)
        self.length[t, node] = depth + self._expected(len(x))
        if depth == self.depth or len(x) < 2 or not len(can):
            for below in (2 * node + 1, 2 * node + 2) if depth < self.depth else ():
                self._leaf(t, below, depth + 1, self.length[t, node])
            return
        f = int(rng.choice(can))
        self.feature[t, node], self.split[t, node] = f, rng.uniform(low[f], high[f])
        left = x[:, f] < self.split[t, node]
        self._grow(t, 2 * node + 1, depth + 1, x[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, x[~left], rng)

    def _leaf(self, t: int, node: int, depth: int, length: float) -> None:
        self.length[t, node] = length
        if depth < self.depth:
            self._leaf(t, 2 * node + 1, depth + 1, length)
            self._leaf(t, 2 * node + 2, depth + 1, length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: more unusual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= split[node])
            total += length[node]
        return 2 ** (-total / len(self.split) / self.norm)


def anomaly_scores(stats: DataFrame, fit_rows: int = 4096, trees: int = 60, tree_rows: int = 64, seed: int = 5) -> DataFrame:
    """stats and `anomaly`, a score for each of RULES, from forests fitted on fit_rows rows (those with the smallest
    hashes of their ids)."""
    names = COUNTS + MORE
    sample = stats.orderBy(F.xxhash64("doc_id"), *names).limit(fit_rows).select(*names).toPandas()
    x = features({c: sample[c].to_numpy() for c in names})
    forests = [(columns, Forest(x[:, columns], trees, tree_rows, seed + i)) for i, columns in enumerate(RULES.values())]

    def run(batches):
        for batch in batches:
            x = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
            scores = np.stack([forest.score(x[:, columns]) for columns, forest in forests], axis=1)
            ends = pa.array(np.arange(len(x) + 1) * len(forests), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))], [*batch.schema.names, "anomaly"])

    return stats.mapInArrow(run, T.StructType([*stats.schema, T.StructField("anomaly", T.ArrayType(T.DoubleType()))]))


def calibrated(scored: DataFrame, labels: DataFrame, keep: float) -> list[float]:
    """For each rule the anomaly score from which to reject: the cut that best parts good from bad among all labelled
    rows that pass the base rules, of those that keep at least the share `keep` of the good ones. Without labels of
    both kinds: infinity. Only counts by score bin come to the driver."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = scored.where(~F.col("base_failed")).join(known, "doc_id").select("quality", F.posexplode("anomaly").alias("rule", "score"))
    binned = rows.groupBy("rule", F.floor(F.col("score") * BINS).cast("int").alias("bin"), "quality").count().collect()
    good, bad = np.zeros((len(RULES), BINS + 1)), np.zeros((len(RULES), BINS + 1))
    for rule, at, quality, n in binned:
        (good if quality == 1 else bad)[rule, at] += n
    found = []
    for g, b in zip(good, bad):
        if not g.sum() or not b.sum():
            found.append(float("inf"))
            continue
        kept, passed = np.cumsum(g) / g.sum(), np.cumsum(b) / b.sum()
        cuts = np.flatnonzero(kept >= keep)
        best = kept[cuts] - passed[cuts]
        found.append(float(cuts[len(cuts) - 1 - np.argmax(best[::-1])] + 1) / BINS)
    return found


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: float = 0.998, **fit) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly (by rule), kept for each row of docs.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed and under the
    calibrated cut of every rule. Null and empty texts have no words and fail; repeated rows repeat.
    """
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    stats = written(rule_statistics(docs, text, doc_id), "rules").withColumn("base_failed", failed)
    scored = written(anomaly_scores(stats, **fit), "rules-scored")
    ok = ~F.col("base_failed")
    for i, cut in enumerate(calibrated(scored, labels, keep)):
        ok &= F.get("anomaly", F.lit(i)) < cut
    return scored.select("doc_id", *COUNTS, "base_failed", "anomaly", ok.alias("kept"))
