"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are computed in one pass over the texts. Equal fingerprints are one node. Two fingerprints of at most
`distance` differing bits agree on whole blocks of bits, so each is sent to the groups of its block values; within a
group they are sorted by Gray rank, eight neighbours at a time share a node that keeps the bits they all have, and
nodes share nodes above them. A query walks down with the differences it has met so far and drops a node, with all
below it, once these exceed the distance. Groups hand on a forest of links, not the pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .space import written

U = B.U
P1, P2, P3, P4, P5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
FAN = 8
#: Pairs of a query and a node that are looked at together.
FRONTIER = 1 << 21
#: Fingerprints of a group that meet in one place; of a larger group, each two parts meet in a place of their own.
MOST = 1 << 15


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each data[start:start + size]."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    half = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
    out = np.full(len(start), U((seed + int(P5)) % (1 << 64)), U)
    lanes = [U((seed + x) % (1 << 64)) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
    at = start.copy()
    stripes = size >> 5
    long_ = np.flatnonzero(stripes)
    if len(long_):
        long_ = long_[np.argsort(-stripes[long_], kind="stable")]
        left = stripes[long_]
        v = [np.full(len(long_), s, U) for s in lanes]
        p = at[long_]
        for k in range(int(left[0])):
            n = int(np.searchsorted(-left, -k, "left"))
            for i in range(4):
                v[i][:n] = _round(v[i][:n], word[p[:n] + (32 * k + 8 * i)])
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.zeros_like(x), x)) * P1 + P4
        out[long_] = h
        at[long_] += left * 32
    out += size.astype(U)
    rest = size & 31
    for k in range(3):
        i = np.flatnonzero(rest >= 8 * (k + 1))
        if len(i):
            lane = word[at[i] + 8 * k]
            out[i] = _rotl(out[i] ^ _round(np.zeros_like(lane), lane), 27) * P1 + P4
    at += rest & ~7
    i = np.flatnonzero(rest & 4)
    out[i] = _rotl(out[i] ^ (half[at[i]].astype(U) * P1), 23) * P2 + P3
    at[i] += 4
    for k in range(3):
        i = np.flatnonzero((rest & 3) > k)
        out[i] = _rotl(out[i] ^ (raw[at[i] + k].astype(U) * P5), 11) * P1
    out ^= out >> U(33)
    out *= P2
    out ^= out >> U(29)
    out *= P3
    return out ^ (out >> U(32))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes (words in lower case, one space between), start and size of each text's shingles in them, and
    the bounds of the texts' shingles. A text of 1 to k-1 words has one shingle, a text without words none."""
    inside = B.IN_WORD[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    start, end = B.spans(inside, offsets)
    place = np.cumsum(keep) - 1
    plain = np.where(inside, B.LOWER[data], 32).astype(np.uint8)[keep]
    low = place[start] if len(start) else start
    high = low + (end - start)
    of = B.bounds(start, offsets)
    n = np.diff(of)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    owner = B.owners(at)
    first = of[owner] + np.arange(at[-1]) - at[owner]
    last = np.minimum(first + k, of[owner + 1]) - 1
    return plain, low[first], high[last] - low[first], at


def simhash(data: np.ndarray, offsets: np.ndarray, k: int = 4) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is 1 if more than half of the text's shingle hashes have it."""
    plain, start, size, at = shingles(data, offsets, k)
    h = xxh64(plain, start, size)
    n = np.diff(at)
    full = -(-n // 255)
    ends = np.concatenate([[0], np.cumsum(full)])
    owner = B.owners(ends)
    step = at[owner] + 255 * (np.arange(ends[-1]) - ends[owner])
    out = np.zeros(len(n), U)
    if not len(h):
        return out
    for j in range(8):
        lanes = (h >> U(j)) & U(0x0101010101010101)
        part = np.add.reduceat(lanes, step).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones = B.sums(part[:, byte].astype(np.int64), ends)
            out |= (2 * ones > n).astype(U) << U(8 * byte + j)
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 4) -> DataFrame:
    """doc_id, fp (long) for each row. Null and empty texts: 0."""

    def run(rows, data, offsets):
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(simhash(data, offsets, k).view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(B.mapped(run), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


def links(key: np.ndarray, fp: np.ndarray, distance: int):
    """Pairs of places whose key is equal and whose fingerprints differ in at most `distance` bits, a chunk at a
    time. key and fp must be sorted by key, then Gray rank."""
    m = len(fp)
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    ones, anys, first, owner = [], [], [np.arange(m)], group
    shared, value, start = [np.full(m, ~U(0))], [fp], np.arange(m)
    levels = []  # of each level: masks, patterns, first child, group
    while len(np.unique(owner)) < len(owner):
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        rank = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
        cut = np.flatnonzero(rank % FAN == 0)
        both = np.bitwise_and.reduceat(value[-1], cut) if not levels else np.bitwise_and.reduceat(ones, cut)
        some = np.bitwise_or.reduceat(value[-1], cut) if not levels else np.bitwise_or.reduceat(anys, cut)
        ones, anys, owner = both, some, owner[cut]
        levels.append((~(both ^ some), both, np.append(cut, len(rank)), owner))
    top = np.searchsorted(owner, group)
    end = np.arange(1, m + 1)
    spans = [end]  # of each node: one past its last place
    for _, _, child, _ in levels:
        spans.append(spans[-1][child[1:] - 1])
    todo = np.flatnonzero(np.diff(np.append(group, -1)) == 0)  # the last of a group has none after it
    per = max(1, FRONTIER // max(1, FAN ** min(3, len(levels))))
    for lo in range(0, len(todo), per):
        q = todo[lo : lo + per]
        node, mask, met = top[q], np.zeros(len(q), U), np.zeros(len(q), np.int64)
        for depth in range(len(levels) - 1, -2, -1):
            own_mask, own_value = (levels[depth][0][node], levels[depth][1][node]) if depth >= 0 else (np.full(len(node), ~U(0)), fp[node])
            met = met + np.bitwise_count((fp[q] ^ own_value) & own_mask & ~mask)
            ok = (met <= distance) & (spans[depth + 1][node] > q + 1 if depth >= 0 else node > q)
            q, node, mask, met = q[ok], node[ok], own_mask[ok], met[ok]
            if depth >= 0:
                child = levels[depth][2]
                n = child[node + 1] - child[node]
                fan = np.repeat(np.arange(len(node)), n)
                inner = np.arange(len(fan)) - np.repeat(np.cumsum(n) - n, n)
                node = child[node][fan] + inner
                q, mask, met = q[fan], mask[fan], met[fan]
        yield q, node


def forest(m: int, pairs) -> np.ndarray:
    """For each of m places the smallest place that the pairs connect it with."""
    label = np.arange(m)
    for a, b in pairs:
        while len(a):
            x, y = label[a], label[b]
            rest = x != y
            if not rest.any():
                break
            a, b, x, y = a[rest], b[rest], x[rest], y[rest]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def block_keys(fp: Column, blocks: int, agree: int) -> Column:
    """A key for each choice of `agree` of the `blocks` blocks of bits: the choice's number and the bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def linked(nodes: DataFrame, distance: int = 4, shuffle_rows: int = 1 << 20, most: int = MOST) -> DataFrame:
    """Edges a, b that connect every two nodes (fp distinct, id) of at most `distance` differing bits, directly or by
    way of others. The more nodes, the more bits must agree, so that a group stays at about a hundred; groups that
    stay large all the same, as their fingerprints are not spread, are cut into parts of about `most` nodes."""
    n = nodes.count()
    for blocks in range(distance + 1, 3 * distance + 1):
        agree = blocks - distance
        if n / 2 ** (64 * agree / blocks) <= 128:
            break
    keyed = nodes.select("id", "fp", F.explode(block_keys(F.col("fp"), blocks, agree)).alias("key"))
    keyed = keyed.select("id", "fp", F.xxhash64("key.choice", "key.bits").alias("key"))
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "simhash-large")
    cut = keyed.join(large, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / most), F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id", "key"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    place = F.when(F.col("parts") > 1, F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("key"))
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * comb(blocks, agree) // shuffle_rows)
    keyed = cut.select("id", "fp", place.alias("key")).repartition(parts, "key")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        node, fp, key = (table.column(c).to_numpy() for c in ("id", "fp", "key"))
        order = np.lexsort((gray_rank(fp.view(U)), key))
        node, fp, key = node[order], fp[order].view(U), key[order]
        label = forest(len(fp), links(key, fp, distance))
        at = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(node[label[at]]), pa.array(node[at])], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 4, distance: int = 4, **how) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links) for each row of docs.

    Texts without words have fingerprint 0 and are linked like any other; repeated rows have equal fingerprints;
    null ids belong to the component of their fingerprint but never name it. An error, if the components do not settle.
    """
    rows = written(fingerprints(docs, text, doc_id, k), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "simhash-nodes")
    found = components(linked(nodes, distance, **how))
    named = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without those whose group has a document with a smaller id. Repeated rows of the id that stays all stay."""
    gone = near_duplicates(docs, text, doc_id, **how).where("doc_id != component_id").select(F.col("doc_id").alias("__tm_gone")).distinct()
    gone = written(gone, "simhash-gone")  # so that its size is known to the join
    return docs.join(gone, docs[doc_id] == gone["__tm_gone"], "left_anti").select(*(docs[c] for c in docs.columns))
