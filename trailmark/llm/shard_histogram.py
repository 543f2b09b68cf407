"""Sharding by histogram sort.

Rows are ordered by (60 bits of the text's MD5, document id, serial number), which no two rows share. Candidate boundary keys
("probes") are counted exactly - rows and bytes below each - in one aggregation a round, and refined between the
nearest known keys until every boundary is settled. Only then does each row move, once, to its place.

Where a boundary falls is fixed by the rows alone, however it is found: the edge between two groups of equal texts
that is nearest to the byte target, if it is within tolerance; else the edge between two rows that is nearest. So a
group that is larger than a shard is cut, by document id and then by serial number, and stays whole otherwise.

The known probes also cut shards into cells, which are sorted in parallel; a cell that holds too many rows or bytes
gets more probes, so there are more cells the more there is to sort. The driver holds the counts of the probes.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .space import written

#: Bits of a key: the text's hash, the id, the serial number.
TEXT, ID, SERIAL = 60, 64, 64
FULL = 1 << (TEXT + ID + SERIAL)
GROUP = 1 << (ID + SERIAL)
DIGITS = (TEXT + ID + SERIAL) // 4
#: Rows and bytes from which a cell gets more probes; probes in an open interval in a round.
CELL_ROWS, CELL_BYTES, PROBES = 1 << 20, 1 << 29, 63
LEAST = -(1 << 63)


def text_hash(text: str) -> Column:
    """The first 60 bits of the text's MD5; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, TEXT // 4), 16, 10).cast("long"), F.lit(0).cast("long"))


def sort_key(h: Column, doc_id: Column, serial: Column) -> Column:
    """Hex digits that order like the three numbers."""
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.concat(hexed(h, TEXT // 4), hexed(doc_id.bitwiseXOR(F.lit(LEAST)), ID // 4), hexed(serial, SERIAL // 4))


def text_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _index(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: a binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    # trailing zeros say nothing: a shorter string is less than all that begin like it
    known = F.split(F.lit(",".join(f"{b:0{DIGITS}X}".rstrip("0") for b in bounds)), ",")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, s: Column) -> Column:
        there = F.get(known, at + s - 1)
        return F.when((at + s <= len(bounds)) & (there <= key), at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


class Histogram:
    """Exact rows and bytes below each probed key, and what numbers the keys between two of them are made of."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.keys, self.below = [0, FULL], {0: (0, 0), FULL: (n, total)}
        #: Of an interval of keys: the least interval that holds its rows.
        self.tight: dict[tuple[int, int], tuple[int, int]] = {}

    def probe(self, keys: set[int]) -> None:
        """Counts below the keys; the intervals between them get tight."""
        probes = sorted(keys - {0, FULL})
        sums = [F.count(F.lit(1)), F.sum("size"), *(f(c) for c in ("h", "id", "serial") for f in (F.min, F.max))]
        got = {r[0]: r[1:] for r in self.rows.groupBy(_index(F.col("key"), probes).alias("at")).agg(*sums).collect()}
        n = size = 0
        for i, (lo, hi) in enumerate(zip([0, *probes], [*probes, FULL])):
            self.below[lo] = (n, size)
            if i not in got:
                continue
            rows, in_bytes, *ends = got[i]
            n, size = n + rows, size + in_bytes
            least = most = 0
            for a, b, bits, shift in zip(ends[::2], ends[1::2], (TEXT, ID, SERIAL), (0, -LEAST, 0)):
                if least == most:
                    least, most = least << bits | a + shift, most << bits | b + shift
                else:
                    least, most = least << bits, most << bits | (1 << bits) - 1
            self.tight[lo, hi] = (least, most + 1)
        self.keys = sorted(self.below)

    def between(self, lo: int, hi: int) -> tuple[int, int]:
        """Rows and bytes."""
        return self.below[hi][0] - self.below[lo][0], self.below[hi][1] - self.below[lo][1]

    def around(self, target: float) -> tuple[int, int]:
        """The last known key with at most `target` bytes below it, and the one after it."""
        i = bisect_right(self.keys, target, key=lambda k: self.below[k][1])
        i = min(max(i, 1), len(self.keys) - 1)
        return self.keys[i - 1], self.keys[i]

    def cuts(self, lo: int, hi: int, n: int) -> set[int]:
        """lo, hi and up to n keys between them, between groups of equal texts while there is more than one."""
        first, end = self.tight.get((lo, hi), (lo, hi))
        unit = next(u for u in (GROUP, 1 << SERIAL, 1) if first // u != (end - 1) // u or u == 1)
        first, last = first // unit, (end - 1) // unit
        found = {(first + (last - first) * i // (n + 1)) * unit for i in range(1, n + 1)} | {(first + 1) * unit, last * unit}
        return {lo, hi} | {k for k in found if lo < k < hi}

    def nearest(self, target: float, slack: float) -> tuple[int | None, set[int]]:
        """The boundary for a target, or else the probes that are still needed."""
        lo, hi = self.around(target)
        if (lo, hi) not in self.tight:
            return None, self.cuts(lo, hi, PROBES)
        first, end = self.tight[lo, hi]
        if first // GROUP != (end - 1) // GROUP:
            return None, self.cuts(lo, hi, PROBES)
        # what lies between lo and hi is of one group; its edges first
        edges = []
        for edge, outer in ((first // GROUP * GROUP, lo), ((first // GROUP + 1) * GROUP, hi)):
            if (outer <= edge) == (outer == lo):
                self.below.setdefault(edge, self.below[outer])
            if edge not in self.below:
                return None, {lo, hi, edge}
            edges.append(edge)
        self.keys = sorted(self.below)
        self.tight[max(lo, edges[0]), min(hi, edges[1])] = first, end
        by_distance = lambda k: abs(self.below[k][1] - target)
        if by_distance(best := min(edges, key=by_distance)) <= slack:
            return best, set()
        if self.between(lo, hi)[0] == 1:
            return min((lo, hi), key=by_distance), set()
        return None, self.cuts(lo, hi, PROBES)


def plan(rows: DataFrame, shards: int, tolerance: float, cell_rows: int, cell_bytes: int) -> tuple[list[int], list[int], Histogram]:
    """Boundaries of the shards and of all cells (which include them). rows: key, size, h, id, serial."""
    hist = Histogram(rows)
    n, total = hist.below[FULL]
    if n == 0:
        return [], [], hist
    cells = max(64 * shards, 4 * n // cell_rows, 4 * total // cell_bytes)
    hist.probe({((1 << TEXT) * i // cells) * GROUP for i in range(1, cells)})
    while True:  # every round cuts what is open by 16 at least, so that the bits of a key end it
        probes: set[int] = set()
        chosen = []
        for i in range(1, shards):
            found, wanted = hist.nearest(total * i / shards, tolerance * total / shards)
            probes |= wanted
            chosen.append(found)
        for lo, hi in zip(hist.keys, hist.keys[1:]):
            in_rows, in_bytes = hist.between(lo, hi)
            if in_rows > 1 and (in_rows > cell_rows or in_bytes > cell_bytes):
                probes |= hist.cuts(lo, hi, 15)
        if not probes:
            return chosen, [k for k in hist.keys if 0 < k < FULL], hist
        hist.probe(probes)


def shard(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.005, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES, carry: list[str] | None = None) -> DataFrame:
    """All rows of docs with their columns (or those that `carry` names), and: shard_size long, shard int, slot long (gapless from 0 in each shard).

    Null texts have size 1, like empty ones; null ids sort first. Repeated rows are told apart by a serial number, so
    they are cut between shards like any others. An empty table gives an empty one. Columns of docs that are named
    like the new ones keep their values under their name with `_before` added.
    """
    taken = {"shard_size", "shard", "slot"} & {*docs.columns}
    own = docs.withColumnsRenamed({c: f"{c}_before" for c in taken})
    text, doc_id = (f"{c}_before" if c in taken else c for c in (text, doc_id))
    kept = [f"{c}_before" if c in taken else c for c in carry or docs.columns]
    # the serial number must be the same in every pass, so it is written
    parts = {"__tm_h": text_hash(text), "__tm_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)), "__tm_serial": F.monotonically_increasing_id()}
    keyed = written(own.withColumns(parts | {"shard_size": text_size(text)}).select(*kept, *parts, "shard_size"), "shard-keyed")
    keyed = keyed.withColumn("__tm_key", sort_key(*map(F.col, parts)))
    rows = keyed.select(F.col("__tm_key").alias("key"), F.col("shard_size").alias("size"), *(F.col(p).alias(c) for p, c in zip(parts, ("h", "id", "serial"))))
    splits, cells, hist = plan(rows, shards, tolerance, cell_rows, cell_bytes)
    starts = [0, *cells]
    shard_of = [bisect_right(splits, k) for k in starts]
    first = {s: hist.below[splits[s - 1] if s else 0][0] for s in set(shard_of)}
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",")
    cell = F.col("__tm_cell")
    placed = keyed.withColumn("__tm_cell", _index(F.col("__tm_key"), cells))
    order = Window.partitionBy("__tm_cell").orderBy("__tm_key")
    offset = F.get(literal([hist.below[k][0] - first[s] for k, s in zip(starts, shard_of)]), cell).cast("long")
    return placed.withColumns({"shard": F.get(literal(shard_of), cell).cast("int"), "slot": offset + F.row_number().over(order) - 1}).drop("__tm_key", "__tm_cell", *parts)
