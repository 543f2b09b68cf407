"""Exchange of many small records between Python tasks, packed by the thousand.

A record is a route (64 bits, which say where it goes) and some numbers. A task sorts its records by route and cuts
them by the route's upper bits; the records of one cut are one row: columns of bytes, routes as differences. A cut is
by FAN bits at most, so a task sends as many rows for its megabytes whatever the size of the input. Where more shards
are needed, rows are dealt by the bits so far, gathered in bounded memory, and cut again by the next bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import bytesops as B

U = B.U
#: Bits that one exchange cuts by at most; bytes that a task gathers before it cuts again; bits that say a shard, at
#: least; records that a shard should hold; records of a batch of rows, beside those of its last row.
FAN, GATHERED, LEAST, RECORDS, TOGETHER = 10, 64 << 20, 7, 1 << 21, 1 << 19


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance, which the shuffle's compression then gets small."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""


def plain(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def bits_for(records: int) -> int:
    return max(LEAST, (records // RECORDS).bit_length())


class Records:
    """Records of a route and the columns that `kinds` names, by numpy type. A type that begins with * is that of a
    column with several values a record: as many as the column `size` says. One that begins with + is that of a column
    that mostly rises, and is packed as differences."""

    def __init__(self, bits: int, fan: int = FAN, **kinds: str):
        self.bits, self.fan, self.kinds = bits, fan, kinds
        self.schema = "shard long, route binary" + "".join(f", {c} binary" for c in kinds)

    def take(self, columns: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        """The columns of the records `at`."""
        many = [k[0] == "*" for k in self.kinds.values()]
        if not any(many):
            return [c[at] for c in columns]
        size = columns[[*self.kinds].index("size")].astype(np.int64)
        first, size = (np.cumsum(size) - size)[at], size[at]
        return [B.gather(c, first, size) if m else c[at] for c, m in zip(columns, many)]

    def rows(self, route: np.ndarray, *columns: np.ndarray, bits: int | None = None) -> Iterator[pa.RecordBatch]:
        """The rows of these records, cut by the first bits."""
        if not len(route):
            return
        bits = min(self.bits, self.fan) if bits is None else bits
        columns = list(columns)
        if (route[1:] < route[:-1]).any():
            order = np.argsort(route, kind="stable")
            route, columns = route[order], self.take(columns, order)
            del order
        shard = route >> U(64 - bits)
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        shard = shard[first].astype(np.int64)
        cut = np.append(first, len(route))
        sizes = dict(zip(self.kinds, columns)).get("size")
        if sizes is not None:
            sizes = np.append(0, np.cumsum(sizes, dtype=np.int64))
        # a batch is sent whole, and is then in the memory of both sides
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + TOGETHER, "right")) - 1)
            yield self._packed(shard[lo:hi], cut[lo : hi + 1], route, columns, sizes)
            lo = hi

    def _packed(self, shard: np.ndarray, cut: np.ndarray, route: np.ndarray, columns: list[np.ndarray], sizes: np.ndarray | None) -> pa.RecordBatch:
        """One row for the records between each two places of cut."""
        packed = [pa.array([planes(np.diff(route[a:b], prepend=U(0))) for a, b in zip(cut, cut[1:])], pa.binary())]
        for c, k in zip(columns, self.kinds.values(), strict=True):
            kind = k.lstrip("*+")
            if k[0] == "+":
                parts = (np.ascontiguousarray(c[a:b], kind) for a, b in zip(cut, cut[1:]))
                packed.append(pa.array([planes(np.diff(x, prepend=x.dtype.type(0))) for x in parts], pa.binary()))
            elif k[0] == "*":
                at = sizes[cut]
                packed.append(pa.array([pa.compress(planes(np.ascontiguousarray(c[a:b], kind)), "zstd", asbytes=True) for a, b in zip(at, at[1:])], pa.binary()))
            else:
                packed.append(pa.array([planes(np.ascontiguousarray(c[a:b], kind)) for a, b in zip(cut, cut[1:])], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(shard), *packed], ["shard", "route", *self.kinds])

    def table(self, route: np.ndarray, *columns: np.ndarray) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("route", *self.kinds))])
        return pa.Table.from_batches(self.rows(route, *columns), schema)

    def read(self, table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        """Route and columns of all the rows' records."""
        out = [[np.cumsum(plain(x.as_py(), "<u8"), dtype=U) for x in table.column("route")]]
        sizes: list[int] = []
        for c, k in self.kinds.items():
            if k[0] == "*":
                k = k[1:]
                raw = [pa.decompress(x.as_py(), n * np.dtype(k).itemsize, "zstd", asbytes=True) if n else b"" for x, n in zip(table.column(c), sizes)]
                out.append([plain(x, k) for x in raw])
            elif k[0] == "+":
                out.append([np.cumsum(plain(x.as_py(), k[1:]), dtype=k[1:]) for x in table.column(c)])
            else:
                out.append([plain(x.as_py(), k) for x in table.column(c)])
            if c == "size":
                sizes = [int(x.sum()) for x in out[-1]]
        return [np.concatenate(x) if x else np.zeros(0, k.lstrip("*+")) for x, k in zip(out, ["<u8", *self.kinds.values()])]

    def unpacked(self, table: pa.Table) -> np.ndarray:
        """Bytes that each row's records take when they are read."""
        n = pc.binary_length(table.column("route")).to_numpy().astype(np.int64) // 8
        out = 8 * n
        for k in self.kinds.values():
            if k[0] != "*":
                out = out + np.dtype(k.lstrip("+")).itemsize * n
        many = sum(np.dtype(k[1:]).itemsize for k in self.kinds.values() if k[0] == "*")
        if many:
            out = out + many * np.array([int(plain(x.as_py(), self.kinds["size"]).sum(dtype=np.int64)) for x in table.column("size")], np.int64)
        return out

    def _cut_again(self, bits: int):
        def run(batches):
            held: list[pa.RecordBatch] = []
            size = 0

            def out():
                # rows may be tiny: none is an object of its own
                table = pa.Table.from_batches(held)
                shard = table.column("shard").to_numpy()
                order = np.argsort(shard, kind="stable")
                turn = self.unpacked(table)[order]
                turn = (np.cumsum(turn) - turn) // GATHERED
                # rows may be packed a hundredfold: what is read at once is bounded by what it takes then
                for part in np.split(order, np.flatnonzero((np.diff(shard[order]) != 0) | (np.diff(turn) != 0)) + 1):
                    yield from self.rows(*self.read(table.take(part)), bits=bits)
                B.trim()

            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size > GATHERED:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

        return run

    def grouped(self, sent: DataFrame) -> GroupedData:
        """Rows that rows() made, grouped by shards of `bits` bits."""
        have = min(self.bits, self.fan)
        while have < self.bits:
            have = min(self.bits, have + self.fan)
            parts = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << (self.bits - self.fan))
            # a hot shard is gathered by many tasks
            dealt = sent.repartition(parts, F.col("shard"), F.pmod(F.xxhash64("route"), F.lit(-(-parts // (1 << self.fan)))))
            sent = dealt.mapInArrow(self._cut_again(have), self.schema)
        return sent.groupBy("shard")
