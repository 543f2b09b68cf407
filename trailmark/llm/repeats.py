"""Keys that occur in two documents or more, found without sending a row for each key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from .exchange import Records, bits_for
from .files import put

U = B.U


def chunks(batches):
    """(chunk, ids, has_id, offsets, data) of each row of suffix_dedup.packed()."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = batch.column(0)[i].as_py()
            ids, known, ends, data = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((1, np.int64), (2, bool), (3, np.int64), (4, np.uint8)))
            yield chunk, ids, known, np.concatenate([[0], ends]), data
            B.trim()


def heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins in any of the arrays."""
    n = len(sorted_[0])
    return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in sorted_], axis=0))) if n else np.zeros(0, np.int64)


def to_chunks(answers: DataFrame, records: Records, folder: str, name: str, order: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> None:
    """Writes records that are routed by mix64(chunk), and have the chunk first, as one file <name>-<chunk> for each
    chunk. order: of a chunk's columns, the order of its records."""

    def store(table: pa.Table) -> pa.Table:
        columns = records.read(table)[1:]
        by = np.argsort(columns[0], kind="stable")
        first = heads(columns[0][by])
        for part in np.split(by, first[1:]):
            chunk, *rest = records.take(columns, part)
            if order:
                _, *rest = records.take([chunk, *rest], order(rest))
            put(folder, f"{name}-{chunk[0]}", dict(zip([*records.kinds][1:], rest)))
        return pa.table({"chunks": pa.array([len(first)], pa.int64())})

    records.grouped(answers).applyInArrow(store, "chunks long").count()


def repeated_keys(packs: DataFrame, keys_of, n_keys: int, folder: str, frequent: int) -> None:
    """Writes repeats-<chunk>: the sorted keys of that chunk that two documents have (in whichever chunk), and which
    occur `frequent` times or more. Chunks without any get no file. keys_of(ids, offsets, data): keys, their ids."""
    counts = Records(bits_for(n_keys), chunk="<i8", n="<u4")
    found = Records(bits_for(n_keys), chunk="<i8", keys="<u8", often="|u1")

    def count(batches):
        for chunk, ids, _, offsets, data in chunks(batches):
            h, owner = keys_of(ids, offsets, data)
            if not len(h):
                continue
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            at = heads(h)
            n = np.diff(np.append(at, len(h)))
            many = np.append(False, (h[1:] == h[:-1]) & (owner[1:] != owner[:-1]))
            # 1: in one document; else occurrences, 2 at least
            n = np.where(np.add.reduceat(many, at) > 0, np.maximum(n, 2), 1)
            yield from counts.rows(h[at], np.full(len(at), chunk), n)

    def repeats(table: pa.Table) -> pa.Table:
        h, chunk, n = counts.read(table)
        order = np.argsort(h)
        at = heads(h[order])
        total = np.add.reduceat(n[order].astype(np.int64), at)
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(at, len(h))))
        again = np.flatnonzero(back > 1)
        return found.table(B.mix64(chunk[again].view(U)), chunk[again], h[again], back[again] >= frequent)

    again = counts.grouped(packs.mapInArrow(count, counts.schema)).applyInArrow(repeats, found.schema)
    to_chunks(again, found, folder, "repeats", lambda c: np.argsort(c[0]))
