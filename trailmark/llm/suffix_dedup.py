"""Exact substring dedup: bytes covered by a string of `length` bytes that starts in an earlier document too.

1. Documents are packed into chunks of some megabytes, which all later steps read.
2. Every window of `length` bytes has an anchor: its k-gram of least hash. Equal windows have equal anchors at equal
   places, so only windows whose anchor occurs in two documents can repeat. Anchors are counted by hash shard.
3. For each anchor that repeats, the windows around it form a context of under twice the length. A chunk sends each
   distinct context once, with the smallest id that has it. Very frequent anchors send single windows instead, by the
   window's hash, so that no shard gets a context for each document.
4. A shard sorts the suffixes of its contexts by induced sorting; runs of windows that share `length` bytes with the
   one before (the permuted common prefixes) are equal, and each run's smallest id goes back to the chunks.
5. Each chunk marks, removes and hashes.

Texts are never shuffled. What a shard holds grows with repeated text divided by the number of shards, which grows
with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .induced_sort import common_with_previous, suffix_array
from .exchange import LEAST, Records
from .files import mapped_file, put, there
from .repeats import chunks, heads, repeated_keys, to_chunks
from .space import work_folder, written

U = B.U
CHUNK = 8 << 20
#: Window starts that are looked at together; occurrences from which an anchor sends single windows.
STARTS, FREQUENT = 1 << 19, 20000
#: Shards of contexts, in bits: of up to half a GB, and as many as one exchange deals to.
SHARD_BITS, SHARD_FAN = 9, 12
#: Bits by which a shard's answers are cut at once.
ANSWER_FAN = 8
LAST = np.iinfo(np.int64).max


def packed(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """chunk, ids (binary, int64; a null id comes after all others), has_id (binary, bool), ends (binary, int64), bytes."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 24, 0
        held, size = [], 0

        def chunk():
            ids = np.concatenate([i for i, _, _, _ in held])
            known = np.concatenate([k for _, k, _, _ in held])
            ends = np.cumsum(np.concatenate([np.diff(o) for _, _, _, o in held]))
            raw = np.concatenate([d for _, _, d, _ in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([first + n]), pa.array([ids.tobytes()]), pa.array([known.tobytes()]), pa.array([ends.tobytes()]), pa.array([raw.tobytes()], pa.binary())], ["chunk", "ids", "has_id", "ends", "bytes"]
            )

        for batch in batches:
            for rows, data, offsets in B.pieces(batch):
                ids = rows.column("doc_id")
                held.append((ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), data, offsets))
                size += len(data)
                if size >= chunk_bytes:
                    yield chunk()
                    held, size, n = [], 0, n + 1
        if held:
            yield chunk()

    return docs.mapInArrow(run, "chunk long, ids binary, has_id binary, ends binary, bytes binary")


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Key of each anchor, the first window start that has it, and the number of starts in a row that do."""
    found = []
    n, width = len(data), length - k + 1
    for lo in range(0, n, STARTS):
        hi = min(n, lo + STARTS + length - 1)
        if hi - lo < length:
            continue
        power, unpower = B.powers(hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(B._BYTE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        h = B.mix64((total[k:] - total[:-k]) * unpower[: hi - lo - k + 1])
        least = (h & ~U((1 << 21) - 1)) | np.arange(len(h), dtype=U)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        ok = np.arange(lo, lo + len(least)) + length <= _room(offsets, lo, lo + len(least))
        new = ok.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = ok.copy()
        stop[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
        # a window of the next text never continues one: between them are starts without room
        # least hashes crowd at small values; mixed once more, they spread evenly over the shards
        key = B.mix64(h[(least[first] & U((1 << 21) - 1)).astype(np.int64)])
        found.append((key, lo + first, np.flatnonzero(stop) - first + 1))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _room(offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """End of the text of each place from lo to hi."""
    return np.repeat(offsets[1:], np.diff(np.clip(offsets, lo, hi)))


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, k: int = 20, chunk_bytes: int = CHUNK, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for each row of docs.

    Null and empty texts have no bytes. Rows that share an id count as one document: none is earlier than another. A
    row without an id comes after all others. Texts that are shorter than `length` stay whole.
    """
    folder = work_folder(docs.sparkSession, "suffix")
    packs = written(packed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), chunk_bytes), "suffix-chunks")
    n_chunks = packs.count()

    def anchor_keys(ids, offsets, data):
        h, first, _ = anchors(data, offsets, length, k)
        return h, ids[np.searchsorted(offsets, first, "right") - 1]

    repeated_keys(packs, anchor_keys, n_chunks * (chunk_bytes // 16), folder, frequent)
    # suffix sorting takes some dozens of bytes for each byte of context
    bits = max(SHARD_BITS, (n_chunks * 4 * chunk_bytes // CHUNK).bit_length())
    contexts = Records(bits, SHARD_FAN, chunk="<i8", number="<u4", key="<u8", owner="<i8", size="|u1" if length <= 128 else "<u4", raw="*|u1")
    # a shard of contexts answers to every chunk: few cuts, so that its rows do not become tiny and many
    spans = Records(max(LEAST, int(n_chunks).bit_length()), ANSWER_FAN, chunk="<i8", number="<u4", size="<u2", sizes="*<u2", ids="*<i8")

    # contexts of those anchors
    def send_contexts(batches):
        for chunk, ids, _, offsets, data in chunks(batches):
            if not there(folder, f"repeats-{chunk}"):
                continue
            stored = mapped_file(folder, f"repeats-{chunk}")
            h, first, n = anchors(data, offsets, length, k)
            hit = B.among(h, stored["keys"])
            h, first, n = h[hit], first[hit], n[hit]
            often = stored["often"][np.searchsorted(stored["keys"], h)] > 0
            single = B.owners(np.concatenate([[0], np.cumsum(n[often])]))
            inner = np.arange(len(single)) - (np.cumsum(n[often]) - n[often])[single]
            starts = np.concatenate([first[~often], first[often][single] + inner])
            sizes = np.concatenate([n[~often] + length - 1, np.full(len(single), length)])
            order = np.argsort(starts, kind="stable")
            whole = np.empty(len(starts), U)
            whole[order] = _hash_any(data, starts[order], starts[order] + sizes[order])
            route = np.concatenate([h[~often], B.mix64(whole[len(h) - int(often.sum()) :])])
            owner = ids[np.searchsorted(offsets, starts, "right") - 1]
            order = np.lexsort((owner, sizes, whole))
            first = heads(whole[order], sizes[order])
            number = np.empty(len(order), np.int32)
            number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            put(folder, f"places-{chunk}", {"start": starts.astype(np.int32), "context": number})
            pick = order[first]
            raw = B.gather(data, starts[pick], sizes[pick])
            yield from contexts.rows(route[pick], np.full(len(pick), chunk), np.arange(len(pick)), whole[pick], owner[pick], sizes[pick], raw)

    def answer(table: pa.Table) -> pa.Table:
        _, chunk, context_of, keys, ids, sizes, raw = contexts.read(table)
        sizes = sizes.astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((ids, sizes, keys))
        new = heads(keys[order], sizes[order])
        number = np.empty(len(keys), np.int64)
        number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
        pick = order[new]  # each distinct context, with its smallest id
        size, own = sizes[pick], ids[pick]
        # UTF-8 has no bytes over 0xF7, so 1 between contexts and 0 at the end are free after adding 2
        at = np.cumsum(size + 1) - size - 1
        joined = np.ones(int((size + 1).sum()) + 1, np.uint8)
        joined[-1] = 0
        joined[B.inside(at, size)] = B.gather(raw, begin[pick], size) + 2
        n_windows = size - length + 1
        starts = np.zeros(len(joined), bool)
        starts[B.inside(at, n_windows)] = True
        window, same = common_with_previous(joined, suffix_array(joined, length), starts, length)
        context = np.searchsorted(at, window, "right") - 1
        head = np.flatnonzero(~same)
        least = np.minimum.reduceat(own[context], head) if len(head) else own[:0]
        of_start = np.empty(len(joined), np.int64)
        of_start[window] = np.repeat(least, np.diff(np.append(head, len(window))))
        # windows of a context in runs of one smallest id
        flat = B.inside(at, n_windows)
        value, owner = of_start[flat], np.repeat(np.arange(len(size)), n_windows)
        run = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        run_owner = owner[run]
        run_of = np.searchsorted(run_owner, np.arange(len(size) + 1))
        run_size = np.diff(np.append(run, len(value)))
        n = run_of[number + 1] - run_of[number]
        r = B.inside(run_of[number], n)
        B.trim()
        return spans.table(B.mix64(chunk.view(U)), chunk, context_of, n, run_size[r], value[run][r])

    sent = packs.mapInArrow(send_contexts, contexts.schema)
    to_chunks(contexts.grouped(sent).applyInArrow(answer, spans.schema), spans, folder, "answers", lambda c: np.argsort(c[0]))

    def remove(batches):
        for chunk, ids, has_id, offsets, data in chunks(batches):
            gone = np.zeros(len(data), bool)
            if there(folder, f"answers-{chunk}"):
                places, stored = mapped_file(folder, f"places-{chunk}"), mapped_file(folder, f"answers-{chunk}")
                run_of = np.concatenate([[0], np.cumsum(stored["size"], dtype=np.int64)])
                before = np.concatenate([[0], np.cumsum(stored["sizes"], dtype=np.int64)])
                start, context = places["start"].astype(np.int64), places["context"].astype(np.int64)
                owner = ids[np.searchsorted(offsets, start, "right") - 1]
                n = run_of[context + 1] - run_of[context]
                occurrence = np.repeat(np.arange(len(start)), n)
                run = B.inside(run_of[context], n)
                first = start[occurrence] + before[run] - before[run_of[context]][occurrence]
                earlier = stored["ids"][run] < owner[occurrence]
                first, size = first[earlier], stored["sizes"][run][earlier].astype(np.int64)
                gone = B.covered(first, first + size + length - 1, len(data))
            first, end = B.spans(gone, offsets)
            of = B.bounds(first, offsets)
            removed = B.sums(end - first, of)
            kept = data[~gone]
            ends = offsets - np.concatenate([[0], np.cumsum(removed)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=~has_id),
                    pa.array(np.diff(offsets)),
                    pa.array(removed),
                    pa.array(np.diff(of)),
                    pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(kept)]).cast(pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return packs.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _hash_any(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash for spans whose starts rise but whose ends may not."""
    reach = np.maximum.accumulate(end) if len(end) else end
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + B.PIECE, "left")))
        hi = int(reach[j - 1])
        power, unpower = B.powers(hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(B._BYTE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = B.mix64((total[e] - total[s]) * unpower[s])
        i = j
    return out
