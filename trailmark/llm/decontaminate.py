"""Benchmark decontamination by latent semantic retrieval.

The space is TF-IDF over the rarer words of the benchmark. Its axes come from a randomised SVD: in each round every task
multiplies its passages' matrix into the current basis and back, the parts are summed, and the basis is made
orthogonal again. The SVD is fitted on all benchmark passages and the passages of all documents, which document
frequencies and the search cover too. Passages - overlapping
windows of words - whose cosine with a benchmark passage is high enough are candidates; the words of a candidate's
surroundings must then hold a long enough common subsequence with the benchmark passage, within twice its length, and
its answer, if it has one, which also finds paraphrases that keep most words in order.

The axes hold less of a passage the more passages there are, so candidates come by a second, exact way too: what holds
`common` of a passage's n words must hold some of its rarest ones, of which at least AGREE stand close together. No
place of up to n words that holds enough of them in order is missed, whatever the axes say.

The benchmark is the query set. Its passages are with every task, so it is taken in blocks of at most BLOCK_BYTES of
text, one pass over the documents each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

U = B.U
#: Words of a block; blocks of a passage; axes; share of a benchmark passage's words that must follow in order.
BLOCK, PER_PASSAGE, AXES, COSINE, COMMON = 16, 3, 128, 0.35, 0.6
#: IDF of a word in a twentieth of the documents, from which on a word is a term; terms that each passage has anyway.
RARE, RAREST = float(np.log(20)), 24
#: Words of a passage's rarest that must stand together in a place that holds enough of the passage.
AGREE = 4
#: Bytes of a block of the benchmark.
BLOCK_BYTES = 8 << 20
#: Rows that are summed together, and of how many at most at once; passages that are projected together; words whose
#: parts, one of each task, are summed in one place.
TOGETHER, AT_ONCE, SLAB, SUMMED = 2048, 64, 1 << 14, 64
LETTER = ((B.BYTES >= 0x30) & (B.BYTES <= 0x39)) | ((B.BYTES >= 0x61) & (B.BYTES <= 0x7A)) | (B.BYTES >= 0x80)
ANSWER = re.compile(r"(?:^|\s)(?:answer|a)\s*:\s*(.+)$", re.I | re.S)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.lowered(data)
    start, end = B.spans(B.translated(low, LETTER).view(bool), offsets)
    return B.short_hash(low, start, end), B.bounds(start, offsets)


def hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def summed(values: np.ndarray, at: np.ndarray, weight: np.ndarray | None, size: np.ndarray) -> np.ndarray:
    """Row i: the sum of the next size[i] of values[at], each times its weight, if there are weights."""
    parts = -(-size // AT_ONCE)
    if (parts > 1).any():
        owner = np.repeat(np.arange(len(size)), parts)
        before = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * AT_ONCE
        part = summed(values, at, weight, np.minimum(size[owner] - before, AT_ONCE))
        return summed(part, np.arange(len(part)), None, parts)
    # rows of many entries first: the j-th entries of some thousand rows are added at once, within the cache
    out = np.empty((len(size), values.shape[1]), np.float32)
    head, by = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    room = np.empty((min(TOGETHER, len(size)), values.shape[1]), np.float32)
    for lo in range(0, len(by), TOGETHER):
        rows = by[lo : lo + TOGETHER]
        first, least = head[rows], -size[rows]
        total = np.zeros((len(rows), values.shape[1]), np.float32)
        for j, n in enumerate(np.searchsorted(least, -np.arange(-int(least[0]))).tolist()):
            place = first[:n] + j
            step = np.take(values, at[place], axis=0, out=room[:n], mode="clip")
            if weight is not None:
                step *= weight[place, None]
            total[:n] += step
        out[rows] = total
    return out


class Space:
    """The benchmark's passages, its words with their IDF, and the axes."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, hashes(t), hashes(m[1]) if (m := ANSWER.search(t)) else np.zeros(0, U)) for i, t in items]
        self.items = [x for x in self.items if len(x[1])]
        self.known = np.unique(np.concatenate([h for _, h, _ in self.items])) if self.items else np.zeros(0, U)
        if self.items:
            # by its first bits, a word is found at once, but where several known ones begin with them
            bits = min(20, len(self.known).bit_length() + 4)
            self.shift = U(64 - bits)
            first = np.searchsorted(self.known, np.arange(1 << bits, dtype=U) << self.shift)
            self.bucket = np.minimum(first, len(self.known) - 1).astype(np.int32)
            self.crowded = np.diff(first, append=len(self.known)) > 1
        #: The items' words and their answers' by their numbers among the known.
        self.numbers = [(np.searchsorted(self.known, own), np.searchsorted(self.known, answer)) for _, own, answer in self.items]
        self.index(np.ones(len(self.known)))
        self.axes = np.zeros((len(self.known), 0), np.float32)

    def queries(self) -> np.ndarray:
        """The benchmark passages on the axes, each of length 1 (0 where none of its words is on an axis)."""
        x = np.zeros((len(self.items), self.axes.shape[1]), np.float32)
        rows, found = self.project(*self.matrix([h for _, h, _ in self.items]), self.axes, 0)
        x[rows] = found
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scaled_axes(self) -> np.ndarray:
        """The axes times IDF."""
        return self.axes * self.idf[:, None].astype(np.float32)

    def index(self, idf: np.ndarray) -> None:
        """Takes as terms the words of few documents, and of each benchmark passage its rarest whatever they are."""
        use = idf >= RARE
        for _, h, _ in self.items:
            word = np.unique(np.searchsorted(self.known, h))
            use[word[np.argsort(-idf[word], kind="stable")[:RAREST]]] = True
        self.terms, self.idf = self.known[use], idf[use]
        self.term_of = np.where(use, np.cumsum(use) - 1, -1)
        self.rarity = idf

    def post(self, common: float) -> None:
        """Takes down in which items a word is one of the rarest: of n words, n - need + agree, as the other words
        are too few for need, the words that must be there."""
        posts, agree = [], []
        for i, (_, own, _) in enumerate(self.items):
            word = np.searchsorted(self.known, own)
            need = max(int(np.ceil(common * len(own))), 1)
            agree.append(min(AGREE, need))
            rarest = np.unique(word[np.argsort(-self.rarity[word], kind="stable")[: len(own) - need + agree[-1]]])
            posts.append(np.stack([rarest, np.full(len(rarest), i)]))
        word, item = np.concatenate(posts, axis=1)
        order = np.argsort(word, kind="stable")
        self.posted, self.agree = item[order], np.array(agree)
        self.post_at = np.searchsorted(word[order], np.arange(len(self.known) + 1))
        self.sizes = np.array([len(h) for _, h, _ in self.items])

    def seen(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of known words, and their numbers."""
        bucket = (h >> self.shift).view(np.int64)
        number = self.bucket.take(bucket, mode="clip")
        rest = np.flatnonzero(self.crowded.take(bucket, mode="clip"))
        number[rest] = np.minimum(np.searchsorted(self.known, h[rest]), len(self.known) - 1)
        at = np.flatnonzero(self.known.take(number, mode="clip") == h)
        return at, number[at].astype(np.int64)

    def together(self, h: np.ndarray, of: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and place in h wherever enough of an item's rarest words begin to stand together. at, word: what
        seen() gives."""
        n = np.diff(self.post_at)[word]
        hit = np.repeat(np.arange(len(at)), n)
        item = self.posted[self.post_at[word][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
        item, place = np.divmod(np.sort(item * (len(h) + 1) + at[hit]), len(h) + 1)
        last = np.arange(len(item)) + self.agree[item] - 1
        k = np.flatnonzero(last < len(item))
        last, doc = last[k], np.searchsorted(of, place, "right") - 1
        near = (item[last] == item[k]) & (doc[last] == doc[k]) & (place[last] - place[k] < self.sizes[item[k]] + BLOCK * PER_PASSAGE)
        k = k[near]
        return doc[k], item[k], place[k]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """Passages of each text: PER_PASSAGE blocks of BLOCK words, which overlap in all but a block."""
        n = np.diff(of)
        return np.where(n > 0, np.maximum(-(-n // BLOCK) - PER_PASSAGE + 1, 1), 0)

    def entries(self, of: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, term and how often it is there, of the terms `word` at the places `at`."""
        count = self.counts(of)
        first = np.cumsum(count) - count
        doc = B.owners(of)[at]
        block = (at - of[doc]) // BLOCK
        keys = []
        for back in range(PER_PASSAGE):
            p = block - back
            ok = (p >= 0) & (p < count[doc])
            keys.append((first[doc[ok]] + p[ok]) * max(len(self.terms), 1) + word[ok])
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        return *np.divmod(key, max(len(self.terms), 1)), tf

    def passages(self, h: np.ndarray, of: np.ndarray):
        """For runs of texts, one by one what Passages has in blocks: entries (passage, word, weight) of the TF-IDF
        matrix, and each passage's text and first word."""
        at = np.flatnonzero(B.among(h, self.terms))
        passage, word, tf = self.entries(of, at, np.searchsorted(self.terms, h[at]))
        first = np.append(0, np.cumsum(self.counts(of)))
        text = B.owners(first)
        return passage, word, (1 + np.log(tf)) * self.idf[word], text, of[text] + (np.arange(first[-1]) - first[text]) * BLOCK

    def matrix(self, hashes_: list[np.ndarray]):
        of = np.concatenate([[0], np.cumsum([len(h) for h in hashes_])])
        h, owner = np.concatenate(hashes_), B.owners(of)
        at = np.flatnonzero(B.among(h, self.terms))
        key, tf = np.unique(owner[at] * len(self.terms) + np.searchsorted(self.terms, h[at]), return_counts=True)
        row, word = np.divmod(key, len(self.terms))
        return row, word, (1 + np.log(tf)) * self.idf[word]

    def project(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, basis: np.ndarray, rows: int):
        """The rows with entries, and their coordinates divided by their lengths in the whole space."""
        if not len(row):
            return row, np.zeros((0, basis.shape[1]), np.float32)
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(head, len(row)))
        x = summed(basis, word, weight.astype(np.float32), size)
        length = np.sqrt(np.add.reduceat(weight * weight, head))
        return row[head], x / length[:, None].astype(np.float32)


class Passages:
    """The passages of runs of texts on axes. A passage is the sum of its blocks, so a word is taken once for its block
    and not for each passage; only for words that a passage has more than once, there is something to set right."""

    def __init__(self, space: Space, of: np.ndarray, at: np.ndarray, number: np.ndarray):
        """at, number: what space.seen() gives."""
        word = space.term_of[number]
        at, word = at[word >= 0], word[word >= 0]
        count = space.counts(of)
        first = np.append(0, np.cumsum(count))
        self.text = B.owners(first)
        nth = np.arange(first[-1]) - first[self.text]
        self.begin = of[self.text] + nth * BLOCK
        # a text has blocks for all that its passages hold, full or not
        blocks = np.where(count > 0, count + PER_PASSAGE - 1, 0)
        base = np.cumsum(blocks) - blocks
        self.from_block = base[self.text] + nth
        doc = B.owners(of)[at]
        self.block, self.word = base[doc] + (at - of[doc]) // BLOCK, word
        end = int(blocks.sum())
        key, order = B.sorted_with_order(word * (end + PER_PASSAGE) + self.block)
        close = np.diff(key) < PER_PASSAGE
        again = np.zeros(len(at), bool)
        again[order[1:][close]] = again[order[:-1][close]] = True
        passage, word, tf = space.entries(of, at[again], word[again])
        many = tf > 1
        self.passage, self.again, tf = passage[many], word[many], tf[many]
        self.less = (1 + np.log(tf) - tf).astype(np.float32)
        square = np.bincount(self.block, space.idf[self.word] ** 2, minlength=end)
        more = ((1 + np.log(tf)) ** 2 - tf) * space.idf[self.again] ** 2
        total = np.bincount(self.passage, more, minlength=first[-1]).astype(float)
        for j in range(PER_PASSAGE):
            total += square[self.from_block + j]
        # a passage without terms is zero on all axes
        self.length = np.sqrt(np.where(total > 0, total, np.inf)).astype(np.float32)[:, None]

    def projected(self, basis: np.ndarray):
        """Slabs: their passages' coordinates divided by their lengths in the whole space, and where the slab is: its
        passages, words, words that are there again, and first block of each passage and of all. basis: times IDF."""
        for lo in range(0, len(self.text), SLAB):
            own = slice(lo, min(lo + SLAB, len(self.text)))
            g, end = self.from_block[lo], self.from_block[own.stop - 1] + PER_PASSAGE
            words_ = slice(*np.searchsorted(self.block, [g, end]))
            more = slice(*np.searchsorted(self.passage, [lo, own.stop]))
            y = summed(basis, self.word[words_], None, np.bincount(self.block[words_] - g, minlength=end - g))
            block = self.from_block[own] - g
            n = len(y) - PER_PASSAGE + 1
            x = y[:n].copy()
            for j in range(1, PER_PASSAGE):
                x += y[j : n + j]
            x = x[block] if n > len(block) else x
            row, size = np.unique(self.passage[more] - lo, return_counts=True)
            x[row] += summed(basis, self.again[more], self.less[more], size)
            x /= self.length[own]
            yield x, own, words_, more, block, g

    def add_back_projected(self, basis: np.ndarray, total: np.ndarray) -> None:
        """Adds A' A basis, its rows divided by IDF, for the passages' matrix A, its rows scaled to length 1. basis:
        times IDF."""
        for x, own, words_, more, block, g in self.projected(basis):
            x /= self.length[own]
            n = block[-1] + 1
            y = np.zeros((n + PER_PASSAGE - 1, x.shape[1]), np.float32)
            spread = x
            if n > len(block):
                spread = np.zeros((n, x.shape[1]), np.float32)
                spread[block] = x
            for j in range(PER_PASSAGE):
                y[j : n + j] += spread
            for values, at, word, weight in ((y, self.block[words_] - g, self.word[words_], None), (x, self.passage[more] - own.start, self.again[more], self.less[more])):
                order = np.argsort(word.astype(np.min_scalar_type(len(total))), kind="stable")
                size = np.bincount(word, minlength=len(total))
                row = np.flatnonzero(size)
                total[row] += summed(values, at[order], None if weight is None else weight[order], size[row])


def back_projected(space: Space, row: np.ndarray, word: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis for the rows' matrix A, its rows scaled to length 1."""
    rows, x = space.project(row, word, weight, basis, 0)
    out = np.zeros(basis.shape, np.float32)
    if not len(rows):
        return out
    length = np.sqrt(np.add.reduceat(weight * weight, np.flatnonzero(np.append(True, row[1:] != row[:-1]))))
    place = np.searchsorted(rows, row)
    for lo in range(0, len(row), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        order = np.argsort(word[part], kind="stable")
        w = word[part][order]
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        scaled = x[place[part][order]] * (weight[part] / length[place[part]])[order, None].astype(np.float32)
        out[w[head]] += np.add.reduceat(scaled, head, axis=0)
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about block_bytes of text, by a hash of the item."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [benchmark]


def fitted(docs: DataFrame, benchmark: DataFrame, axes: int = AXES, rounds: int = 2) -> Space:
    """docs: doc_id, text. benchmark: item_id, text; its rows are the query set and come to the driver."""
    rows = benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").collect()
    space = Space([(r[0], r[1]) for r in rows])
    if not space.items:
        return space
    known = space.known

    def count(rows, data, offsets):
        h, of = words(data, offsets)
        at, word = space.seen(h)
        pairs = np.unique(B.owners(of)[at] * len(known) + word)
        n = np.bincount(pairs % len(known), minlength=len(known))
        word = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(np.append(word, -1)), pa.array(np.append(n[word], rows.num_rows))], ["word", "n"])

    counted = dict(docs.select("text").mapInArrow(B.mapped(count), "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    df = np.array([counted.get(i, 0) for i in range(len(known))])
    space.index(np.log((counted.get(-1, 0) + 1) / (df + 1)) + 0.05)

    queries = space.matrix([h for _, h, _ in space.items])
    basis = np.random.default_rng(2).normal(size=(len(space.terms), min(axes, len(space.terms)))).astype(np.float32)
    for _ in range(rounds):
        now = basis

        def multiply(batches):
            idf = space.idf[:, None].astype(np.float32)
            total, scaled = np.zeros(now.shape, np.float32), now * idf
            for batch in batches:
                for _, data, offsets in B.pieces(batch):
                    h, of = words(data, offsets)
                    Passages(space, of, *space.seen(h)).add_back_projected(scaled, total)
            total *= idf
            for lo in range(0, len(total), SUMMED):
                if total[lo : lo + SUMMED].any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([total[lo : lo + SUMMED].tobytes()], pa.binary())], ["first", "part"])

        def add(table: pa.Table) -> pa.Table:
            # in order, so that the sum and with it the axes agree between runs
            parts = sorted(x.as_py() for x in table.column("part"))
            total = np.zeros(len(parts[0]) // 4)
            for x in parts:
                total += np.frombuffer(x, np.float32)
            total = total.astype(np.float32)
            return pa.table({"first": [table.column("first")[0].as_py()], "part": pa.array([total.tobytes()], pa.binary())})

        # the corpus is scaled to the benchmark, whose passages must be told apart
        corpus = np.zeros(now.shape, np.float32)
        for first, part in docs.select("text").mapInArrow(multiply, "first long, part binary").groupBy("first").applyInArrow(add, "first long, part binary").collect():
            corpus[first : first + SUMMED] = np.frombuffer(bytes(part), np.float32).reshape(-1, now.shape[1])
        scale = len(space.items) / max(1.0, float(counted.get(-1, 0)) * 30)
        basis = np.linalg.qr(back_projected(space, *queries, now) + scale * corpus)[0].astype(np.float32)
    space.axes = basis
    return space


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := places.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def leaks_in(space: Space, q: np.ndarray, axes: np.ndarray, data: np.ndarray, offsets: np.ndarray, cosine: float, common: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, share, first word, end word) of each place. q: space.queries(); axes: space.scaled_axes()."""
    h, of = words(data, offsets)
    at, word = space.seen(h)
    passages = Passages(space, of, at, word)
    best: dict[tuple[int, int], list[int]] = {}
    for x, own, *_ in passages.projected(axes):
        for lo in range(0, len(x), 4096):
            near, item = np.nonzero(x[lo : lo + 4096] @ q.T >= cosine)
            near += own.start + lo
            for doc, begin, i in zip(passages.text[near].tolist(), passages.begin[near].tolist(), item.tolist()):
                best.setdefault((doc, i), []).append(begin)
    out = []
    known, number = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    known[at], number[at] = True, word
    here = np.zeros(len(space.known), bool)

    def look(doc: int, i: int, lo: int, hi: int) -> bool:
        item, (own, answer) = space.items[i][0], space.numbers[i]
        need = int(np.ceil(common * len(own)))
        around = slice(max(int(of[doc]), lo - len(own)), min(int(of[doc + 1]), hi + len(own)))
        place = np.flatnonzero(known[around])
        words_ = number[around][place]
        here[words_] = True
        enough = len(words_) >= need and np.count_nonzero(here[own]) >= need
        here[words_] = False
        if not enough or common_in_order(own, words_) < need:
            return False
        # in a wide place, common words alone may follow in order; any place of the passage's length lies in one of these
        n = 0
        for first in range(0, max(1, around.stop - around.start - len(own)), len(own)):
            a, b = np.searchsorted(place, [first, first + 2 * len(own)])
            n = max(n, common_in_order(own, words_[a:b]) if b - a >= need else 0)
        if n < need or len(answer) and common_in_order(answer, words_) < len(answer):
            return False
        out.append((doc, item, n / len(own), lo - int(of[doc]), hi - int(of[doc])))
        return True

    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (doc, i), starts in best.items():
        lo = hi = -1
        for s in sorted(starts) + [1 << 62]:
            if lo >= 0 and s > hi:
                if look(doc, i, lo, hi):
                    held.setdefault((doc, i), []).append((lo, hi))
                lo = -1
            if lo < 0:
                lo = s
            hi = s + BLOCK * PER_PASSAGE
    # the exact way; a run of places is cut after an item's length, so that what is looked through stays short
    run = (-1, -1, 0, 0)
    for doc, i, s in [*zip(*(x.tolist() for x in space.together(h, of, at, word))), (-1, -1, 0)]:
        if run[:2] == (doc, i) and s <= run[2] + len(space.items[i][1]):
            run = (doc, i, run[2], s + BLOCK * PER_PASSAGE)
            continue
        if run[0] >= 0 and look(*run):
            held.setdefault(run[:2], []).append(run[2:])
        n = len(space.items[i][1])
        found_already = any(a - n <= s < b + n for a, b in held.get((doc, i), []))
        run = (-1, -1, 0, 0) if found_already else (doc, i, s, s + BLOCK * PER_PASSAGE)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", cosine: float = COSINE, common: float = COMMON, block_bytes: int = BLOCK_BYTES, **fit) -> DataFrame:
    """doc_id, item_id, share (of the passage's words that follow in order), first_word and end_word of the place, for
    each document and benchmark passage that it holds.

    Null and empty texts hold none; an empty benchmark, or passages without words, are held by none. Repeated rows
    give repeated results.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, share double, first_word long, end_word long"
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def found(space: Space) -> DataFrame:
        queries, axes = space.queries(), space.scaled_axes()
        space.post(common)

        def run(rows, data, offsets):
            columns = list(zip(*leaks_in(space, queries, axes, data, offsets, cosine, common))) or [[]] * 5
            at, *rest = (pa.array(c, t) for c, t in zip(columns, kinds))
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), *rest], ["doc_id", "item_id", "share", "first_word", "end_word"])

        return narrow.mapInArrow(B.mapped(run), schema)

    out = docs.sparkSession.createDataFrame([], schema)
    spaces = [fitted(narrow, block, **fit) for block in benchmark_blocks(benchmark, block_bytes)]
    for i, rows in enumerate(found(space) for space in spaces if space.items):
        out = rows if i == 0 else out.union(rows)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", cosine: float = COSINE, common: float = COMMON, block_bytes: int = BLOCK_BYTES, **fit) -> DataFrame:
    """The rows of docs whose text holds no benchmark passage, in one pass over the texts for each block of the
    benchmark. Null and empty texts stay."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def clean(space: Space):
        queries, axes = space.queries(), space.scaled_axes()
        space.post(common)

        def keep(data, offsets):
            ok = np.ones(len(offsets) - 1, bool)
            for place in leaks_in(space, queries, axes, data, offsets, cosine, common):
                ok[place[0]] = False
            return ok

        return keep

    spaces = [fitted(narrow, block, **fit) for block in benchmark_blocks(benchmark, block_bytes)]
    for space in spaces:
        if space.items:
            docs = docs.mapInArrow(B.filtered(clean(space), text), docs.schema)
    return docs
