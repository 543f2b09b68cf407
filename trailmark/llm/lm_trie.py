"""Language-model scores from an n-gram trie in Elias-Fano form.

Level 1 holds the hashes of all training words as monotone sequences (cut into shards by hash), with counts and
quantised probabilities; a word's id is its rank. Level 2 holds, for every word, monotone pointers to its range of
successors, and the successors' ids relative to the end of the range before, so that the whole level is one monotone
sequence: (context, word) is found by one successor search. Level 3 holds the same for every pair of level 2: its
pointers are of the pairs' places, so that the search for a pair also gives the place where its triples are.

Probabilities are those of absolute discounting, interpolated from level to level. A level stores the discounted part
of each n-gram and, for each context, the weight of the level below. Every n-gram of the training rows is stored.
Contexts that hold very many tokens are cut between shards by the successor's id.

Counting is distributed: tasks send sorted, counted keys; the shard's task merges them and writes its level to the
shared folder. Scoring tasks map these files; they share the page cache and need no memory of their own for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .elias_fano import EliasFano
from .exchange import Records
from .files import mapped_file, put, there
from .repeats import heads
from .space import work_folder

U = B.U
END = U(0x5DEECE66D1CE4E5B)
NONE = np.uint32(0xFFFFFFFF)
DISCOUNT, STEP = 0.75, 0.05
#: Probability of each code.
VALUE = 10.0 ** (-STEP * np.arange(256))
#: Tokens that a task counts together; tokens that a shard of pairs stands for; bytes of text at once.
HELD, SHARD_TOKENS, PIECE = 5 << 19, 1 << 21, 1 << 22
#: Bytes of text whose words are a shard of level 1.
SHARD_TEXT = 64 << 20


def _under(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def _of(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k.removeprefix(f"{prefix}."): v for k, v in arrays.items() if k.startswith(f"{prefix}.")}


# --- counting


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = heads(keys)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def merged_triples(pair: np.ndarray, third: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, third), sorted, and their summed counts (without counts: how many they are). Under 2^32 of them."""
    order = np.argsort(pair)
    pair = pair[order]
    first = heads(pair)
    known = pair[first]
    del pair
    keys = np.repeat(np.arange(len(first), dtype=U) << U(32), np.diff(np.append(first, len(order))))
    keys |= third[order]
    if counts is None:
        del order
        keys.sort()
        first = heads(keys)
        n = np.diff(np.append(first, len(keys)))
        keys = keys[first]
    else:
        counts = counts[order]
        del order
        keys, n = merged(keys, counts)
    return known[(keys >> U(32)).astype(np.int64)], keys.astype(np.uint32), n


def gathered(batches, take) -> Iterator[list[np.ndarray]]:
    """The arrays that take(bytes, offsets) makes of pieces of text, put together to HELD tokens or more."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for _, data, offsets in B.pieces(batch, PIECE):
            held.append(take(data, offsets))
            size += len(held[-1][0])
            if size >= HELD:
                # the pieces go before what is made of them is worked on
                whole = [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
                yield whole
                del whole
                B.trim()
    if held:
        whole = [np.concatenate(x) for x in zip(*held)]
        del held
        yield whole


# --- tokens


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's lower-case words and its end, and the bounds of the texts."""
    low = B.LOWER[data]
    start, end = B.spans(B.IN_WORD[low], offsets)
    of = B.bounds(start, offsets)
    docs = np.arange(len(of) - 1)
    out = np.full(len(start) + len(docs), END, U)
    out[np.arange(len(start)) + B.owners(of)] = B.span_hash(low, start, end)
    return out, of + np.arange(len(of))


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 255).astype(np.uint8)


def token_pairs(hashes: np.ndarray, of: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the place of its word among the distinct words, these words' ids, and (word before << 32 | word);
    before a text's first word stands the end."""
    known, back = np.unique(hashes, return_inverse=True)
    ids = model.ids(known)
    now = ids[back].astype(U)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[of[:-1]] = ids[np.searchsorted(known, END)]
    return back, ids, before << U(32) | now


# --- the model


class Model:
    """The trie's files, mapped when first needed."""

    def __init__(self, folder: str, bits: int, offsets: list[int], total: int, split: dict[int, float] | None = None):
        self.folder, self.bits, self.offsets, self.total = folder, bits, np.array(offsets, np.int64), total
        self.words = int(self.offsets[-1])
        #: Contexts that are cut between shards, and their weights of the level below.
        self.split = split or {}
        self.open_: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"open_": {}}

    @property
    def starts(self) -> np.ndarray:
        """Least (context << 32 | word) of each shard of pairs."""
        if "starts" not in self.open_:
            self.open_["starts"] = mapped_file(self.folder, "shards")["starts"]
        return self.open_["starts"]

    def level1(self, r: int):
        if ("v", r) not in self.open_:
            a = mapped_file(self.folder, f"words-{r}")
            self.open_["v", r] = (EliasFano.load(_of("hash", a)), a)
        return self.open_["v", r]

    def grams(self, s: int):
        """None for a shard without pairs, which is only a part of a cut context."""
        if ("g", s) not in self.open_:
            if not there(self.folder, f"grams-{s}"):
                return None
            a = mapped_file(self.folder, f"grams-{s}")
            self.open_["g", s] = (*(EliasFano.load(_of(x, a)) for x in ("pointer", "word", "pointer3", "word3")), a)
        return self.open_["g", s]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted, distinct hashes; NONE for unknown words."""
        out = np.full(len(hashes), NONE, np.uint32)
        shard = (hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(shard, np.arange(len(self.offsets)))
        for r in np.unique(shard):
            if self.offsets[r] == self.offsets[r + 1]:
                continue
            ef, _ = self.level1(r)
            x = _within(hashes[cut[r] : cut[r + 1]], self.bits)
            at = ef.successor(x)
            hit = np.flatnonzero(at < ef.n)
            hit = hit[ef.get(at[hit]) == x[hit]]
            out[cut[r] + hit] = (self.offsets[r] + at[hit]).astype(np.uint32)
        return out

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and probability code of sorted ids; the unknown have count 0."""
        n = np.zeros(len(ids), np.int64)
        codes = np.full(len(ids), code(np.array([self.p(0)]))[0])
        cut = np.searchsorted(ids, self.offsets)
        for r in range(len(self.offsets) - 1):
            if cut[r] == cut[r + 1]:
                continue
            _, a = self.level1(r)
            at = ids[cut[r] : cut[r + 1]].astype(np.int64) - self.offsets[r]
            small = a["count"][at].astype(np.int64)
            big = small == 255
            small[big] = a["many"][np.searchsorted(a["many_at"], at[big])]
            n[cut[r] : cut[r + 1]] = small
            codes[cut[r] : cut[r + 1]] = a["code"][at]
        return n, codes

    def p(self, count):
        return (np.asarray(count, float) + 0.1) / (self.total + 0.1 * (self.words + 1))

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted, distinct (context << 32 | word): probability of the stored pair (0: not stored), weight of the
        level below, and the pair's place in its shard or -1."""
        p, rest, place = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), -1, np.int64)
        for s, lo, hi in self.by_shard(keys):
            pointer, word, _, _, a = self.grams(s)
            first, n = map(int, a["contexts"])
            x = keys[lo:hi]
            context = (x >> U(32)).astype(np.int64) - first
            at = np.flatnonzero(context < n)
            rest[lo + at] = VALUE[a["rest"][context[at]]]
            found, where = _successors(pointer, word, context[at], x[at] & U(0xFFFFFFFF))
            p[lo + at[found]] = VALUE[a["code"][where]]
            place[lo + at[found]] = where
        for context, left in self.split.items():
            a, b = np.searchsorted(keys, [U(context << 32), U((context + 1) << 32)])
            rest[a:b] = left
        return p, rest, place

    def by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Shards with pairs that sorted keys fall into, with their ranges of the keys."""
        shard = np.searchsorted(self.starts, keys, "right") - 1
        first = heads(shard)
        for lo, hi in zip(first, np.append(first[1:], len(keys))):
            if shard[lo] >= 0 and self.grams(int(shard[lo])):
                yield int(shard[lo]), int(lo), int(hi)

    def triples(self, pairs: np.ndarray, place: np.ndarray, context: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pairs, place: sorted pairs and what pairs() says of them. For each (context: which of the pairs, third), by
        context: probability of the stored triple (0: not stored), and weight of the level below."""
        p, rest = np.zeros(len(context)), np.ones(len(context))
        for s, lo, hi in self.by_shard(pairs):
            a, b = np.searchsorted(context, [lo, hi])
            if a == b:
                continue
            _, _, pointer, word, arrays = self.grams(s)
            at = a + np.flatnonzero(place[context[a:b]] >= 0)
            j = place[context[at]]
            rest[at] = VALUE[arrays["rest3"][j]]
            found, where = _successors(pointer, word, j, third[at].astype(U))
            p[at[found]] = VALUE[arrays["code3"][where]]
        return p, rest


def _successors(pointer: EliasFano, word: EliasFano, context: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted words are among their context's successors, and the places of these. Contexts rise."""
    first = heads(context)
    each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    lo, hi = pointer.get(context[first]).astype(np.int64), pointer.get(context[first] + 1).astype(np.int64)
    base = np.zeros(len(first), U)
    later = np.flatnonzero((lo > 0) & (lo < hi))
    base[later] = word.get(lo[later] - 1) + U(1)
    place = word.find(lo[each], hi[each], base[each] + wanted)
    hit = np.flatnonzero(place >= 0)
    return hit, place[hit]


def _level(prefix: str, first: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
    """Pointers and relative successors; context i has word[first[i]:first[i + 1]], which rise."""
    some = np.flatnonzero(np.diff(first))
    size = np.diff(first)[some]
    ends = first[1:][some] - 1
    base = np.concatenate([[0], np.cumsum(word[ends].astype(np.int64) + 1)])[:-1]
    value = word.astype(np.int64) + np.repeat(base, size)
    return _under(f"pointer{prefix}", EliasFano.build(first.astype(U), len(word) + 1)) | _under(f"word{prefix}", EliasFano.build(value.astype(U), int(value[-1]) + 1 if len(value) else 1))


def _within(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The part of a hash that the number of its shard does not say."""
    return hashes & U((1 << (64 - bits)) - 1)


def train(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Model:
    """A model of the texts of docs (column text). An empty table gives a model without words."""
    spark = docs.sparkSession
    folder = work_folder(spark, "lm")
    texts = docs.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(1, (size // SHARD_TEXT).bit_length())
    counted = Records(bits, n="<u4")

    def words(batches):
        for (hashes,) in gathered(batches, lambda *x: tokens(*x)[:1]):
            yield from counted.rows(*(x for x in np.unique(hashes, return_counts=True)))

    def level1(table: pa.Table) -> pa.Table:
        r = table.column("shard")[0].as_py()
        keys, counts = merged(*counted.read(table))
        big = counts >= 255
        hashes = _under("hash", EliasFano.build(_within(keys, bits), 1 << (64 - bits)))
        put(folder, f"counts-{r}", {"count": np.minimum(counts, 255).astype(np.uint8), "many_at": np.flatnonzero(big), "many": counts[big]} | hashes)
        hot = np.flatnonzero(counts > shard_tokens)
        return pa.table({"shard": [r], "words": [len(keys)], "mass": [int(counts.sum())], "hot": pa.array([hot.tolist()], pa.list_(pa.int64())), "hot_mass": pa.array([counts[hot].tolist()], pa.list_(pa.int64()))})

    sent = counted.grouped(texts.mapInArrow(words, counted.schema))
    summary = sent.applyInArrow(level1, "shard long, words long, mass long, hot array<long>, hot_mass array<long>").collect()
    by = {row["shard"]: row for row in summary}
    sizes = [by[r]["words"] if r in by else 0 for r in range(1 << bits)]
    model = Model(folder, bits, [0, *np.cumsum(sizes).tolist()], sum(row["mass"] for row in summary))
    if model.words >= int(NONE):
        raise OverflowError("word ids have 32 bits, and there are more distinct words")
    _finish_level1(spark, model, sorted(by))

    # shards of pairs: even parts of a word shard's ids, and of a hot context's successors
    starts, split = [], []
    for r in sorted(by):
        first, n = int(model.offsets[r]), by[r]["words"]
        hot = sorted((first + i, m) for i, m in zip(by[r]["hot"], by[r]["hot_mass"]))
        rest = by[r]["mass"] - sum(m for _, m in hot)
        parts = max(1, -(-rest // shard_tokens))
        cuts = {(first + n * i // parts, 0) for i in range(parts)}
        for c, m in hot:
            k = min(-(-m // shard_tokens), model.words)
            cuts |= {(c, model.words * i // k) for i in range(k)} | ({(c + 1, 0)} if c + 1 < first + n else set())
            split.append(c)
        starts += sorted(cuts)
    put(folder, "shards", {"starts": np.array([c << 32 | w for c, w in starts], U), "last": np.array([*(c for c, _ in starts[1:]), model.words], np.int64)})
    bits2 = max(1, len(starts).bit_length())
    triples = Records(bits2, pair="+<u8", third="<u4", n="<u4")

    def taken(data, offsets):
        hashes, of = tokens(data, offsets)
        pair = token_pairs(hashes, of, model)[2]
        third = np.append((pair[1:] & U(0xFFFFFFFF)).astype(np.uint32), NONE)
        third[of[1:] - 1] = NONE  # nothing comes after a text's end
        return pair, third

    def send(batches):
        for held in gathered(batches, taken):
            pair, third, n = merged_triples(*held)
            held.clear()
            B.trim()
            shard = (np.searchsorted(model.starts, pair, "right") - 1).astype(U)
            shard <<= U(64 - bits2)
            yield from triples.rows(shard, pair, third, n)
            del pair, third, n, shard

    def levels(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        _, pair, third, n = triples.read(table)
        B.trim()
        return pa.table({c: pa.array(x, pa.list_(pa.int64())) for c, x in zip(("contexts", "successors"), write(s, *merged_triples(pair, third, n)))})

    def write(s: int, pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> tuple[list, list]:
        """The file of shard s; the split contexts in it, and how many successors they have here."""
        first = int(model.starts[s] >> U(32))
        contexts = max(int(mapped_file(folder, "shards")["last"][s]) - first, 1)
        at = heads(pair)
        of_pair = np.append(at, len(pair))
        count = np.add.reduceat(n, at) if len(at) else n
        context, word = (pair[at] >> U(32)).astype(np.int64) - first, (pair[at] & U(0xFFFFFFFF)).astype(np.int64)
        here = np.unique(context)
        seen = np.ones(contexts)
        seen[here] = np.maximum(model.counts((first + here).astype(np.uint32))[0], 1)
        successors = np.bincount(context, minlength=contexts)
        inner = third != NONE
        thirds = np.add.reduceat(inner.astype(np.int64), at) if len(at) else count
        pair_of = np.repeat(np.arange(len(at)), np.diff(of_pair))[inner]
        rest3 = np.where(thirds > 0, DISCOUNT * thirds / np.maximum(count, 1), 1.0)
        arrays = {"contexts": np.array([first, contexts]), "rest": code(np.where(successors > 0, DISCOUNT * successors / seen, 1.0)), "code": code((count - DISCOUNT) / seen[context])}
        arrays |= {"rest3": code(rest3), "code3": code((n[inner] - DISCOUNT) / count[pair_of])}
        arrays |= _level("", np.searchsorted(context, np.arange(contexts + 1)), word) | _level("3", np.append(0, np.cumsum(thirds)), third[inner])
        put(folder, f"grams-{s}", arrays)
        mine = [c for c in split if 0 <= c - first < contexts]
        return [mine], [[int(successors[c - first]) for c in mine]]

    done = triples.grouped(texts.mapInArrow(send, triples.schema)).applyInArrow(levels, "contexts array<long>, successors array<long>")
    found: dict[int, int] = {}
    for row in done.where(F.size("contexts") > 0).collect():
        for c, k in zip(row["contexts"], row["successors"]):
            found[c] = found.get(c, 0) + k
    mass = {int(model.offsets[r]) + i: m for r in by for i, m in zip(by[r]["hot"], by[r]["hot_mass"])}
    return Model(folder, bits, model.offsets.tolist(), model.total, {c: DISCOUNT * k / mass[c] for c, k in found.items()})


def _finish_level1(spark, model: Model, shards: list[int]) -> None:
    """The files of level 1 with their probability codes, which need the totals."""

    def finish(batches):
        for batch in batches:
            for r in batch.column("id").to_pylist():
                a = mapped_file(model.folder, f"counts-{r}")
                counts = a["count"].astype(np.int64)
                counts[a["many_at"]] = a["many"]
                put(model.folder, f"words-{r}", dict(a) | {"code": code(model.p(counts))})
            yield batch

    if shards:
        spark.createDataFrame([(r,) for r in shards], "id long").repartition(len(shards)).mapInArrow(finish, "id long").count()


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_piece(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, model: Model) -> pa.RecordBatch:
    hashes, of = tokens(data, offsets)
    back, ids, key = token_pairs(hashes, of, model)
    order = np.argsort(ids)
    n, own = np.empty(len(ids), np.int64), np.empty(len(ids), np.uint8)
    n[order], own[order] = model.counts(ids[order])
    pairs, of_pair = np.unique(key, return_inverse=True)
    p2, rest2, place = model.pairs(pairs)
    p = p2[of_pair] + rest2[of_pair] * VALUE[own][back]
    inner = np.ones(len(key), bool)
    inner[of[:-1]] = False  # the first of a text has one word before it, its end
    inner = np.flatnonzero(inner)
    triples, of_triple = np.unique(of_pair[inner - 1].astype(U) << U(32) | key[inner] & U(0xFFFFFFFF), return_inverse=True)
    p3, rest3 = model.triples(pairs, place, (triples >> U(32)).astype(np.int64), (triples & U(0xFFFFFFFF)).astype(np.uint32))
    p[inner] = p3[of_triple] + rest3[of_triple] * p[inner]
    sums = lambda x: np.add.reduceat(x, of[:-1])  # noqa: E731  every text has its end
    base = np.log10(model.p(n))
    columns = [
        rows.column("doc_id"),
        pa.array(np.diff(of)),
        pa.array(sums((n > 0)[back].astype(np.int64))),
        pa.array(np.full(len(of) - 1, model.total)),
        pa.array(sums(base[back])),
        pa.array(sums(np.log10(p))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 10; rows with 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 10


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """SCORES and held_out for each row of docs, by a model of the rows that are not held out.

    Null and empty texts have one token, their end. Rows with a null id are not held out. With nothing to learn from,
    every token has probability one of one word.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held_out = F.coalesce(fold() == 0, F.lit(False))
    model = train(narrow.where(~held_out), **how)
    out = narrow.mapInArrow(B.mapped(lambda *x: score_piece(*x, model), PIECE), SCORES)
    return out.withColumn("held_out", held_out)
