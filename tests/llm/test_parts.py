"""The parts that operators are made of, against plain versions of them."""

import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st

from trailmark.llm import bytesops as B
from trailmark.llm import decontaminate, quality_net
from trailmark.llm.elias_fano import EliasFano
from trailmark.llm.exchange import Records
from trailmark.llm.induced_sort import suffix_array
from trailmark.llm.lm_trie import merged_triples
from trailmark.llm.rules_forest import Forest
from trailmark.llm.simhash_gray import xxh64

U = np.uint64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=80), st.integers(0, 1 << 62))
def test_elias_fano(values, x):
    values = np.sort(np.array(values, U))
    ef = EliasFano.load(EliasFano.build(values, int(values[-1]) + 1 if len(values) else 1))
    assert (ef.get(np.arange(len(values))) == values).all()
    assert ef.successor(np.array([x], U))[0] == np.searchsorted(values, U(x))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120))
def test_suffix_array(letters):
    s = np.array([*letters, 0], np.uint8)
    raw = s.tobytes()
    assert suffix_array(s, 1 << 30).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=8))
def test_xxh64(parts):
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    assert xxh64(data, np.cumsum(sizes) - sizes, sizes).tolist() == [xxhash.xxh64_intdigest(p, seed=42) for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t", max_size=12), max_size=6))
def test_words_and_hashes(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end = B.spans(B.IN_WORD[data], offsets)
    words = [w for r in raw for w in r.split()]
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == words
    assert np.diff(B.bounds(start, offsets)).tolist() == [len(r.split()) for r in raw]
    h = B.span_hash(data, start, end)
    assert len(set(h.tolist())) == len(set(words))


def test_forest_isolates_what_is_far_off():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    forest = Forest(x, 50, 64, 0)
    scores = forest.score(np.array([[0.0, 0.0], [9.0, -9.0]]))
    assert scores[1] > 0.6 > 0.55 > scores[0]


def peak_of(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_values_are_gathered_without_a_place_for_each():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 255, 8 << 20).astype(np.uint8)
    start = rng.integers(0, len(values) - 200, 100_000)
    size = rng.integers(0, 200, len(start)).astype(np.uint8)
    records = Records(4, size="|u1", raw="*|u1")
    raw = values[B.inside(start, size)]
    assert np.array_equal(B.gather(values, start, size), raw)
    at = rng.permutation(len(start))
    taken = []
    peak = peak_of(lambda: taken.extend(records.take([size, raw], at)))
    assert np.array_equal(taken[1], raw[B.inside((np.cumsum(size, dtype=np.int64) - size)[at], size[at])])
    assert peak < 6 * len(raw)


def test_tiny_rows_are_cut_again_without_an_object_each():
    rng = np.random.default_rng(6)
    records = Records(9, fan=8, chunk="<i8", size="<u2", ids="*<i8")
    sent = []
    for _ in range(100):
        chunk = rng.integers(0, 500, 400)
        size = rng.integers(0, 3, len(chunk))
        sent += records.rows(B.mix64(chunk.astype(np.uint64)), chunk, size, rng.integers(0, 99, int(size.sum())))
    out = []
    peak = peak_of(lambda: out.extend(records._cut_again(9)(iter(sent))))
    assert sum(b.num_rows for b in sent) > 15_000
    assert sum(b.num_rows for b in out) < 513
    together = lambda batches: sorted(zip(*(x.tolist() for x in records.read(pa.Table.from_batches(batches))[:3])))
    assert together(out) == together(sent)
    for batch in out:
        for i in range(batch.num_rows):
            assert {int(r) >> 55 for r in records.read(batch.slice(i, 1))[0]} == {batch.column(0)[i].as_py()}
    assert peak < 1 << 20


def test_rows_come_in_bounded_batches():
    rng = np.random.default_rng(7)
    records = Records(7, key="+<u8", size="|u1", raw="*|u1")
    key = np.sort(rng.integers(0, 1 << 63, 3 << 19).astype(U))
    size = rng.integers(0, 3, len(key)).astype(np.uint8)
    raw = rng.integers(0, 255, int(size.sum())).astype(np.uint8)
    expected = [key << U(1), key, size, raw]
    mixed = rng.permutation(len(key))
    for order in (np.arange(len(key)), mixed):
        batches = list(records.rows((key << U(1))[order], *records.take([key, size, raw], order)))
        counts = [len(records.read(b)[0]) for b in batches]
        assert max(counts) <= (1 << 19) + len(key) // 100 and sum(counts) == len(key)
        read = records.read(pa.Table.from_batches(batches))
        assert all(np.array_equal(a, b) for a, b in zip(read, expected))


def test_triples_are_merged_in_little_memory():
    rng = np.random.default_rng(8)
    pair = rng.integers(0, 300, 1 << 19).astype(U) << U(32)
    third = rng.integers(0, 900, len(pair)).astype(np.uint32)
    found = []
    peak = peak_of(lambda: found.extend(merged_triples(pair, third)))
    keys, n = np.unique(pair | third, return_counts=True)
    assert np.array_equal(found[0] | found[1], keys) and np.array_equal(found[2], n)
    assert all(np.array_equal(a, b) for a, b in zip(found, merged_triples(pair, third, np.ones(len(pair), np.uint8))))
    assert peak < 36 * len(pair)


def test_quality_brings_one_sum_of_word_vectors_to_the_driver(spark, monkeypatch):
    texts = [" ".join(f"w{i * j % 37}" for j in range(i % 50 + 1)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    kind, came = type(docs), []
    collect = kind.collect

    def noted(self):
        out = collect(self)
        came.append(sum(len(v) for r in out for v in r if isinstance(v, (bytes, bytearray))))
        return out

    monkeypatch.setattr(kind, "collect", noted)
    vectors, _ = quality_net.trained(docs, marks)
    whole = quality_net.BUCKETS * quality_net.DIM * 4
    assert whole <= sum(came) < 1.5 * whole  # with one for each task: 8 times as much
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1]
    index, into = quality_net.index_vectors(), np.zeros((quality_net.BUCKETS, quality_net.DIM))
    raw = [t.encode() for t in learned]
    quality_net.contexts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), index, into)
    assert np.allclose(vectors, index + 0.5 * into / np.maximum(np.linalg.norm(into, axis=1, keepdims=True), 1e-6), atol=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÉé9世 .", max_size=150), max_size=8))
@example(["世" * 21 + "a " + "世" * 21 + "aa " + "世" * 40 + " " + "世" * 41 + "É a", "世" * 40 + " é"])
def test_equal_words_alone_have_equal_hashes(texts):
    raw = [t.encode() for t in texts]
    low = decontaminate.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    plain = [t.lower().replace(".", " ").split() for t in texts]
    flat = [w for t in plain for w in t]
    assert low[1].tolist() == np.cumsum([0, *map(len, plain)]).tolist()
    assert len(low[0]) == len(flat) and len(set(zip(flat, low[0].tolist()))) == len(set(flat)) == len(set(low[0].tolist()))


def test_words_are_hashed_without_a_sum_over_all_bytes():
    text = " ".join(f"word{i * 7919 % 5000} and then{i % 90}" for i in range(50000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])

    def summed():
        low = B.LOWER[data]
        return B.span_hash(low, *B.spans(decontaminate.LETTER[low], offsets))

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: decontaminate.words(data, offsets)) < 0.6 * least(summed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, (1 << 63) - 1)), max_size=60))
def test_keys_are_sorted_with_their_order(values):
    key = np.array(values, np.int64)
    found, order = B.sorted_with_order(key)
    assert order.tolist() == np.argsort(key, kind="stable").tolist() and found.tolist() == sorted(values)
