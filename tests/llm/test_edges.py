"""Every operator on null, empty and very long texts, repeated rows, ties, clashing columns and empty tables."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import compact_windows, decontaminate, license_index, lm_trie, mix_pivotal, quality_net, rules_forest, shard_histogram, simhash_gray, suffix_dedup
from trailmark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, key long, size long, chunk long, row string, copies int, h string"
PASSAGE = " ".join(f"wort{i * 7 % 61} höhe{i % 13}" for i in range(40))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows():
    rng = np.random.default_rng(0)
    free = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    texts = {
        0: None,
        1: "",
        2: " \t\n\r\x0b\x0c ",
        3: "One",
        4: "Two words",
        5: free(30) + "\n" + PASSAGE + "\n" + free(20),
        6: PASSAGE + " " + free(60),
        7: free(60000),
        8: "x" * 100_000,
        9: "same same " * 40,
        10: "Released under the MIT License.\nLine\nLine\n\nLine All Rights\tReserved, cc-by; General PUBLIC license",
        11: PASSAGE.upper(),
        12: "a b   c \U0001f600 \x00 d",
        13: "£££ ### $$$ %%% &&& " * 12,
    }
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 2, 3, 4, 5, "r", 6, "h") for i, t in texts.items()]
    out += [out[5], (20, texts[5], *out[5][2:]), (21, texts[6], *out[6][2:]), (None, texts[4], *out[4][2:])]
    return out + [(100 + i, free(50 + i), "en", "s1", 0, 1, 2, 3, 4, 5, "r", 6, "h") for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 13 and i != 9), 0) for i in [*range(14), *range(100, 130)]], "doc_id long, quality int, toxic int")


def test_shard(docs, empty):
    found = shard_histogram.shard(docs, shards=4).collect()
    assert sorted(r.shard_size for r in found) == sorted(len((t or "").encode()) + 1 for _, t, *_ in rows())
    slots = Counter()
    for r in found:
        slots[r.shard] += 1
    assert set(slots) <= set(range(4))
    for s, n in slots.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    assert shard_histogram.shard(empty).collect() == []


def test_shards_are_even_although_one_text_has_most_rows(spark):
    hot = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'the same text' ELSE repeat('b', cast(id % 50 AS int)) END AS text")
    got = shard_histogram.shard(hot, shards=8).groupBy("shard").sum("shard_size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)
    again = shard_histogram.shard(hot, shards=8).groupBy("shard").sum("shard_size").collect()
    assert sorted(got) == sorted(again)


def test_equal_rows_are_spread_over_shards_and_columns_keep_their_values(spark, docs):
    same = spark.range(20000).selectExpr("CAST(7 AS long) AS doc_id", "'one text' AS text")
    got = {r.shard: (r.n, r.most) for r in shard_histogram.shard(same, shards=4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("most")).collect()}
    assert got == {s: (5000, 4999) for s in range(4)}
    out = shard_histogram.shard(docs, shards=4, cell_rows=3, cell_bytes=1000)
    assert {*docs.columns} - {"shard", "slot"} | {"shard_before", "slot_before", "shard_size", "shard", "slot"} == {*out.columns}
    assert {r.shard_before for r in out.collect()} == {1}
    fine = {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    assert fine == {(r.doc_id, r.shard, r.slot) for r in shard_histogram.shard(docs, shards=4).collect()}


def test_equal_rows_are_dealt_to_blocks_of_the_mix(spark):
    units = spark.range(3000).selectExpr("'s' AS source", "CAST(1 AS long) AS row", "CAST(10 AS long) AS size", "0.5D AS f")
    taken = mix_pivotal.copies(units, block=64).groupBy("copies").count().collect()
    assert {r.copies: r["count"] for r in taken} == {0: 1500, 1: 1500}
    level = spark.read.parquet(max(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/trailmark/mix-level1-*"), key=os.path.getmtime))
    assert max(r["count"] for r in level.groupBy("class", "salt").count().collect()) < 2 * 64


def test_mix(docs, empty):
    found = mix_pivotal.mix(docs).collect()
    assert len(found) == len(rows())
    by = {}
    for r in found:
        assert r.size == {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}[r.doc_id]
        assert 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in found)
    assert abs(sum(g[0].target for g in by.values()) - 1.5 * total) < 1e-6 * total
    for g in by.values():
        size = sum(r.size for r in g)
        assert g[0].source_size == size and g[0].target <= 2 * size + 1e-6
        assert abs(sum(r.copies * r.size for r in g) - g[0].target) <= max(r.size for r in g)
    key = lambda r: (r.doc_id is None, r.doc_id, r.copies)
    assert sorted(found, key=key) == sorted(mix_pivotal.mix(docs).collect(), key=key)
    assert mix_pivotal.mix(empty).collect() == []
    assert set(mix_pivotal.mixed_rows(docs).columns) == set(docs.columns)


def test_targets_are_shared_as_the_rule_says(spark):
    sizes = {"a": 100, "b": 1, "c": 1000, "d": 50, None: 10}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    got = {r.source: r.target for r in mix_pivotal.source_targets(sized).collect()}
    assert got == pytest.approx(target)


def brute_rules(t):
    w = WORD.findall(t or "")
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    twice = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def test_rules(docs, empty, labels):
    want = {i: brute_rules(t) for i, t, *_ in rows()}
    for r in rules_forest.judged(docs, labels).collect():
        n, *_, again = want[r.doc_id]
        assert tuple(r[c] for c in rules_forest.COUNTS) == want[r.doc_id]
        assert r.base_failed == (n < 20 or 100 * again > 30 * n)
        assert not (r.base_failed and r.kept)
    assert rules_forest.judged(empty, labels).collect() == []
    assert rules_forest.judged(docs, labels.limit(0)).count() == len(rows())


def test_language_model(docs, empty):
    one, two, three = Counter(), Counter(), Counter()
    size = {}
    for i, t, *_ in rows():
        ws = [*WORD.findall(lower(t or "")), None]
        size[i] = ws
        if i is None or zlib.crc32(str(i).encode()) % 10:
            one.update(ws)
            two.update(zip([None, *ws], ws))
            three.update(zip([None, *ws], ws, ws[1:]))
    n, v = sum(one.values()), len(one)
    after_one, after_two = Counter(a for a, _ in two), Counter((a, b) for a, b, _ in three)
    d = 0.75

    def p1(w):
        return (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def p2(a, w):
        return (max(two[a, w] - d, 0) + d * after_one[a] * p1(w)) / one[a] if one[a] else p1(w)

    def p3(a, b, w):
        return (max(three[a, b, w] - d, 0) + d * after_two[a, b] * p2(b, w)) / two[a, b] if after_two[a, b] else p2(b, w)

    for how in ({}, {"shard_tokens": 200}):
        for r in lm_trie.scored(docs, **how).collect():
            ws = size[r.doc_id]
            base = sum(np.log10(p1(w)) for w in ws)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(one[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(base)
            # each code is right to 0.025
            whole = np.log10(p2(None, ws[0])) + sum(np.log10(p3(a, b, w)) for a, b, w in zip([None, *ws], ws, ws[1:]))
            assert abs(r.score - whole) <= 0.05 * len(ws)
            assert len(ws) < 30 or abs(r.score - whole) < 0.02 * len(ws)
    assert lm_trie.scored(empty).collect() == []


def test_no_more_words_than_their_ids_can_tell_apart(docs, monkeypatch):
    monkeypatch.setattr(lm_trie, "NONE", np.uint32(100))
    with pytest.raises(OverflowError):
        lm_trie.scored(docs)


def test_suffix_dedup(docs, empty):
    first, want = {}, {}
    order = lambda i: (i is None, i or 0)
    for i, t, *_ in sorted(rows(), key=lambda r: order(r[0])):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], order(i))
    for i, t, *_ in rows():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < order(i):
                gone[j : j + 50] = True
        runs = int((gone & ~np.append(False, gone[:-1])[: len(b)]).sum())
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    for frequent in (20000, 2):
        for r in suffix_dedup.repeated_bytes(docs, chunk_bytes=50_000, frequent=frequent).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.repeated_bytes(empty).collect() == []


def test_decontamination(spark, docs, empty):
    words = PASSAGE.split()
    paraphrase = " ".join(w for i, w in enumerate(words) if i % 6)
    bench = spark.createDataFrame([(1, PASSAGE), (2, "nothing of this kind is anywhere to be found here"), (3, None), (4, "")], "item_id long, text string")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(50, "before it " + paraphrase + " after it")], "doc_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(more, bench).collect()} == {(i, 1) for i in (5, 6, 11, 20, 21, 50)}
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()}.isdisjoint({5, 6, 11, 20, 21})
    assert clean.count() == len(rows()) - 6
    assert decontaminate.leaks(empty, bench).collect() == []
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []


def test_an_answer_must_be_there(spark):
    question = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, f"{question} Answer: forty two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {question} forty two"), (2, f"x {question} forty three")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def drawn(seed):
    rng = np.random.default_rng(seed)
    return lambda k: [f"v{x}" for x in rng.integers(0, 30000, k)]


def test_every_item_of_a_large_benchmark_is_found(spark):
    draw = drawn(3)
    items = [draw(38) for _ in range(3000)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    texts = [(i, " ".join(draw(30) + items[i] + draw(30))) for i in range(0, 3000, 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert {(i, i) for i, _ in texts} <= found
    assert decontaminate.without_leaks(docs, bench).count() == 0


def test_compact_windows(spark, docs, empty):
    words = PASSAGE.split()
    near = " ".join("changed" if i == 40 else w for i, w in enumerate(words))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(60, f"{near} end of it")], "doc_id long, text string"))
    for chunk_bytes in (1 << 22, 2000):
        found = {r.doc_id: r for r in compact_windows.passages(more, chunk_bytes=chunk_bytes).collect()}
        assert {i for i, r in found.items() if i is not None and r.class_id == 5} == {5, 6, 11, 20, 21, 60}
        assert all(found[i].class_id == i and found[i].passages is None for i in (0, 1, 2, 3, 4, 8, 100, 115))
        assert found[6].passages[0].first_word == 0 and found[None].class_id is None
    assert compact_windows.passages(empty).collect() == []


def test_quality(docs, empty, labels):
    found = quality_net.scored(docs, labels).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert quality_net.scored(empty, labels).collect() == []
    assert quality_net.scored(docs, labels.limit(0)).count() == len(rows())
    assert quality_net.accepted(docs, labels).columns == docs.columns


def test_scores_of_long_repetitive_texts_are_numbers(spark):
    texts = [(i if i else None, "spam " * 20000 if i % 2 else f"a quiet text of words {i} and some more") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, i % 2 ^ 1, 0) for i in range(1, 400)], "doc_id long, quality int, toxic int")
    found = quality_net.scored(docs, marks).collect()
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id % 2 ^ 1) for r in held) >= 0.95 * len(held)
    assert 150 < quality_net.accepted(docs, marks).count() < 250


def brute_simhash(t, k=4):
    w = WORD.findall(lower(t or ""))
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    bits = np.zeros(64, int)
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=42)
        bits += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


def test_simhash(docs, empty):
    want = {i: brute_simhash(t) for i, t, *_ in rows()}
    nodes = [i for i in want if i is not None]
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in nodes:
        for b in nodes:
            if (want[a] ^ want[b]).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for r in simhash_gray.near_duplicates(docs).collect():
        assert r.fp % (1 << 64) == want[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == find(r.doc_id)
    assert simhash_gray.near_duplicates(empty).collect() == []
    kept = simhash_gray.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {find(i) for i in nodes} | {None}


def test_links_of_dense_groups_against_all_pairs():
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(900)], np.uint64)
    fp = np.unique(center[rng.integers(0, 12, 900)] ^ flips)
    fp = fp[np.argsort(simhash_gray.gray_rank(fp), kind="stable")]
    found = {(int(a), int(b)) for qs, es in simhash_gray.links(np.zeros(len(fp), np.int64), fp, 4) for a, b in zip(qs, es)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4}


def test_licences(docs, empty):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    found = {r.doc_id: r for r in license_index.scan(docs).collect()}
    for i, t, *_ in rows():
        w = word.findall(lower(t or ""))
        at = {label: [j for j in range(len(w)) if w[j : j + len(p.split())] == p.split()] for p, label in license_index.BASE}
        places = sorted(j for x in at.values() for j in x)
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(k for k, x in at.items() if x))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert found[10].labels == "cc-by,gpl,mit,proprietary,reserved" and found[7].labels == ""
    assert license_index.scan(empty).collect() == []


def test_every_wording_of_a_document_is_found(spark):
    wordings = [text for _, text, _ in license_index.TEMPLATES]
    texts = ["\n\n".join(wordings)] + [f"{wordings[1]}\n\n{other}" for other in wordings] + ["plain words of any other text"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {r.doc_id: set(r.labels.split(",")) for r in license_index.scan(docs).collect()}
    assert {label for label, _, _ in license_index.TEMPLATES} <= found[0]
    for i, (label, _, _) in enumerate(license_index.TEMPLATES):
        assert {"mit", label} <= found[1 + i]


def test_a_long_item_is_found(spark):
    draw = drawn(5)
    items = [draw(38) for _ in range(39)] + [draw(n) for n in (300, 500, 800, 1200) for _ in range(4)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    texts = [(i, " ".join(draw(200) + t + draw(200))) for i, t in enumerate(items)]
    texts += [(i, " ".join(draw(500))) for i in range(100, 120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(i, i) for i in range(len(items))}


def test_components_that_have_not_settled_are_an_error(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    with pytest.raises(RuntimeError):
        components(path, rounds=2)
    assert {r.component for r in components(path).collect()} == {0}


def classes_of(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = [x if c == y else c for c in label]
    return label


def test_spans_of_a_key_against_all_pairs_of_windows():
    rng = np.random.default_rng(1)
    least, need = 46, 0.8 * 2 * 46 / 1.8 - 1e-9
    draw = lambda n, few: rng.integers(0, 25 if few else 1 << 32, n, dtype=np.uint64)
    linked = 0
    for case in range(200):
        base = draw(rng.integers(50, 70), case % 3 == 0)
        spans = []
        for _ in range(4):
            a = base.tolist()
            for _ in range(rng.integers(0, 3)):
                at, k = rng.integers(0, len(a)), rng.integers(1, 6)
                a[at : at + k * (rng.random() < 0.5)] = draw(k, False).tolist()
            spans.append(np.array(a[rng.integers(0, 5) :][: rng.integers(46, 80)], np.uint64))
        spans = [x for x in spans if len(x) >= least]
        size = np.array([len(x) for x in spans])
        bags = [[Counter(x[i : i + least].tolist()) for i in range(len(x) - least + 1)] for x in spans]
        pairs = [(i, j) for i in range(len(spans)) for j in range(i) if any((a & b).total() >= need for a in bags[i] for b in bags[j])]
        found = compact_windows.near_links(np.arange(len(spans)), size - least, np.concatenate(spans), size, least, 0.8)
        assert classes_of(len(spans), [x[:2] for x in found]) == classes_of(len(spans), pairs)
        linked += len(pairs)
    assert linked > 300


def test_near_passages_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 30000, n)]
    line = draw(30)  # shorter than a passage, and in most documents
    texts = []
    for i in range(90):
        passage = draw(int(rng.integers(50, 75)))
        for copy in range(2 + i % 2):
            edited, at = list(passage), int(rng.integers(3, len(passage) - 3))
            if copy:
                edited[at : at + int(i % 3 > 0)] = draw(int(i % 3 < 2))  # one word put in, replaced, or left out
            texts.append(draw(int(rng.integers(0, 40))) + edited + draw(int(rng.integers(0, 40))) + (line if i % 4 else []) + draw(int(rng.integers(0, 40))))
    places = [[hash(tuple(t[i : i + 5])) for i in range(len(t) - 4)] for t in texts]
    need, n = 0.8 * 2 * 46 / 1.8 - 1e-9, len(texts)
    pairs = []
    for a in range(n):
        for b in range(a):
            if len({*places[a]} & {*places[b]}) >= need:
                same = np.zeros((len(places[a]) + 1, len(places[b]) + 1), int)
                same[1:, 1:] = (np.array(places[a])[:, None] == np.array(places[b])[None, :]).cumsum(0).cumsum(1)
                if (same[46:, 46:] - same[:-46, 46:] - same[46:, :-46] + same[:-46, :-46]).max() >= need:
                    pairs.append((a, b))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for block in (2048, 3):
        found = {r.doc_id: r.class_id for r in compact_windows.passages(docs, chunk_bytes=20_000, block=block).collect()}
        right = classes_of(n, pairs)
        assert all(right[i] == right[found[i]] for i in range(n)), "linked without a near passage"
        caught = np.mean([found[a] == found[b] for a, b in pairs])
        print(f"{len(pairs)} near passages, {caught:.4f} caught")
        assert len(pairs) > 80 and caught >= 0.95, caught


def test_every_pair_at_the_threshold_is_linked(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 30000, n)]
    line, texts = draw(30), []
    for i in range(400):
        # a word replaced in the middle leaves 41 of 46 shingles, just enough; a second one, in some, mostly too few
        passage, at = draw(50), int(rng.integers(8, 40))
        other = [*passage[:at], "changed", *passage[at + 1 :]]
        if i % 8 == 7:
            other[at - 8] = "too"
        around = draw(8) if i % 2 else line
        texts += [passage + around, [*draw(3), *other, *around]]
    right = []
    for a, b in zip(texts[::2], texts[1::2]):
        x, y = ([hash(tuple(t[i : i + 5])) for i in range(len(t) - 4)] for t in (a, b))
        same = np.zeros((len(x) + 1, len(y) + 1), int)
        same[1:, 1:] = (np.array(x)[:, None] == np.array(y)[None, :]).cumsum(0).cumsum(1)
        right.append((same[46:, 46:] - same[:-46, 46:] - same[46:, :-46] + same[:-46, :-46]).max() >= 41)
    assert 350 <= sum(right) < 400
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.class_id for r in compact_windows.passages(docs, chunk_bytes=40_000).collect()}
    assert sum(right) - sum(found[2 * i + 1] == 2 * i for i in range(400) if right[i]) == 0, "near passages left out"
    assert all(found[2 * i] == 2 * i and (found[2 * i + 1] == 2 * i) == right[i] for i in range(400))


def test_similar_windows_against_all_offsets():
    rng = np.random.default_rng(6)
    least, need = 46, 0.8 * 2 * 46 / 1.8
    some = 0
    for case in range(400):
        n = int(rng.integers(50, 61))
        passage = rng.integers(0, 30 if case % 4 == 0 else 1 << 40, n)
        edit = int(rng.integers(5, n - 5))
        other = np.delete(passage, edit) if case % 2 else np.insert(passage, edit, 1 << 41)
        around = [rng.integers(0, 1 << 40, 30) for _ in range(4)]
        a, b = (np.concatenate([around[i], p, around[i + 1]]).astype(np.uint64) for i, p in ((0, passage), (2, other)))
        m = min(len(a), len(b)) - least + 1
        want = [i for i in range(m) if sum((Counter(a[i : i + least].tolist()) & Counter(b[i : i + least].tolist())).values()) >= need - 1e-9]
        assert compact_windows.similar(a, b, least, 0.8).tolist() == want
        some += bool(want)
    assert some > 200


def test_axes_are_fitted_on_all_documents(spark):
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(40))) for i in range(6)], "item_id long, text string")
    # words of two items stand together in rows that a sample of 2,000 ids can't all hold
    texts = [(i, " ".join(f"b{i % 5}x{j} b{i % 5 + 1}x{j}" for j in range(20)) if i % 40 == 0 else f"plain {i}") for i in range(4000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    held, real = [], decontaminate.back_projected
    space = decontaminate.fitted(docs, bench, axes=4, rounds=1)
    basis = np.random.default_rng(2).normal(size=(len(space.terms), 4)).astype(np.float32)
    for t in texts:
        raw = np.frombuffer(t[1].encode(), np.uint8)
        held.append(space.passages(*decontaminate.words(raw, np.array([0, len(raw)])))[:3])
    corpus = sum(real(space, *x, basis) for x in held)
    queries = space.matrix([h for _, h, _ in space.items])
    right = np.linalg.qr(real(space, *queries, basis) + len(space.items) / (len(texts) * 30) * corpus)[0]
    assert np.allclose(np.abs(space.axes), np.abs(right), atol=1e-4)


def test_passages_in_blocks_equal_passages_one_by_one():
    rng = np.random.default_rng(12)
    bench = [(i, " ".join(f"w{x}" for x in rng.integers(0, 90, 30))) for i in range(12)]
    space = decontaminate.Space(bench)
    space.index(rng.random(len(space.known)) * 4 + 0.1)
    # empty texts, short ones, one that ends at a block's end, words that come again within a passage and beyond
    sizes = [0, 1, 15, 16, 17, 48, 49, 0, 64, 900, 5, 333]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20 if i % 2 else 200, n)) for i, n in enumerate(sizes)] + ["none known here", ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, of = decontaminate.words(data, offsets)
    at, number = space.seen(h)
    assert at.tolist() == [i for i, x in enumerate(h.tolist()) if x in set(space.known.tolist())] and (space.known[number] == h[at]).all()
    basis = rng.normal(size=(len(space.terms), 7)).astype(np.float32)
    scaled = basis * space.idf[:, None].astype(np.float32)
    row, word, weight, text, begin = space.passages(h, of)
    rows, x = space.project(row, word, weight, basis, 0)
    want = np.zeros((len(text), 7))
    want[rows] = x
    right = decontaminate.back_projected(space, row, word, weight, basis)
    for slab in (3, 1 << 14):
        decontaminate.SLAB, before = slab, decontaminate.SLAB
        try:
            blocks = decontaminate.Passages(space, of, at, number)
            assert blocks.text.tolist() == text.tolist() and blocks.begin.tolist() == begin.tolist()
            assert np.allclose(np.concatenate([part[0] for part in blocks.projected(scaled)]), want, atol=1e-4)
            total = np.zeros(basis.shape, np.float32)
            blocks.add_back_projected(scaled, total)
            assert np.allclose(total * space.idf[:, None], right, rtol=1e-4, atol=1e-3)
        finally:
            decontaminate.SLAB = before
    nothing = decontaminate.Passages(space, np.zeros(3, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert list(nothing.projected(scaled)) == [] and len(nothing.text) == 0


def test_lowest_of_windows_against_sorting():
    rng = np.random.default_rng(13)
    for least, many in ((1, 1), (2, 2), (3, 2), (7, 6), (13, 13), (46, 6), (46, 1), (64, 20)):
        x = rng.permutation(least + 90).astype(np.uint64)
        want = np.sort(np.lib.stride_tricks.sliding_window_view(x, least), axis=1)[:, :many]
        assert np.array_equal(np.stack(compact_windows.lowest(x, least, many), axis=1), want)


def test_sifted_spans_keep_all_links():
    rng = np.random.default_rng(14)
    least, dropped, linked = 20, 0, 0
    for case in range(60):
        base = [rng.integers(0, 1 << 32, 24) for _ in range(4)]
        spans, group, class_ = [], [], []
        for i in range(40):
            x = base[rng.integers(0, 4)][: rng.integers(20, 25)].copy()
            # the same line in all; some words or nearly all of them are others; in some cases words come again
            x[rng.random(len(x)) < rng.choice([0, 0.06, 0.9])] = rng.integers(0, 5 if case % 3 == 0 else 1 << 32)
            x[:2] = 7
            spans.append(x)
            group.append(i % 3)
            class_.append(int(rng.integers(0, 12)))
        size, group, class_ = np.array([len(x) for x in spans]), np.array(group), np.array(class_)
        left = compact_windows.sifted(group, class_, np.concatenate(spans).astype(np.uint32), size, least, 0.8)
        dropped += len(spans) - len(left)
        need = compact_windows.needed(least, 0.8)
        for i, j in combinations(range(len(spans)), 2):
            if group[i] == group[j] and class_[i] != class_[j]:
                windows = [[Counter(x[a : a + least].tolist()) for a in range(len(x) - least + 1)] for x in (spans[i], spans[j])]
                if any((a & b).total() >= need for a in windows[0] for b in windows[1]):
                    linked += 1
                    assert i in left and j in left
    assert linked > 500 and dropped > 500
