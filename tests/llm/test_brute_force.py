"""Operators that SQL cannot express, against plain versions of themselves on small tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import bytesops as B
from trailmark.llm import decontaminate, license_index, quality_net, rules_forest, shard_histogram, simhash_gray, suffix_dedup
from trailmark.llm.exchange import Records

WORD = re.compile(r"[^\x20\x09-\x0D]+")
U = np.uint64


# --- op3


def path_length(forest, tree, x):
    node = 0
    for _ in range(forest.depth):
        node = 2 * node + 1 + int(x[forest.feature[tree, node]] >= forest.split[tree, node])
    return forest.length[tree, node]


def test_rules_keep_what_plain_forests_keep(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 300, n))
    texts = [say(int(rng.integers(15, 80))) for _ in range(160)]
    texts += ["### $$$ %%% &&& " * 8 + say(20) for _ in range(12)] + [say(8) + "\n" + "again and again\n" * 9 for _ in range(12)] + [say(30).upper() for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = [(i, int(i < 160), 0) for i in range(len(texts)) if i % 5]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in rules_forest.judged(docs, labels, fit_rows=120, trees=20).collect()}

    stats = sorted(rules_forest.rule_statistics(docs).collect(), key=lambda r: r.doc_id)
    names = rules_forest.COUNTS + rules_forest.MORE
    of = lambda rows: rules_forest.features({c: np.array([r[c] for r in rows]) for c in names})
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in range(len(texts))], "doc_id long").orderBy(F.xxhash64("doc_id")).collect()]
    x = of(stats)
    forests = [(cols, rules_forest.Forest(x[order[:120]][:, cols], 20, 64, 5 + i)) for i, cols in enumerate(rules_forest.RULES.values())]
    scores = np.array([[2 ** (-np.mean([path_length(f, t, row[cols]) for t in range(20)]) / f.norm) for cols, f in forests] for row in x])
    failed = [r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words for r in stats]
    kept = [not f for f in failed]
    for rule in range(len(forests)):
        known = [(int(scores[i, rule] * rules_forest.BINS), q) for i, q, _ in marks if not failed[i]]
        good, bad = [b for b, q in known if q == 1], [b for b, q in known if q == 0]
        cuts = [c for c in range(rules_forest.BINS + 1) if np.mean([b <= c for b in good]) >= 0.998]
        worth = [np.mean([b <= c for b in good]) - np.mean([b <= c for b in bad]) for c in cuts]
        cut = (max(c for c, w in zip(cuts, worth) if w == max(worth)) + 1) / rules_forest.BINS
        kept = [k and s < cut for k, s in zip(kept, scores[:, rule])]
    for i, r in found.items():
        assert r.anomaly == pytest.approx(scores[i])
        assert r.kept == kept[i]
    assert sum(kept[:160]) > 120 and sum(kept[160:]) < 10


# --- op6


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("block_bytes", [8 << 20, 4000])
def test_paraphrases_against_the_longest_common_subsequence(spark, block_bytes):
    rng = np.random.default_rng(4)
    draw = lambda n: [f"v{int(x)}" for x in rng.zipf(1.3, n) % 3000]
    items = [draw(int(rng.integers(20, 70))) for _ in range(60)]
    texts = []
    for i, item in enumerate(items):
        for share in (0.0, 0.15, 0.3, 0.38, 0.6):
            told = [w if rng.random() >= share else f"n{rng.integers(9999)}" for w in item]
            texts.append((draw(int(rng.integers(0, 90))) + told + draw(int(rng.integers(0, 90))), i))
    texts += [(draw(200), None) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(t)) for d, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_bytes=block_bytes).collect()}
    right = set()
    for d, (text, own) in enumerate(texts):
        if own is None:
            continue
        item = items[own]
        n, need = len(item), int(np.ceil(0.6 * len(item)))
        if any(lcs(item, text[at : at + n]) >= need for at in range(max(1, len(text) - n + 1))):
            right.add((d, own))
    print(f"{len(right)} paraphrases that hold enough, {len(right & found) / len(right):.4f} found, {len(found - right)} more")
    assert len(right) > 150
    assert len(right & found) >= 0.95 * len(right)
    for d, i in found:
        assert lcs(items[i], texts[d][0]) >= int(np.ceil(0.6 * len(items[i])))
    gone = {d for d, _ in found}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench, block_bytes=block_bytes).collect()} == set(range(len(texts))) - gone


# --- op9


def test_low_entropy_fingerprints_are_linked_in_parts(spark):
    rng = np.random.default_rng(5)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 9), replace=False)) for _ in range(700)], np.int64))
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fp)], "fp long, id long")
    for most in (1 << 15, 40):
        edges = [(r.a, r.b) for r in simhash_gray.linked(nodes, most=most).collect()]
        label, right = list(range(len(fp))), list(range(len(fp)))

        def join(label, a, b):
            x, y = sorted((label[a], label[b]))
            return [x if c == y else c for c in label] if x != y else label

        for a, b in edges:
            label = join(label, a, b)
        for a in range(len(fp)):
            for b in range(a):
                if (int(fp[a]) ^ int(fp[b])).bit_count() <= 4:
                    right = join(right, a, b)
        assert label == right


# --- op10


def test_labels_against_all_places(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _, wording, _ in license_index.TEMPLATES:
        for damage in (0.0, 0.1, 0.25, 0.4, 0.6):
            words = [w if rng.random() >= damage else "other" for w in wording.split()]
            before = [f"x{v}" for v in rng.integers(0, 50, rng.integers(0, 20))]
            texts.append(" ".join(before + words[: len(words) - int(rng.integers(0, 4)) * (len(words) > 20)]))
    texts += ["no licence here", ""] + [" ".join(w for _, t, _ in license_index.TEMPLATES for w in t.split()[:3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {r.doc_id: r for r in license_index.scan(docs).collect()}
    index = license_index.Index(*license_index.document_frequency(docs))
    some = 0
    for i, text in enumerate(texts):
        h = license_index._hashes(text)
        labels, score = {label for label in (found[i].base_labels or "").split(",") if label}, 0.0
        for t, words in enumerate(index.words):
            for begin in range(-len(words), len(h)):
                share = index.share(h, 0, len(h), t, begin)
                if share >= license_index.ACCEPT and index.phrase_near(h, 0, len(h), t, begin):
                    labels.add(license_index.TEMPLATES[t][0])
                    score = max(score, min(1.0, share))
        assert found[i].labels == ",".join(sorted(labels)) and found[i].score == pytest.approx(score)
        some += score > 0
    assert some >= 15


# --- what operators share


@pytest.mark.parametrize("bits,fan", [(3, 7), (7, 3), (9, 2)])
def test_exchange_brings_every_record_to_its_shard(spark, bits, fan):
    records = Records(bits, fan, owner="<i8", size="<u2", values="*<u4")

    def send(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng(i)
                size = rng.integers(0, 4, 50)
                yield from records.rows(B.mix64(rng.integers(0, 40, 50).astype(U)), np.full(50, i), size, rng.integers(0, 1 << 32, size.sum()))

    def count(table):
        import pyarrow as pa

        route, owner, size, values = records.read(table)
        shard = table.column("shard")[0].as_py()
        assert (route >> U(64 - bits) == U(shard)).all()
        return pa.table({"n": [len(route)], "total": [int(values.astype(np.int64).sum())], "owners": [int(owner.sum())]})

    got = records.grouped(spark.range(20).repartition(4).mapInArrow(send, records.schema)).applyInArrow(count, "n long, total long, owners long").collect()
    want = 0
    for i in range(20):
        rng = np.random.default_rng(i)
        size = rng.integers(0, 4, 50)
        rng.integers(0, 40, 50)
        want += int(rng.integers(0, 1 << 32, size.sum()).sum())
    assert sum(r.n for r in got) == 1000 and sum(r.total for r in got) == want and sum(r.owners for r in got) == 50 * sum(range(20))
    assert len(got) <= min(1 << bits, 40)


def test_packed_chunks_of_many_sizes_remove_alike(spark):
    docs = spark.createDataFrame([(i, "a text that is there again and again, with a tail " * 3 + str(i % 7)) for i in range(60)], "doc_id long, text string").repartition(5)
    one, two = ({(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs, chunk_bytes=c).collect()} for c in (400, 1 << 20))
    assert one == two and len(one) == 60


# --- the pipeline


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with null, empty, long, equal and leaking texts, and repeated rows."""
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    item = say(40)
    texts = [say(int(rng.integers(30, 90))) for _ in range(120)]
    texts += ["junk! $$$ " * 30 for _ in range(20)] + [texts[0], texts[0], texts[1] + " more", say(50) + " " + item + " " + say(50), None, "", say(30000)]
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], "en", "s1", 1)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(not 120 <= i < 140), 0) for i in range(0, 140) if i % 4], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_each_stage_does_what_its_operator_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, key = dict(corpus_pipeline.STAGES), lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    rows = lambda df: sorted(df.collect(), key=key)
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    good = corpus_pipeline.written(stages["quality"](spark, docs, folder), "t")
    told = {r.doc_id: r.predicted for r in quality_net.scored(docs, labels).collect()}
    assert rows(good) == [r for r in rows(docs) if told[r.doc_id]]
    assert not {r.doc_id for r in good.collect()} & {i for i in range(120, 140) if zlib.crc32(str(i).encode()) % 3 != 1}

    one = corpus_pipeline.written(stages["near-duplicates"](spark, good, folder), "t")
    prints = {}
    for r in simhash_gray.fingerprints(good).collect():
        prints.setdefault(r.fp % (1 << 64), []).append(r.doc_id)
    groups = [[f] for f in prints]
    for f in prints:
        near = [g for g in groups if any((f ^ x).bit_count() <= 4 for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [])]
    stay = {min((i for f in g for i in prints[f] if i is not None), default=None) for g in groups}
    assert rows(one) == [r for r in rows(good) if r.doc_id is None or r.doc_id in stay]

    clean = corpus_pipeline.written(stages["decontaminate"](spark, one, folder), "t")
    assert rows(clean) == [r for r in rows(one) if r.doc_id != 143]

    mixed = corpus_pipeline.written(stages["mix"](spark, clean, folder), "t")
    size = lambda r: len(WORD.findall(r.text or ""))
    whole, got = Counter(), Counter()
    for r in clean.collect():
        whole[r.source] += size(r)
    for r in mixed.collect():
        got[r.source] += size(r)
    per = Counter(r.doc_id for r in mixed.collect())
    assert max(per[i] for i in per if i is not None and i != 5) <= 2 and mixed.columns == docs.columns
    assert abs(sum(got.values()) - 1.5 * sum(whole.values())) <= max(size(r) for r in clean.collect()) * len(whole)

    out = stages["shard"](spark, mixed, folder).collect()
    assert sorted(map(key, out)) == sorted(map(key, mixed.collect()))
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in out}


def test_stages_without_documents(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        assert found.collect() == [] and {*docs.columns} <= {*found.columns}, name


def test_shards_follow_the_rule_for_boundaries(spark):
    rng = np.random.default_rng(9)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 150)] + ["the same " * 30] * 60
    docs = spark.createDataFrame([(int(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = shard_histogram.shard(docs, shards=6).collect()
    size = [0] * 6
    for r in found:
        size[r.shard] += r.shard_size
    target = sum(size) / 6
    assert max(abs(s - target) for s in size) <= max(len(t) + 1 for t in texts)
    split = Counter()
    for t, shards in {t: {r.shard for r in found if r.text == t} for t in texts}.items():
        split[len(shards) > 1] += 1
    assert split[True] <= 5
