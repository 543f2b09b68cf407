"""What queries had wrong beside their SQL, on rows worked out by hand."""

import numpy as np
import pyarrow as pa
import pytest

from tests.oracle import SF, there
from trailmark.functions import html, text
from trailmark.llm import exchange
from trailmark.operators import crawl, index, places
from trailmark.plans import catalogue
from trailmark.streaming.visits import captures


def test_only_whole_references_are_characters():
    title, headings, snippet, _, links = html.parse('<title>a &amp; b&amp</title><h1>x &lt; y&lt</h1><body><a href="/p?a=1&copy=2&amp;b">&notit; &eacute;&#39;&#39</a></body>', "https://h.example/")
    assert (title, headings) == ("a & b&amp", ["x < y&lt"])
    assert links[0][:2] == ("https://h.example/p?a=1&copy=2&b", "&notit; é'&#39")
    assert html.outline_of("<body><h2>cut &am</h2><h2>cut &amp</h2></body>", "")[0] == ["cut &am", "cut &amp"]
    # code is not decoded, and its marks stay as they are
    assert html.parse("<title>t</title><body><h1>a<script>b && c &amp d</script></h1></body>", "")[1] == ["a b && c &amp d"]


def test_pages_of_one_url_are_recorded_apart(spark):
    replies = spark.createDataFrame([(i, "https://h.example/", 200, "text/html", "", "<title>t</title>") for i in (1, 2, 3)], "page_id long, url string, status int, content_type string, final_url string, body string")
    pages = spark.createDataFrame([(1, "https://h.example/", True, "read"), (2, "https://h.example/", True, "read"), (3, "https://h.example/", False, None)], "page_id long, url string, visited boolean, snippet string")
    assert sorted(str(r.title) for r in crawl.recorded(replies, pages, 0.0, "page_id").collect()) == ["None", "None", "t"]
    assert [r.title for r in crawl.recorded(replies, pages, 0.0).collect()] == [None] * 3  # by URL: no row twice


def test_visits_at_one_time_have_their_own_captures(spark):
    visits = spark.createDataFrame([(1, 7, "u", 0.0, 30.0), (2, 7, "u", 0.0, 30.0), (3, 7, "u", 1.0, 30.0)], "event_id long, user_id long, url string, start_s double, duration_s double")
    texts = spark.createDataFrame([(e, 7, "u", s + after, f"{e}") for e, s in ((1, 0.0), (2, 0.0), (3, 1.0)) for after in (2.0, 4.0)], "event_id long, user_id long, url string, ts_s double, text string")
    got = captures(visits, texts, visit="event_id").select("start_s", "turn", "ts_s", "text").collect()
    assert sorted(map(tuple, got)) == [(0.0, 0, 4.0, "1"), (0.0, 0, 4.0, "2"), (1.0, 0, 5.0, "3")]


def test_python_holds_a_piece_of_a_batch_at_a_time():
    rows = pa.array([f"<title>é{i}</title>" for i in range(300)])
    assert [len(x) for x in html.parsed.func(iter([(rows, rows)]))] == [128, 128, 44]
    assert [len(x) for x in html.outline.func(iter([(rows, rows)]))] == [128, 128, 44]
    out = [*text._plain.func(iter([rows, rows]))]
    assert [len(x) for x in out] == [128, 128, 44] * 2 and out[3][0].as_py() == "<title>e0</title>"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not there, reason="no test tables")
@pytest.mark.parametrize("name", ["page_label", "alias_boost", "crawl_budget", "linking_site", "changed_names", "applicable_picks"])
def test_pages_are_parsed_once(spark, name):
    assert "parsed(" not in plan(catalogue.QUERIES[name](spark, SF))


@pytest.mark.skipif(not there, reason="no test tables")
def test_visits_and_hubs_are_made_once(spark):
    assert "Window" not in plan(catalogue._flagged(spark, SF)) and "Join" not in plan(catalogue._stand_ins(spark, SF))
    assert "Window" not in plan(catalogue.hub_stats(spark, SF)) and "count(distinct q" not in plan(catalogue.hub_stats(spark, SF))


def test_hub_statistics_count_what_is_distinct(spark):
    rows = [(1, "https://h.example/s?q=a", 0.0, 5.0), (1, "https://h.example/s?q=a", 1.0, 50.0), (1, "https://h.example/s?q=a", 86400.0, 0.0), (1, "https://h.example/s?q=b", 86401.0, 1.0)]
    visits = spark.createDataFrame([(*r, None) for r in rows], "user_id long, url string, ts_s double, duration_s double, from_url string")
    got = places.hub_statistics(visits).first()
    assert (got.n_visits, got.distinct_share, got.brief_share, got.n_origins) == (4, 0.666667, 0.666667, 0)


def test_lists_of_tokens_are_the_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "B c"), (2, ""), (3, None)], "doc_id long, text string")
    lists = index.token_lists(docs, "doc_id", ["text"])
    assert sorted(map(tuple, index.placed(lists).collect())) == sorted(map(tuple, index.postings(docs, "doc_id", ["text"]).collect()))
    assert lists.count() == 4 and sorted(index.doc_stats(docs.select("doc_id").distinct(), lists).collect()) == [(1, 5), (2, 0), (3, 0)]


def test_few_words_leave_few_postings(spark):
    posts = spark.createDataFrame([(1, "text", i, f"w{i}") for i in range(2000)], "doc_id long, field string, pos int, token string")
    atoms = spark.createDataFrame([("term", ["w7"]), ("prefix", ["w19"]), ("phrase", ["w4", "w5"]), ("phrase", ["w5", "w4"])], "kind string, words array<string>")
    sifted = index._sifted(posts, spark.createDataFrame([("w4",), ("w5",), ("none",)], "token string"))
    assert {"w4", "w5"} <= {r.token for r in sifted.collect()} and sifted.count() < 50
    got = {(r.kind, r.pos) for r in index.hits(posts, atoms).collect()}
    assert got == {("term", 7), ("phrase", 4)} | {("prefix", i) for i in range(2000) if str(i).startswith("19")}


@pytest.mark.skipif(not there, reason="no test tables")
def test_documents_are_counted_where_their_lists_are(spark):
    assert "count(distinct doc_id" not in plan(catalogue.bm25_stats(spark, SF))


def test_what_is_cut_again_is_read_in_bounded_parts(monkeypatch):
    records = exchange.Records(10, 8, chunk="<i8", size="<u2", ids="*<i8")
    n = 1000
    rows = [b for c in range(30) for b in records.rows(np.full(n, 7 << 54, np.uint64) + np.uint64(c), np.full(n, c), np.full(n, 5, np.uint16), np.repeat(np.arange(n), 5))]
    monkeypatch.setattr(exchange, "GATHERED", 1 << 18)
    most = []
    read = exchange.Records.read
    monkeypatch.setattr(exchange.Records, "read", lambda self, table: most.append(int(self.unpacked(table).sum())) or read(self, table))
    cut = [*records._cut_again(10)(iter(rows))]
    assert max(most) <= 2 << 18  # the rows of a part, and the last of these whole
    chunk, ids = (np.concatenate([read(records, b)[i] for b in cut]) for i in (1, 3))
    assert (np.bincount(chunk) == n).all() and len(ids) == 30 * n * 5 and ids.sum() == 30 * 5 * n * (n - 1) // 2
