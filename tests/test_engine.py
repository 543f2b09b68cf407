"""The engine on small tables worked out by hand, and BM25 against an embedded full-text index."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from trailmark.config import DEFAULT
from trailmark.functions import html, text, urls
from trailmark.operators import crawl, graph, index, jobs, naming, places, scoring, search, visits, watch
from trailmark.sources import store

NOW, DAY = 1_790_000_000.0, 86400.0


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Me@WWW.Host.example:80/a?utm_source=x&b=1#f", "http://www.host.example/a?b=1"),
        ("https://h.example", "https://h.example/"),
        ("https://h.example:8443/?q=a+b&c", "https://h.example:8443/?q=a+b&c="),
        ("https://h.example/p?gclid=1&keep=2", "https://h.example/p"),
        ("ftp://h.example/", None),
        ("chrome://settings", None),
        ("no url", None),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.col("u")), u=url) == want


def test_url_parts(spark):
    u = F.col("u")
    assert one(spark, urls.kind(u), u="https://h.example/Slides.PPTX") == "slides"
    assert one(spark, urls.kind(u), u="https://www.youtube.com/watch?v=1") == "video"
    assert one(spark, urls.template(u), u="https://h.example/lectures/l04.html") == "h.example/lectures/l{n}.html"
    assert one(spark, urls.template(u), u="https://h.example/0123456789abcdef") == "h.example/{id}"
    assert one(spark, urls.words(u), u="https://cs.example/cse452/L04-rpc.pdf") == "cs example cse 452 l 04 rpc pdf"
    assert one(spark, urls.alias(F.col("o"), F.col("p")), o="https://courses.example.edu", p="/courses/cse452/26au/") == "cse452"
    assert one(spark, urls.alias(F.col("o"), F.col("p")), o="https://www.shop.co.uk", p="/") == "shop"
    assert one(spark, urls.alias(F.col("o"), F.col("p")), o="https://h.example", p="/a%2Bb+c/") == "a+b+c"
    args = (F.col("f"), F.col("t"), F.lit("https://h.example"), F.lit("/"))
    assert one(spark, urls.relation(*args), f="https://h.example/a/b", t="https://h.example/a/c") == "deeper"
    assert one(spark, urls.relation(*args), f="https://h.example/a/b", t="https://h.example/c") == "sideways"
    assert one(spark, urls.relation(*args), f="https://h.example/a/b", t="https://other.example/a/c") == "outside"


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.normalize_text(t), t="CSE452 L04! 007 0") == "cse 452 l 4 7 0"
    assert one(spark, text.index_text(t), t="Café ﬁne") == "cafe fine"
    assert one(spark, text.normalize_text(t), t="Café x\u0304y हिन्दी") == "café x y ह न द"
    assert one(spark, text.index_text(t), t="Café x\u0304y हिन्दी 한국") == "cafe x y ह न द 한국"
    assert [g[0].words for g in one(spark, text.query_groups(text.query_tokens(t)), t="pull pull request request")] == [["pull"], ["pull", "request"], ["request"]]
    assert one(spark, text.query_tokens(t), t="the of") == ["the", "of"]
    assert one(spark, text.query_tokens(t), t="open the RPC page") == ["rpc"]
    groups = one(spark, text.query_groups(text.query_tokens(t)), t="pull request lectures 5")
    assert [[(a.kind, a.words) for a in g] for g in groups] == [[("phrase", ["pull", "request"]), ("term", ["pr"])], [("prefix", ["lecture"])], [("term", ["5"])]]
    assert [a.words[0] for a in one(spark, text.query_groups(text.query_tokens(t)), t="lecture")[0]] == ["lecture", "lec", "slide", "note"]
    for nasty in ('"', "*", "NEAR(a b)", "^rpc", " ", "😀", "日本語", "a OR", "(", "col:x", "--", "'", "\\", "\x00", "-", "AND"):
        assert isinstance(one(spark, text.query_groups(text.query_tokens(t)), t=nasty), list)
    assert one(spark, text.headings_list(t), t='["a", "b"]') == ["a", "b"]
    assert one(spark, text.headings_list(t), t='"a"') == ["a"] and one(spark, text.headings_list(t), t="a [") == ["a ["]
    assert one(spark, text.headings_list(t, "none"), t="a [") == []


PAGE = """<html><head><title> A  page </title><base href="/x/"></head><body><nav><a href="menu">Menu</a></nav>
<h1>One</h1><h2>Two</h2><p>See <a href="a.pdf#p2">the slides</a> now<p><a href="me@h.example">mail</a><a href="mailto:me@h.example">m</a>
<table><tr><td>Oct 3</td><td>RPC</td><td><a href="b?utm_source=q"><img alt="notes"></a></td></tr></table><footer>end</footer></body></html>"""


def test_html():
    title, headings, snippet, password, links = html.parse(PAGE, "https://h.example/c/")
    assert (title, headings, password) == ("A page", ["One", "Two"], False)
    assert "Menu" not in snippet and "end" not in snippet and snippet.startswith("A page · One · Two · One Two See the slides now")
    assert [(a, b) for a, b, _ in links][:2] == [("https://h.example/x/menu", "Menu"), ("https://h.example/x/a.pdf#p2", "the slides")]
    assert ("https://h.example/x/b?utm_source=q", "notes", "Oct 3 · RPC") in links
    assert not any("me@h" in a and not a.startswith("mailto") for a, _, _ in links)
    assert html.parse("<h1>x" * 40, "https://h.example/")[1] and len(html.parse("".join(f"<h1>{i}</h1>" for i in range(40)), "")[1]) == 30
    assert html.parse(None, "")[0] == "" and html.parse("<p><b>x", "")[4] == []


def test_link_names_and_contexts():
    page = """<p>Before <a href=/1>one</a> after<ul><li>Item <a href=/2><img src=x><img alt=" two "></a><li><a href=/3 title=three></a>
    <table><tr><th>Day<td><a href=/4>four</a><td></td><tr><td><a href=/5>five</a></table><area href=/6 aria-label=six>"""
    links = html.parse(page, "https://h.example/")[4]
    assert [(a[-1], b, c) for a, b, c in links] == [("1", "one", "Before one after"), ("2", "two", "Item"), ("3", "three", "Day four five"), ("4", "four", "Day · four"), ("5", "five", ""), ("6", "six", "Day four five")]
    deep = "<div>" * 5000 + "<a href=/x>x</a>"
    assert html.parse(deep, "https://h.example/")[4] == [("https://h.example/x", "x", "")]


def test_rendered_outline():
    page = """<meta property=og:description content="shared"><meta name=description content=" told "><body><nav><a href=/n>n</a><p>one two three four five six</p></nav>
    <div class=breadcrumbs>Home › Here</div><main><h1>Top</h1><p>a b c d e</p><p>too short</p><p>f g h i j</p><p>third under the same heading</p><h2>Next</h2>
    <li>k l m n o <a href=/in>in</a></li><div aria-hidden=true><a href=/hidden>h</a></div><a href="mailto:a@b.c">m</a><a href="me@h.example">me</a></main>"""
    headings, blocks, told, crumb, links = html.outline_of(page, "https://h.example/p")
    assert (headings, blocks, told, crumb) == (["Top", "Next"], ["a b c d e", "f g h i j", "k l m n o in"], "told", "Home › Here")
    assert links == [("https://h.example/in", "in", "k l m n o in")]
    bare = "<body>" + "".join(f"<div><div>box {i} of plain words</div></div>" for i in range(9)) + "<a href=/y>y</a>" * 400
    assert len(html.outline_of(bare, "https://h.example/")[1]) == 6 and len(html.outline_of(bare, "https://h.example/")[4]) == 300
    assert html.outline_of(None, "") == ([], [], "", "", [])


def test_sessionize(spark):
    rows = [(1, i, *r) for i, r in enumerate([(0.0, "t", False, "https://s.example/?q=1", "s"), (2.0, "t", False, "https://c.example/", "c"), (30.0, "t", False, "https://c.example/", "c"), (40.0, None, None, None, None), (42.0, "u", True, "https://x.example/", "x"), (50.0, "u", False, "https://c.example/", "again"), (60.0, "u", False, "https://c.example/", "again")])]
    ticks = spark.createDataFrame(rows, "user_id long, tick_id long, ts_s double, tab_id string, incognito boolean, url string, title string")
    got = [(r.url, r.start_s, r.duration_s, r.from_url) for r in visits.sessionize(ticks).orderBy("start_s").collect()]
    assert got == [("https://s.example/?q=1", 0, 2, None), ("https://c.example/", 2, 38, "https://s.example/?q=1"), ("https://c.example/", 50, 10, None)]


def test_stream_gives_the_same_visits(spark, tmp_path):
    from trailmark.streaming.visits import visit_stream

    rows = [(u, i, 10.0 * i, f"t{i % 2}", i % 7 == 0, f"https://h{i % 3}.example/{i // 3}", "x") for u in (1, 2) for i in range(40)]
    ticks = spark.createDataFrame(rows, "user_id long, tick_id long, ts_s double, tab_id string, incognito boolean, url string, title string")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = visit_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")))
    run = stream.writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {tuple(r) for r in spark.table("streamed").select("user_id", "url", "start_s", "duration_s", "from_url").collect()}
    batch = {tuple(r) for r in visits.sessionize(ticks).select("user_id", "url", "start_s", "duration_s", "from_url").collect()}
    assert streamed < batch and len(batch - streamed) == 2  # the last visit of each user is still open


def seen(spark, rows):
    full = [(1, i, NOW - days * DAY, u, float(d), f) for i, (days, u, d, f) in enumerate(rows)]
    return spark.createDataFrame(full, "user_id long, event_id long, ts_s double, url string, duration_s double, from_url string")


def test_features(spark):
    rows = seen(spark, [(d, f"https://h.example/a/{i}", dur, src) for d, i, dur, src in [(0, 1, 3, None), (2, 1, 0, "https://h.example/a/2"), (4, 2, 60, "https://s.example/?q"), (4, 3, 9, "https://h.example/a/9")]])
    rows = rows.withColumns({"scope": F.lit("p"), "from_hub": F.coalesce(F.col("from_url").startswith("https://s."), F.lit(False))})
    r = scoring.place_features(scoring.with_arrivals(rows), ["user_id", "scope"], NOW).first()
    days = 1 + 0.5 ** (2 / 14) + 0.5 ** (4 / 14)
    assert (r.visits, r.n_days, r.breadth, r.bounce, r.regular) == (4, 3, 3, 0.5, 1.0)
    assert r.days == pytest.approx(days, abs=1e-4) and r.from_search == pytest.approx(1 / 3, abs=1e-4)
    x = -3 + 1.5 * math.log1p(days) + 0.5 * math.log1p(3) - 0.5 + 0.5
    assert r.revisit == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-4)


def grouped(spark, paths):
    rows = spark.createDataFrame([(1, f"https://h.example{p}", n) for p, n in paths.items()], "user_id long, url string, n_days long")
    return {r.url.removeprefix("https://h.example"): r.path_prefix for r in places.group(rows).collect()}


def test_tenants_are_places_of_their_own(spark):
    paths = {f"/courses/{c}/{p}": 1 for c in ("cse452", "cse333") for p in ("lectures/l01.html", "lectures/l02.html", "hw/hw1.html")}
    got = grouped(spark, paths | {"/about/team.html": 1})
    assert got["/courses/cse452/hw/hw1.html"] == "/courses/cse452/" and got["/courses/cse333/lectures/l01.html"] == "/courses/cse333/"
    assert got["/about/team.html"] == "/"


def test_concentration_adoption_and_depth(spark):
    got = grouped(spark, {"/wiki/a": 8, "/wiki/b": 8, "/wiki": 1, "/x": 1})
    assert got == {"/wiki/a": "/wiki/", "/wiki/b": "/wiki/", "/wiki": "/wiki/", "/x": "/"}
    assert grouped(spark, {"/a/b/c/d/e/f/g.html": 3}) == {"/a/b/c/d/e/f/g.html": "/a/b/c/d/"}


@pytest.mark.parametrize("depth", [2, 9, 10, 11, 12, 36, 200])
def test_tenants_of_any_depth(spark, depth):
    """Children that agree on half of the places below them, and one that agrees on one place too few."""
    need = max(1, math.ceil((depth - 1) / 2))
    shape = lambda own, n: "/".join([own, "x", *(f"s{'abcdefghij'[i % 10]}" if i < n else f"{own}{'klmnopqrst'[i % 10]}" for i in range(depth - 1))])
    got = grouped(spark, {f"/{shape('one', need)}": 1, f"/{shape('two', depth - 1)}": 1, f"/{shape('few', need - 1)}": 1, "/a": 9, "/b": 9, "/c": 9})
    assert {p.split("/")[1]: place for p, place in got.items()}["few"] == "/"
    assert all(place.startswith(f"/{p.split('/')[1]}/") for p, place in got.items() if p.split("/")[1] in ("one", "two"))


def test_hubs_and_cycle(spark):
    rows = []
    for i, day in enumerate([9, 6, 3]):
        rows += [(day, f"https://s.example/find?q={i}", 20, None), (day - 0.001, f"https://site{i}.example/p/x.html", 30, f"https://s.example/find?q={i}")]
    rows += [(d, "https://docs.example/guide/start.html", 60, None) for d in range(8)]
    data = seen(spark, rows)
    assert [tuple(r) for r in places.hubs(data).collect()] == [(1, "https://s.example/find")]
    cycle = watch.Cycle(data, NOW)
    found = {r.scope: r.status for r in cycle.places().collect()}
    assert found["https://s.example/"] == "hub" and found["https://docs.example/guide/"] == "active"
    before = cycle.places()
    stored = cycle.pages()
    _, changed, gone = cycle.changes(before, stored)
    assert changed.count() == 0 and gone.count() == 0


def test_store(spark, tmp_path):
    catalog = store.Catalog(spark, str(tmp_path))
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "url string, title string, n int")
    catalog.write("pages", old)
    new = spark.createDataFrame([("b", None), ("c", "C")], "url string, title string")
    catalog.write("pages", store.upsert(catalog.read("pages"), new, ["url"], ["title"], {"n": F.lit(0)}))
    assert sorted(map(tuple, catalog.read("pages").collect())) == [("a", "A", 1), ("b", None, 2), ("c", "C", 0)]
    version = catalog.version("pages")
    with pytest.raises(Exception):  # noqa: B017
        catalog.write_all({"pages": old, "other": old.select(F.raise_error(F.lit("broken")).alias("x"))})
    assert catalog.version("pages") == version and catalog.version("other") is None

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        catalog.write_all({"pages": old, "other": old}, before_commit=crash)
    assert catalog.version("pages") == version and catalog.version("other") is None

    def another():
        store.Catalog(spark, str(tmp_path)).write("third", old)

    catalog.write_all({"pages": catalog.read("pages"), "other": old}, before_commit=another)  # of other relations
    assert {*catalog.manifest()[1]} == {"pages", "other", "third"}
    with pytest.raises(store.Conflict):
        catalog.write_all({"third": old}, before_commit=another)
    was = sorted(map(tuple, catalog.read("pages").collect()))
    catalog.vacuum(keep=1)
    assert sorted(map(tuple, catalog.read("pages").collect())) == was and len(catalog.commits()) == 1
    assert len(list((tmp_path / "pages").iterdir())) == 1
    links = spark.createDataFrame([(1, 2, "old", "", 5)], "from_id long, to_id long, anchor string, context string, link_seq long")
    assert [tuple(r) for r in store.upsert_links(links, links.withColumns({"anchor": F.lit("new"), "link_seq": F.lit(9).cast("long")})).collect()] == [(1, 2, "new", "", 5)]


def test_names(spark):
    rows = [(i, f"https://s.example/p{i}", t, h) for i, (t, h) in enumerate([("Alpha – My Site", []), ("Beta – My Site", []), ("(12) Gamma – My Site", []), ("Home – My Site", ["Head"]), ("Home – My Site", []), ("Untitled document", []), (None, [])])]
    pages = spark.createDataFrame(rows, "page_id long, url string, title string, headings array<string>")
    links = spark.createDataFrame([(6, "here", 1), (6, " The notes ", 2), (6, "later", 3), (5, None, 4)], "to_id long, anchor string, link_seq long")
    got = {r.url[-1]: r.name for r in naming.names(pages, links).collect()}
    assert got == {"0": "Alpha", "1": "Beta", "2": "Gamma", "3": "Head", "4": "Home · p4", "5": "p5", "6": "The notes"}


def test_bm25_agrees_with_an_embedded_index(spark):
    words = "rpc lecture five notes paxos cache lock log raft vote".split()
    rows = [(i, " ".join(words[(i * 7 + j) % 10] for j in range(3 + i % 4)), " ".join(words[(i * 3 + j * j) % 10] for j in range(i % 9))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, snippet, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, title, snippet) VALUES (?, ?, ?)", [(i + 1, a, b) for i, a, b in rows])
    posts = index.postings(spark.createDataFrame(rows, "id long, title string, snippet string"), "id", ["title", "snippet"])
    stats = index.doc_stats(spark.createDataFrame(rows, "id long, title string, snippet string"), posts, "id")
    queries = spark.createDataFrame([(0, "rpc paxos"), (1, "lo vote vote")], "query_id long, query string")
    atoms = index.query_atoms(queries)
    got = {(r.query_id, r.doc_id): r.bm25 for r in index.matches(index.hits(posts, atoms), atoms, stats, {"title": 2.5, "snippet": 0.7}).collect()}
    for q, match in ((0, '"rpc"* OR "paxos"*'), (1, '"lo" OR "vote"* OR "vote"*')):
        want = dict(db.execute("SELECT rowid - 1, -bm25(t, 2.5, 0.7) FROM t WHERE t MATCH ?", (match,)).fetchall())
        assert {d for a, d in got if a == q} == set(want)
        assert all(got[q, d] == pytest.approx(s, rel=1e-9) for d, s in want.items())


def world(spark):
    pages = [(i, f"https://cs.example/{c}/{p}", None, t, [], s, k, place, True, NOW - 1, 0.0) for i, (c, p, t, s, k, place) in enumerate([("cse452", "calendar.html", "Schedule", "rpc lecture five", "html", 1), ("cse452", "l05.pdf", None, "", "pdf", 1), ("cse333", "calendar.html", "Schedule", "rpc lecture five", "html", 2), ("feed", "x", "rpc lecture feed", "rpc", "html", 3)])]
    schema = "page_id long, url string, name string, title string, headings array<string>, snippet string, kind string, place_id long, visited boolean, last_visit double, revisit double"
    links = spark.createDataFrame([(0, 1, "slides", "Oct 3 · Lecture 5 · RPC", 0)], "from_id long, to_id long, anchor string, context string, link_seq long")
    spots = spark.createDataFrame([(1, "https://cs.example", "/cse452/", "cse452", 0.9, "active"), (2, "https://cs.example", "/cse333/", "cse333", 0.05, "dropped"), (3, "https://cs.example", "/feed/", "feed", 0.9, "hub")], "place_id long, origin string, path_prefix string, alias string, revisit double, status string")
    return spark.createDataFrame([(p[0], p[1], p[2], p[3], p[4], p[5], p[6], p[7], p[8], p[9], p[10]) for p in pages], schema), links, spots


def test_retrieve_rerank_evaluate(spark):
    picks = spark.createDataFrame([(1, "rpc lecture", 0), (2, "other words", 2)], "pick_id long, query string, page_id long")
    idx = search.Index(*world(spark), picks)
    queries = spark.createDataFrame([(7, "cse 452 lecture 5 rpc"), (8, "???"), (9, "rpc lecture")], "query_id long, query string")
    found = idx.retrieve(queries, NOW).orderBy("query_id", "rank").collect()
    assert [r.page_id for r in found if r.query_id == 7][0] in (0, 1) and not any(r.page_id == 3 for r in found)
    assert {r.query_id for r in found} == {7, 9} and {r.n_picks for r in found if r.page_id == 0} == {1}
    shown = {r.page_id: (r.label, r.description) for r in idx.described(idx.retrieve(queries, NOW)).collect()}
    assert shown[1][0] == "Oct 3 · Lecture 5 · RPC — slides" and shown[1][1].startswith("Oct 3 · Lecture 5 · RPC — slides | cse452 › cs.example/cse452/l05.pdf | pdf")
    turned = search.search(idx, queries, NOW, lambda q, c: '{"choice": "c1"}').collect()
    assert all(r.probability == 1.0 for r in turned) and all(r.place == 1 for r in turned)
    failing = search.search(idx, queries, NOW, lambda q, c: 1 / 0).orderBy("query_id", "place").collect()
    assert [r.page_id for r in failing] == [r.page_id for r in search.search(idx, queries, NOW).orderBy("query_id", "place").collect()]
    cases = {r.case_id: r for r in search.evaluate(idx, NOW).collect()}
    assert cases[1].hit5 and not cases[2].hit1 and cases[2].got is None
    alone = idx.retrieve(queries.where("query_id = 9"), NOW).orderBy("rank").collect()
    assert [(r.page_id, r.score) for r in alone] == [(r.page_id, r.score) for r in found if r.query_id == 9]


def test_recent_pages_and_their_neighbours(spark):
    rows = [(0, True, NOW), (1, True, NOW - 60 * DAY), (2, False, None), (3, False, None), (4, False, None)]
    pages = spark.createDataFrame(rows, "page_id long, visited boolean, last_visit double")
    links = spark.createDataFrame([(0, 2), (2, 3), (1, 4), (0, 1)], "from_id long, to_id long")
    assert {r.page_id for r in graph.recent_or_near(pages, links, NOW).collect()} == {0, 2}
    assert graph.recent_or_near(pages, links, NOW, None).count() == 5


def test_jobs(spark):
    posts = spark.createDataFrame([(1, "crawl", "a"), (2, "crawl", "a"), (3, "crawl", "b"), (4, "crawl", None), (5, "crawl", None)], "post_id long, type string, key string")
    pending = spark.createDataFrame([("crawl", "b"), ("name", "a")], "type string, key string")
    assert sorted(r.post_id for r in jobs.accepted(posts, pending).collect()) == [1, 4, 5]


def test_crawl(spark):
    site = "https://h.example"
    pages = spark.createDataFrame([(f"{site}/c/", True, "text", None), (f"{site}/c/old", False, None, NOW - 10.0), (f"{site}/c/read", True, "text", None)], "url string, visited boolean, snippet string, crawled_at double")
    targets = [(f"{site}/c/", f"{site}{p}", i) for i, p in enumerate(["/top", "/c/a", "/c/old", "/c/read", "/c/x.pdf", "/c/logout", "/c/b"])] + [(f"{site}/c/", "https://o.example/c/z", 9)]
    rows = spark.createDataFrame(targets, "from_url string, url string, link_seq int")
    turns = [(r.url.removeprefix(site), r.relation) for r in crawl.budgeted(crawl.frontier(rows, pages, NOW), 2).orderBy("turn").collect()]
    assert turns == [("/c/a", "deeper"), ("/c/b", "deeper")]

    def fetch(url):
        if url.endswith("a"):
            return 200, "text/html", url, "<title>T</title><body>words</body>"
        if url.endswith("b"):
            return 200, "text/html", url, "<input name=p type=password>"
        raise OSError(url)

    got = {r.url.removeprefix(site): (r.fetch_status, r.kind, r.title) for r in crawl.recorded(crawl.fetched(rows, fetch), pages, NOW).collect()}
    assert got["/c/a"] == (200, "html", "T") and got["/c/b"] == (401, None, None) and got["/top"] == (0, None, None)
    robots = spark.createDataFrame([(site, 200, "User-agent: *\nDisallow: /c/"), ("https://o.example", 503, None)], "origin string, status int, body string")
    ok = {r.url for r in crawl.allowed(rows, robots).where("allowed").collect()}
    assert ok == {f"{site}/top"}
    assert DEFAULT.page_budget == 50
