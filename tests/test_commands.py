"""Fetching from a server on this machine, and the commands over a small catalog."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest

from trailmark import __main__ as cli
from trailmark import engine
from trailmark.operators import fetch
from trailmark.sources import keys, store
from trailmark.streaming import visits as stream

NOW, DAY = 1_790_000_000.0, 86400.0


class Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        kind, body, status = {
            "/robots.txt": ("text/plain", b"User-agent: *\nDisallow: /c/private/", 200),
            "/c/a.html": ("text/html; charset=iso-8859-1", "<title>Caf\xe9</title>".encode("latin-1"), 200),
            "/c/big": ("text/html", b"x" * (6 << 20), 200),
            "/c/odd": ("text/html; charset=no-such", b"ok", 200),
            "/c/pdf": ("application/pdf", b"%PDF", 200),
            "/c/moved": ("text/html", b"", 302),
        }.get(self.path, ("text/html", b"gone", 404))
        self.send_response(status)
        self.send_header("content-type", kind)
        if status == 302:
            self.send_header("location", "/c/a.html")
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(site):
    assert fetch.fetch(f"{site}/c/a.html")[0] == 200 and "Café" in fetch.fetch(f"{site}/c/a.html")[3]
    assert len(fetch.fetch(f"{site}/c/big")[3]) == fetch.MAX_BYTES
    assert fetch.fetch(f"{site}/c/odd")[3] == "ok"
    assert fetch.fetch(f"{site}/c/pdf") == (200, "application/pdf", f"{site}/c/pdf", None)
    assert fetch.fetch(f"{site}/c/moved")[2] == f"{site}/c/a.html"
    assert fetch.fetch(f"{site}/none")[0] == 404
    assert fetch.fetch("http://127.0.0.1:9/") == (0, "", "http://127.0.0.1:9/", None)
    assert fetch.fetch("no url at all")[0] == 0
    robots = fetch.Robots()
    assert robots.allowed(f"{site}/c/a.html") and not robots.allowed(f"{site}/c/private/x")


def test_robots_are_kept_for_a_day_and_failures_are_not():
    asked, now, status = [], [0.0], [503]

    def get(url):
        asked.append(url)
        return status[0], "text/plain", url, "User-agent: *\nDisallow: /x"

    robots = fetch.Robots(get, clock=lambda: now[0])
    assert not robots.allowed("https://h.example/a") and not robots.allowed("https://h.example/a") and len(asked) == 2
    status[0] = 200
    assert robots.allowed("https://h.example/a") and not robots.allowed("https://h.example/x/1") and len(asked) == 3
    now[0] = fetch.ROBOTS_S
    status[0] = 403
    assert not robots.allowed("https://h.example/a") and len(asked) == 4
    status[0] = 404
    assert robots.allowed("https://other.example/x")


def test_requests_to_a_site_are_spaced():
    now, slept = [0.0], []

    def get(url):
        now[0] += 0.25
        if url.endswith("bad"):
            raise RuntimeError
        return 200, "", url, None

    def sleep(s):
        slept.append(s)
        now[0] += s

    urls = ["https://a.example/1", "https://a.example/bad", "https://b.example/1", "https://a.example/2"]
    got = list(fetch.politely(iter(urls), get, 1.0, lambda: now[0], sleep))
    assert [r[1] for r in got] == [200, 0, 200, 200] and slept == [1.0, 0.75]


def test_keys(tmp_path, monkeypatch):
    (tmp_path / "keys").write_text("# a comment\n#OFF=1\nA = one\nB='two words'\nno value\nC=\"x=y\"\nD=\n")
    assert keys.keys_file(tmp_path / "keys") == {"A": "one", "B": "two words", "C": "x=y", "D": ""}
    assert keys.keys_file(tmp_path / "none") == {}
    monkeypatch.setenv("B", "outside")
    assert (keys.key("A", tmp_path / "keys"), keys.key("B", tmp_path / "keys"), keys.key("Z", tmp_path / "keys")) == ("one", "outside", None)


class Kept:
    """State of a user's stream, without a stream."""

    hasTimedOut, value = False, None  # noqa: N815

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None


def test_late_ticks_and_many_tabs():
    state = Kept()
    tick = lambda i, t, tab, url: (i, t, tab, url, "x")

    def advance(*rows):
        frame = pd.DataFrame(rows, columns=["tick_id", "ts_s", "tab_id", "web_url", "title"])
        return [tuple(r)[1:] for f in stream._advance((1,), [frame], state) for r in f.itertuples(index=False)]

    assert advance(tick(1, 10.0, "a", "https://h.example/1"), tick(2, 20.0, "a", "https://h.example/1")) == []
    assert advance(tick(3, 5.0, "b", "https://late.example/")) == []
    assert advance(tick(4, 30.0, "a", "https://h.example/2")) == [("https://h.example/1", "x", 10.0, 20.0, None)]
    assert advance(tick(5, 40.0, "a", None)) == [("https://h.example/2", "x", 30.0, 10.0, "https://h.example/1")]
    advance(*(tick(10 + i, 100.0 + i, f"t{i}", f"https://h.example/{i}") for i in range(300)))
    assert len(json.loads(state.get[1])) <= stream.TABS + 1


def test_captures(spark):
    visits = spark.createDataFrame([(1, "u", 0.0, 20.0), (1, "v", 100.0, 2.0), (1, "w", 200.0, 30.0), (1, "x", 300.0, 60.0)], "user_id long, url string, start_s double, duration_s double")
    texts = [(1, 2.0, "u", "early"), (1, 3.5, "u", ""), (1, 10.0, "u", "between"), (1, 15.0, "u", "second"), (1, 18.0, "u", "third"), (1, 101.0, "v", "short"), (1, 204.0, "w", "first"), (1, 216.0, "w", "no more"), (1, 316.0, "x", None), (1, 320.0, "x", "")]
    got = stream.captures(visits, spark.createDataFrame(texts, "user_id long, ts_s double, url string, text string"))
    assert sorted((r.url, r.turn, r.ts_s, r.text) for r in got.collect()) == [("u", 0, 3.5, ""), ("u", 1, 15.0, "second"), ("w", 0, 204.0, "first"), ("x", 0, 316.0, ""), ("x", 1, 320.0, "")]


@pytest.fixture
def catalog(spark, tmp_path):
    out = store.Catalog(spark, str(tmp_path / "data"))
    pages = [(0, "https://cs.example/c/index.html", "html", None, "Schedule", ["Lectures"], "rpc lecture notes", 1, True, NOW - 1, 0.4), (1, "https://cs.example/c/old.html", "html", None, "Old page", [], "paxos", 1, True, NOW - 1, 0.1)]
    schema = "page_id long, url string, kind string, name string, title string, headings array<string>, snippet string, place_id long, visited boolean, last_visit double, revisit double"
    places = [(1, "https://cs.example", "/c/", "https://cs.example/c/", "c", 0.9, "active", '{"days": 3}')]
    visits = [(1, i, NOW - d * DAY, f"https://docs.example/guide/{i % 3}.html", 60.0, None) for i, d in enumerate(range(9))]
    links = [[["https://cs.example/c/l1.html#x", "", "r"], ["https://cs.example/c/l1.html", "Lecture 1", "Oct 3"], ["https://cs.example/c/l1.pdf", "slides", ""], ["https://other.example/", "o", ""], ["mailto:a@b.c", "m", ""], ["https://cs.example/c/index.html", "self", ""]]]
    out.write_all(
        {
            "pages": spark.createDataFrame(pages, schema),
            "places": spark.createDataFrame(places, engine.RELATIONS["places"]),
            "visits": spark.createDataFrame(visits, engine.RELATIONS["visits"]),
        }
    )
    post = [(i, "crawl", p, k) for i, (p, k) in enumerate([(json.dumps({"url": pages[0][1], "links": links[0]}), "k"), (json.dumps({"url": "dup", "links": []}), "k"), ("broken", None)])]
    engine.post_jobs(out, spark.createDataFrame(post, "post_id long, type string, payload string, key string"), NOW)
    return out


def replies():
    """A function that tasks can load without this module."""

    def reply(url):
        if url.endswith("robots.txt"):
            return 404, "", url, None
        return 200, "text/html", url, "<title>Lecture one</title><body>remote procedure calls, explained</body>"

    return reply


def test_crawl_index_and_search(spark, catalog, capsys):
    assert engine.read(catalog, "jobs").count() == 2
    counts = engine.run_crawl(catalog, NOW, replies(), delay_s=0.0)
    assert counts == {"jobs": 2, "failed": 1, "fetched": 1, "discovered": 3}
    assert {r.status for r in engine.read(catalog, "jobs").collect()} == {"done", "failed"}
    pages = {r.url: r for r in engine.read(catalog, "pages").collect()}
    assert len(pages) == 5 and len({p.page_id for p in pages.values()}) == 5
    lecture = pages["https://cs.example/c/l1.html"]
    assert (lecture.title, lecture.place_id, lecture.fetch_status, lecture.kind) == ("Lecture one", 1, 200, "html") and pages["https://cs.example/c/l1.pdf"].kind == "pdf"
    assert pages["https://other.example/"].place_id is None and pages["https://cs.example/c/index.html"].crawled_at == NOW
    links = {(r.to_id, r.anchor, r.context) for r in engine.read(catalog, "links").collect()}
    assert (lecture.page_id, "Lecture 1", "Oct 3") in links and len(links) == 3
    assert engine.run_crawl(catalog, NOW, replies(), delay_s=0.0)["jobs"] == 0
    assert engine.sync_index(catalog) == 5 and engine.sync_index(catalog) == 0
    engine.pick(catalog, "remote calls", lecture.page_id, NOW)
    assert engine.sync_index(catalog) == 0
    at = ["--data", catalog.root, "--now", str(NOW)]
    assert cli.main(["search", "lecture", "remote", *at]) == 0
    assert capsys.readouterr().out.startswith("1. Lecture 1\n   https://cs.example/c/l1.html\n")
    assert cli.main(["pick", str(lecture.page_id), "--query", "lecture one", *at]) == 0
    assert cli.main(["eval", *at]) == 0 and capsys.readouterr().out.startswith("2 past picks: the picked page came first in 100%")
    assert cli.main(["places", "--why", *at]) == 0
    assert capsys.readouterr().out == '0.90  active       4 pages  https://cs.example/c/\n      {"days": 3}\n'
    assert cli.main(["name", "--json", *at]) == 0
    assert {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()} >= {"Lecture 1", "Schedule"}
    assert engine.sync_index(catalog) > 0


def test_background_cycles(spark, catalog, capsys, tmp_path):
    jobs = engine.read(catalog, "jobs")
    catalog.write("jobs", store.upsert(jobs, spark.createDataFrame([(0, "running", NOW - 9 * DAY)], "job_id long, status string, started_at double"), ["job_id"], ["status", "started_at"]))
    stop = threading.Event()
    turns = []

    def ingest():
        turns.append(1)
        if len(turns) == 1:
            raise RuntimeError("the first cycle fails")
        stop.set()

    assert engine.run(catalog, stop, 0.0, lambda: NOW, get=replies(), ingest=ingest) == 2
    assert {r.status for r in engine.read(catalog, "jobs").collect()} == {"done", "failed"}
    assert {r.scope for r in engine.read(catalog, "scored_places").collect()} == {"https://docs.example/guide/"}
    engine.set_meta(catalog, "a", "1")
    engine.set_meta(catalog, "a", "2")
    assert engine.get_meta(catalog, "a") == "2" and engine.get_meta(catalog, "b") is None
    ticks = [(1, i, NOW + 10 * i, "t", False, f"https://new.example/{i}", "x") for i in range(3)]
    spark.createDataFrame(ticks, "user_id long, tick_id long, ts_s double, tab_id string, incognito boolean, url string, title string").write.parquet(str(tmp_path / "ticks"))
    before = engine.read(catalog, "visits").count()
    assert cli.main(["monitor", "--ticks", str(tmp_path / "ticks"), "--data", catalog.root]) == 0
    rows = engine.read(catalog, "visits")
    assert rows.count() == before + 2 and rows.select("event_id").distinct().count() == before + 2
    assert cli.main(["service", "--data", "/x"]) == 0 and "trailmark daemon --data /x" in capsys.readouterr().out
