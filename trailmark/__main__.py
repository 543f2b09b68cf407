"""python -m trailmark COMMAND --data FOLDER: the engine over stored relations.

FOLDER is a sources.store.Catalog; engine.RELATIONS says what is in it. Results are printed as JSON lines with --json,
else as text.
"""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading
import time
import webbrowser

from pyspark.sql import functions as F

from . import engine
from .operators import search
from .session import session
from .sources import store
from .streaming import visits as stream

SERVICE = """[Unit]
Description=Trailmark background cycle

[Service]
ExecStart={python} -m trailmark daemon --data {data}
Restart=on-failure

[Install]
WantedBy=default.target
"""


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="trailmark")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        c.add_argument("--data", required=True)
        c.add_argument("--now", type=float, default=None)
        c.add_argument("--json", action="store_true")
        return c

    command("watch", "places and scores from the recorded visits")
    command("name", "short names of pages")
    command("crawl", "run pending crawl jobs").add_argument("--max-jobs", type=int, default=1 << 20)
    c = command("places", "places and their scores")
    c.add_argument("--status", nargs="+", default=["active", "probation"])
    c.add_argument("--limit", type=int, default=30)
    c.add_argument("--why", action="store_true")
    c = command("search", "find a page")
    c.add_argument("query", nargs="+")
    c.add_argument("--open", action="store_true")
    c = command("pick", "record that a result was opened")
    c.add_argument("page_id", type=int)
    c.add_argument("--query", required=True)
    command("eval", "replay past picks")
    c = command("monitor", "visits from a folder of ticks (Parquet), as they come")
    c.add_argument("--ticks", required=True)
    command("daemon", "all background work, until stopped").add_argument("--period", type=float, default=300.0)
    command("service", "print a service file that runs the daemon")
    return out


def ingest(catalog: store.Catalog, ticks: str) -> None:
    """Takes up what is new in the folder of ticks."""
    schema = "user_id long, tick_id long, ts_s double, tab_id string, incognito boolean, url string, title string"
    rows = catalog.spark.readStream.schema(schema).parquet(ticks)
    stream.ingest(rows, lambda batch, _: engine.add_visits(catalog, batch), f"{catalog.root}/monitor").awaitTermination()


def opened(catalog: store.Catalog, query: str, results: list, now: float) -> None:
    turn = input("which? [1] ").strip() or "1"
    chosen = results[int(turn) - 1]
    engine.pick(catalog, query, chosen["page_id"], now)
    webbrowser.open(chosen["url"])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    now = time.time() if args.now is None else args.now
    if args.command == "service":
        print(SERVICE.format(python=sys.executable, data=args.data), end="")
        return 0
    catalog = store.Catalog(session(), args.data)

    def show(rows: list, line) -> None:
        for i, row in enumerate(rows, 1):
            print(json.dumps(row) if args.json else line(i, row))

    if args.command == "watch":
        show([r.asDict() for r in engine.run_watch(catalog, now).collect()], lambda _, r: ", ".join(f"{k}: {v}" for k, v in r.items()))
    elif args.command == "name":
        show([r.asDict() for r in engine.run_name(catalog).toLocalIterator()], lambda _, r: f"{r['name']}  {r['url']}")
    elif args.command == "crawl":
        show([engine.run_crawl(catalog, now, max_jobs=args.max_jobs)], lambda _, r: ", ".join(f"{k}: {v}" for k, v in r.items()))
    elif args.command == "places":
        n = engine.read(catalog, "pages").groupBy("place_id").agg(F.count(F.lit(1)).alias("pages"))
        rows = engine.read(catalog, "places").where(F.col("status").isin(args.status)).join(n, "place_id", "left").orderBy(F.desc("revisit"), "scope").limit(args.limit)
        why = lambda r: f"\n      {r['features']}" if args.why and r["features"] else ""
        show([r.asDict() for r in rows.collect()], lambda _, r: f"{r['revisit']:.2f}  {r['status']:<10}{r['pages'] or 0:>4} pages  {r['scope']}{why(r)}")
    elif args.command == "search":
        index, query = engine.open_index(catalog), " ".join(args.query)
        asked = catalog.spark.createDataFrame([(0, query)], "query_id long, query string")
        found = [r.asDict() for r in index.described(search.search(index, asked, now)).orderBy("place").collect()]
        sure = lambda r: "" if r["probability"] is None else f"  ({r['probability']:.2f})"
        show(found, lambda i, r: f"{i}. {r['label']}{sure(r)}\n   {r['url']}")
        if args.open and found:
            opened(catalog, query, found, now)
    elif args.command == "pick":
        engine.pick(catalog, args.query, args.page_id, now)
    elif args.command == "eval":
        index = engine.open_index(catalog)
        cases = search.evaluate(index, now)
        say = lambda _, r: f"{r['cases']} past picks: the picked page came first in {r['top1']:.0%}, among the first five in {r['top5']:.0%}"
        show([r.asDict() for r in search.summary(cases).collect()], say)
        missed = cases.where("not hit1").join(index.picks.select(F.col("pick_id").alias("case_id"), "query"), "case_id").orderBy("case_id")
        show([r.asDict() for r in missed.select("query", "picked", "got").toLocalIterator()], lambda _, r: f"  {r['query']!r}: page {r['picked']} was picked, page {r['got']} came first")
    elif args.command == "monitor":
        ingest(catalog, args.ticks)
    elif args.command == "daemon":
        stop = threading.Event()
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
        engine.run(catalog, stop, args.period)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
