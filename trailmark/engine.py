"""The engine over a catalog: what each command does to the stored relations. Every step is one commit."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import crawl, fetch, graph, index, jobs, naming, search, watch
from .sources import store
from .sources.shared import settled

log = logging.getLogger(__name__)

#: Schemas of the stored relations; one that was never written is empty.
RELATIONS = {
    "visits": "user_id long, event_id long, ts_s double, url string, duration_s double, from_url string",
    "pages": "page_id long, url string, kind string, name string, title string, headings array<string>, snippet string, place_id long, visited boolean, "
    "last_visit double, revisit double, crawled_at double, fetch_status int, dirty boolean",
    "links": "from_id long, to_id long, anchor string, context string, link_seq long",
    "places": "place_id long, origin string, path_prefix string, scope string, alias string, revisit double, status string, features string",
    "picks": "pick_id long, query string, page_id long, ts_s double",
    "jobs": "job_id long, type string, payload string, status string, attempts int, created_at double, started_at double, finished_at double, error string",
    "meta": "key string, value string",
    "postings": "doc_id long, field string, pos int, token string",
    "scored_places": "user_id long, scope string, status string, revisit double, first_visit double",
    "scored_pages": "user_id long, url string, scope string, visit_count long, last_visit double, revisit double",
}
FIELDS = list(DEFAULT.field_weights)


def read(catalog: store.Catalog, name: str) -> DataFrame:
    """A relation, with all columns of its schema: those that were not stored are null."""
    rows = catalog.read(name, RELATIONS[name])
    missing = [c.strip().split(" ", 1) for c in RELATIONS[name].split(", ") if c.strip().split(" ", 1)[0] not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in missing}) if missing else rows


def set_meta(catalog: store.Catalog, key: str, value: str) -> None:
    new = catalog.spark.createDataFrame([(key, value)], RELATIONS["meta"])
    catalog.write("meta", store.upsert(read(catalog, "meta"), new, ["key"], ["value"]))


def get_meta(catalog: store.Catalog, key: str) -> str | None:
    row = read(catalog, "meta").where(F.col("key") == key).first()
    return row and row["value"]


def add_visits(catalog: store.Catalog, new: DataFrame) -> None:
    """Appends visits as the stream gives them (user_id, url, title, start_s, duration_s, from_url)."""
    old = read(catalog, "visits")
    last = old.agg(F.coalesce(F.max("event_id"), F.lit(-1)).alias("__last"))
    rows = settled(new.withColumn("event_id", F.monotonically_increasing_id())).join(F.broadcast(last))  # one row
    rows = rows.select("user_id", (F.col("__last") + 1 + F.col("event_id")).alias("event_id"), F.col("start_s").alias("ts_s"), "url", "duration_s", "from_url")
    catalog.write("visits", old.select(*rows.columns).unionByName(rows))


def pick(catalog: store.Catalog, query: str, page_id: int, now: float) -> None:
    catalog.write("picks", search.recorded_pick(read(catalog, "picks"), query, page_id, now))


def run_watch(catalog: store.Catalog, now: float) -> DataFrame:
    found, pages, gone = watch.Cycle(read(catalog, "visits"), now).changes(read(catalog, "scored_places"), read(catalog, "scored_pages"))
    catalog.write_all({"scored_places": found, "changed_pages": pages, "retired_places": gone})
    return watch.summary(catalog.read("scored_places"))


def run_name(catalog: store.Catalog) -> DataFrame:
    """Gives pages their names; returns what changed (url, name). Renamed pages are to be indexed again."""
    pages = read(catalog, "pages")
    new = naming.names(pages, read(catalog, "links")).where("name != ''")
    changed = settled(store.changed(new, pages.select("url", "name"), ["url"], ["name"]))
    named = store.upsert(pages, changed.withColumn("dirty", F.lit(True)), ["url"], ["name", "dirty"])
    catalog.write("pages", named)
    return changed


def sync_index(catalog: store.Catalog) -> int:
    """Indexes the pages that are dirty, and says how many they were. A page that was never indexed is."""
    pages = read(catalog, "pages")
    dirty = settled(pages.where(F.coalesce("dirty", F.lit(True))))
    n = dirty.count()
    if n:
        texts = graph.link_texts(read(catalog, "links").join(dirty.select(F.col("page_id").alias("to_id")), "to_id", "left_semi"))
        posts = index.updated_postings(read(catalog, "postings"), index.page_fields(dirty, texts), "page_id", FIELDS)
        catalog.write_all({"postings": posts, "pages": pages.withColumn("dirty", F.lit(False))})
    return n


def open_index(catalog: store.Catalog) -> search.Index:
    """The index in place, brought up to date."""
    sync_index(catalog)
    return search.Index(*(read(catalog, n) for n in ("pages", "links", "places", "picks")), posts=read(catalog, "postings"))


def post_jobs(catalog: store.Catalog, new: DataFrame, now: float) -> None:
    """Posts jobs: type, payload (JSON), key (null: never a repeat), in the order of post_id."""
    old = read(catalog, "jobs")
    pending = old.where("status = 'pending'").select("type", jobs.payload_key(F.col("payload")).alias("key"))
    fresh = jobs.accepted(new.select("post_id", "type", "payload", "key"), pending)
    last = old.agg(F.coalesce(F.max("job_id"), F.lit(-1)).alias("__last"))
    rows = fresh.join(F.broadcast(last)).select(  # one row
        (F.col("__last") + 1 + F.col("post_id")).alias("job_id"), "type", jobs.with_key(F.col("payload"), F.col("key")).alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(float(now)).alias("created_at")
    )
    catalog.write("jobs", old.unionByName(rows, allowMissingColumns=True))


def requeue(catalog: store.Catalog, now: float, older_s: float = 3600) -> int:
    """Makes jobs pending again that have run for too long; says how many."""
    rows = settled(jobs.requeued(read(catalog, "jobs"), now, older_s))
    n = rows.where("requeued").count()
    if n:
        catalog.write("jobs", rows.drop("requeued"))
    return n


def run_crawl(catalog: store.Catalog, now: float, get: fetch.Fetch = fetch.fetch, max_jobs: int = 1 << 20, delay_s: float = fetch.DELAY_S, robots: fetch.Robots | None = None) -> dict[str, int]:
    """Runs pending crawl jobs: saves their links, fetches what they lead to. Counts of jobs, failed, fetched, discovered."""
    queue, pages, links, places = (read(catalog, n) for n in ("jobs", "pages", "links", "places"))
    claimed = settled(jobs.claimed(queue, ["crawl"], max_jobs, now))
    found = crawl.run_jobs(claimed, pages, places, now, get, robots or fetch.Robots(get), delay_s)
    starts = found["links"].select("from_url").distinct()
    scope = places.select(F.col("scope").alias("place_scope"), "place_id").dropDuplicates(["place_scope"])
    unknown = starts.withColumnRenamed("from_url", "url").join(pages.select("url"), "url", "left_anti").select("url", F.lit("html").alias("kind"), F.lit(None).cast("string").alias("place_scope"))
    fresh = found["discovered"].select("url", "kind", "place_scope").union(unknown).dropDuplicates(["url"]).join(scope, "place_scope", "left")
    last = pages.agg(F.coalesce(F.max("page_id"), F.lit(-1)).alias("__last"))
    fresh = settled(fresh.withColumn("n", F.monotonically_increasing_id())).join(F.broadcast(last))  # one row
    fresh = fresh.select((F.col("__last") + 1 + F.col("n")).alias("page_id"), "url", "kind", "place_id", F.lit(False).alias("visited"), F.lit(0.0).alias("revisit"))
    every = settled(pages.unionByName(fresh, allowMissingColumns=True))

    got = found["recorded"].select("url", *(F.col(c).alias(f"__{c}") for c in ("crawled_at", "fetch_status", "kind", "title", "snippet", "headings")))
    to = found["links"].select("url").distinct().withColumn("__linked", F.lit(True))
    crawled = starts.select(F.col("from_url").alias("url"), F.lit(float(now)).alias("__started"))
    rows = every.join(got, "url", "left").join(to, "url", "left").join(crawled, "url", "left")
    newer = {c: F.coalesce(f"__{c}", c) for c in ("fetch_status", "kind", "title", "snippet", "headings")}
    newer |= {"crawled_at": F.coalesce("__started", "__crawled_at", "crawled_at"), "dirty": F.col("__linked").isNotNull() | F.col("__crawled_at").isNotNull() | F.coalesce("dirty", F.lit(True))}
    rows = rows.withColumns(newer).select(*every.columns)

    ids = every.select("page_id", "url")
    ends = found["links"].join(ids.select(F.col("page_id").alias("from_id"), F.col("url").alias("from_url")), "from_url").join(ids.select(F.col("page_id").alias("to_id"), "url"), "url")
    saved = store.upsert_links(links, ends.select("from_id", "to_id", "anchor", "context", F.col("link_seq").cast("long").alias("link_seq")))
    ended = found["finished"].select("job_id", "status", "error", F.lit(float(now)).alias("finished_at"))
    after = store.upsert(queue, claimed.select("job_id", "attempts", "started_at").join(ended, "job_id"), ["job_id"], ["status", "attempts", "started_at", "finished_at", "error"])
    catalog.write_all({"pages": rows, "links": saved, "jobs": after})
    return found["counts"].first().asDict()


def cycle(catalog: store.Catalog, now: float, get: fetch.Fetch = fetch.fetch, ingest: Callable[[], None] | None = None) -> dict:
    """What the background does: new visits, places and scores, names, pending crawls, the index."""
    if ingest:
        ingest()
    run_watch(catalog, now)
    return {"named": run_name(catalog).count(), "crawl": run_crawl(catalog, now, get), "indexed": sync_index(catalog)}


def run(catalog: store.Catalog, stop: threading.Event, period_s: float = 300.0, clock: Callable[[], float] = time.time, **how) -> int:
    """Cycles until `stop` is set. A cycle that fails is logged, and the next one comes all the same. How many there were."""
    n = requeue(catalog, clock())
    if n:
        log.info("%d jobs are pending again", n)
    cycles = 0
    while not stop.is_set():
        try:
            log.info("cycle: %s", cycle(catalog, clock(), **how))
        except Exception:  # noqa: BLE001
            log.exception("a cycle failed")
        cycles += 1
        stop.wait(period_s)
    return cycles
