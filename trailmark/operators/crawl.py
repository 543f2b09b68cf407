"""One-hop crawl: which links of a page to save, which to fetch, and what to keep of what came back.

Fetching is a function (url -> status, content_type, final_url, body) that runs in the tasks (operators.fetch has the
one for the web), or a table of replies.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import batched
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..functions import html as H
from ..functions import urls
from ..sources.shared import settled
from .fetch import AGENT, DELAY_S, Robots, politely

REPLY = "url string, status int, content_type string, final_url string, body string"
#: Replies that a task holds at once.
REPLIES = 128


def requests(captures: DataFrame, pages: DataFrame, now: float, refresh_s: float = DEFAULT.refresh_s) -> DataFrame:
    """Captured pages (url, n_links) to post a crawl for: with links, and not crawled within refresh_s."""
    fresh = pages.where(F.col("crawled_at") > now - refresh_s).select("url")
    return captures.where("n_links > 0").join(fresh, "url", "left_anti").select(*captures.columns)


def policy(status: Column) -> Column:
    """What a robots.txt reply's status means: deny, allow, unknown (deny, and ask again) or parse."""
    s = F.coalesce(status, F.lit(0))
    return F.when((s == 0) | (s >= 500), "unknown").when(s.isin(401, 403), "deny").when(s >= 400, "allow").otherwise("parse")


def allowed(targets: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """targets (with url) and `allowed`. robots: origin, status, body; an origin without a reply is unknown."""
    known = robots.select(F.col("origin").alias("__origin"), policy(F.col("status")).alias("__policy"), F.col("body").alias("__body"))
    rows = targets.join(known, urls.origin(F.col("url")) == F.col("__origin"), "left")

    @F.pandas_udf(T.BooleanType())
    def can_fetch(url: pd.Series, body: pd.Series) -> pd.Series:
        read: dict[str, RobotFileParser] = {}

        def one(u, b):
            if b not in read:
                read[b] = RobotFileParser()
                read[b].parse((b or "").splitlines())
            return read[b].can_fetch(agent, u)

        return pd.Series([one(u, b) for u, b in zip(url, body)], dtype="bool")

    ok = F.when(F.col("__policy") == "allow", True).when(F.col("__policy") == "parse", can_fetch("url", "__body")).otherwise(False)
    return rows.withColumn("allowed", ok).drop("__origin", "__policy", "__body")


def frontier(targets: DataFrame, pages: DataFrame, now: float, refresh_s: float = DEFAULT.refresh_s) -> DataFrame:
    """Targets (from_url, url, link_seq) worth fetching, with their relation: pages of the same site that are no
    actions, not read already and not crawled within refresh_s."""
    url, start = F.col("url"), F.col("from_url")
    right = targets.where((urls.origin(url) == urls.origin(start)) & ~urls.is_action(url) & (urls.kind(url) == "html"))
    done = (F.col("visited") & (F.coalesce("snippet", F.lit("")) != "")) | (F.col("crawled_at") > now - refresh_s)
    done = pages.where(F.coalesce(done, F.lit(False))).select("url")
    rows = right.join(done, "url", "left_anti").select(*targets.columns)
    return rows.withColumn("relation", urls.relation(start, url, urls.origin(start), F.lit("/")))


def budgeted(rows: DataFrame, budget: int = DEFAULT.page_budget) -> DataFrame:
    """The first `budget` of each page's frontier: deeper links first, then in page order; numbered by turn."""
    order = Window.partitionBy("from_url").orderBy(F.col("relation") != "deeper", "link_seq", "url")
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= budget)


def discovered(targets: DataFrame, pages: DataFrame, scopes: DataFrame) -> DataFrame:
    """url, kind, place_scope of targets that are not yet known pages; the scope of the first page that links there
    (job order, then link order), if the target lies in it. scopes: from_url, origin, path_prefix."""
    new = targets.join(pages.select("url"), "url", "left_anti").select(*targets.columns)
    first = new.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("job_id", "link_seq"))).where("r = 1")
    rows = first.join(scopes.dropDuplicates(["from_url"]), "from_url", "left")
    inside = urls.in_scope(F.col("url"), F.col("origin"), F.col("path_prefix"))
    return rows.select("url", urls.kind(F.col("url")).alias("kind"), F.when(inside, F.concat("origin", "path_prefix")).alias("place_scope"))


def fetched(targets: DataFrame, fetch: Callable[[str], tuple], delay_s: float = 0.0, robots: Robots | None = None) -> DataFrame:
    """REPLY of each target's url (in the order of `turn`, if there is one); a failure is status 0. A site's targets are
    fetched by one task, with delay_s between them, as far as `robots` allows them."""

    def run(batches):
        for batch in batches:
            wanted = (u for u in batch["url"] if robots is None or robots.allowed(u))
            for some in batched(politely(wanted, fetch, delay_s), REPLIES):
                yield pd.DataFrame(some, columns=["url", "status", "content_type", "final_url", "body"])

    turn = F.col("turn") if "turn" in targets.columns else F.lit(0)
    rows = targets.select("url", urls.origin(F.col("url")).alias("site"), turn.alias("turn"))
    return rows.repartition("site").sortWithinPartitions("site", "turn", "url").select("url").mapInPandas(run, REPLY)


PAYLOAD = "url string, links array<array<string>>, _key string"


def job_links(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, from_url, url, anchor, context, link_seq: the links in the jobs' payloads, normalised; of a page's links to
    one target the first with a text, else the first; none to the page itself."""
    rows = jobs.select("job_id", F.from_json("payload", PAYLOAD).alias("p")).select("job_id", F.col("p.url").alias("from_url"), F.posexplode("p.links").alias("link_seq", "l"))
    part = lambda i: F.coalesce(F.get("l", F.lit(i)), F.lit(""))
    rows = rows.select("job_id", "from_url", urls.normalize(part(0)).alias("url"), part(1).alias("anchor"), part(2).alias("context"), "link_seq")
    rows = rows.where("url is not null and url != from_url")
    best = F.struct(F.col("anchor") == "", "link_seq")
    return rows.groupBy("job_id", "from_url", "url").agg(F.min_by("anchor", best).alias("anchor"), F.min_by("context", best).alias("context"), F.min("link_seq").alias("link_seq"))


def run_jobs(jobs: DataFrame, pages: DataFrame, places: DataFrame, now: float, fetch: Callable[[str], tuple], robots: Robots | None = None, delay_s: float = DELAY_S, budget: int = DEFAULT.page_budget) -> dict[str, DataFrame]:
    """What crawling these jobs (job_id, payload: JSON of url and links [[href, anchor, context]]) gives: `links` (their
    links), `discovered` (pages that are new), `recorded` (what to write of the pages that were fetched), `finished`
    (job_id, status, error) and `counts` (jobs, failed, fetched, discovered). pages: url, place_id, visited, snippet,
    crawled_at."""
    read = F.from_json("payload", PAYLOAD)
    jobs = settled(jobs.select("job_id", "payload", F.coalesce(read["url"].isNotNull() & read["links"].isNotNull(), F.lit(False)).alias("ok")))
    links = settled(job_links(jobs.where("ok"), pages))
    home = pages.join(places.select("place_id", "origin", "path_prefix"), "place_id").select(F.col("url").alias("from_url"), "origin", "path_prefix")
    found = settled(discovered(links, pages, home))
    wanted = frontier(links.select("job_id", "from_url", "url", "link_seq"), pages, now)
    once = budgeted(wanted, budget).groupBy("url").agg(F.min("turn").alias("turn"))
    kept = settled(recorded(settled(fetched(once, fetch, delay_s, robots)), pages, now))
    finished = jobs.select("job_id", F.when(F.col("ok"), "done").otherwise("failed").alias("status"), F.when(~F.col("ok"), "no url or links in the payload").alias("error"))
    counts = finished.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))
    for name, rows in (("fetched", kept), ("discovered", found)):
        counts = counts.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return {"links": links, "discovered": found, "recorded": kept, "finished": finished, "counts": counts}


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_html(content_type: Column) -> Column:
    return media_type(content_type).isin("text/html", "application/xhtml+xml")


def content_kind(content_type: Column) -> Column:
    media = media_type(content_type)
    return F.when(media == "application/pdf", "pdf").when(media != "", "file")


def recorded(replies: DataFrame, pages: DataFrame, now: float, key: str = "url") -> DataFrame:
    """url, crawled_at, fetch_status, kind, title, snippet, headings: the columns to write for each reply; null: leave
    as it is. A sign-in page counts as 401, and text read in the browser is not replaced. key: what pages and replies
    have in common."""
    rows = replies.withColumn("login", H.has_login_form(F.col("body")))
    page = (F.col("status") == 200) & is_html(F.col("content_type")) & F.col("body").isNotNull()
    rows = rows.withColumns({"page": page & ~F.col("login"), "fetch_status": F.when(page & F.col("login"), 401).otherwise(F.col("status"))})
    rows = rows.withColumn("parsed", H.parsed(F.when(F.col("page"), F.col("body")), F.coalesce(F.nullif("final_url", F.lit("")), "url")))
    read = pages.where(F.col("visited") & (F.coalesce("snippet", F.lit("")) != "")).select(key).distinct().withColumn("read", F.lit(True))
    rows = rows.join(read, key, "left")
    take = F.col("page") & F.col("read").isNull()
    other = F.when((F.col("fetch_status") == 200) & ~F.col("page"), content_kind(F.col("content_type")))
    return rows.select(
        "url",
        F.lit(float(now)).alias("crawled_at"),
        "fetch_status",
        F.when(F.col("page"), "html").otherwise(other).alias("kind"),
        F.when(take, F.col("parsed.title")).alias("title"),
        F.when(take, F.col("parsed.snippet")).alias("snippet"),
        F.when(take, F.col("parsed.headings")).alias("headings"),
    )
