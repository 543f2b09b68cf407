"""The relations that queries run on, derived from the driver tables: visits, ticks, pages, links, places, picks, jobs.

`NOW` is fixed. Each relation covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls
from .shared import settled

NOW = 1706659200.0  # 2024-01-31 00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col(ts)) / 1_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.withColumns({"k": k, "ts_s": seconds("ts")})


def _url() -> Column:
    k, kind = F.col("k"), F.col("event_type")
    site = F.concat(F.lit("https://site"), k % 6, F.lit(".example"))
    return (
        F.when(kind == "click", F.concat(F.lit("https://search.example/s?q="), k))
        .when(kind == "view", F.concat(site, F.lit("/courses/c"), k % 4, F.lit("/lectures/l"), k % 10, F.lit(".html")))
        .when(kind == "purchase", F.concat(site, F.lit("/shop/orders/"), k))
        .when(kind == "signup", F.concat(site, F.lit("/account")))
        .otherwise(F.concat(F.lit("https://sso.example/login?step="), k % 2))
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts_s, url, duration_s, from_url."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts_s", _url().alias("url"), F.col("value").alias("duration_s"))
    return rows.withColumn("from_url", F.lag("url").over(Window.partitionBy("user_id").orderBy("ts_s", "event_id")))


def stand_in_places(rows: DataFrame) -> DataFrame:
    """visits with scope = origin and directory, in place of the grouping where a query is about features only."""
    return rows.withColumn("scope", F.concat(urls.origin(F.col("url")), urls.directory(F.col("url"))))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("url", _url())
    return rows.select("user_id", F.col("event_id").alias("tick_id"), "ts_s", F.concat(F.lit("t"), F.col("user_id") % 3 + F.col("k") % 2).alias("tab_id"), (F.col("k") % 17 == 0).alias("incognito"), "url", F.col("event_type").alias("title"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, parsed (struct of html.PARSED)."""
    rows = raw_pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("url"), "html")
    return rows.withColumn("parsed", H.parsed("html", "url"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parsed_pages without the HTML, for those who read them more than once."""
    return settled(parsed_pages(spark, sf_dir).drop("html"))


def pages(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """page_id, url, place_id, title, name, headings, snippet, kind, visited, visit_count, last_visit, revisit, crawled_at."""
    i = F.col("page_id")
    rows = parsed_pages(spark, sf_dir) if parsed is None else parsed
    place = F.min("page_id").over(Window.partitionBy(urls.host(F.col("url"))))
    return rows.withColumn("first", place).select(
        "page_id",
        "url",
        F.when(i % 4 != 3, F.col("first")).alias("place_id"),
        F.col("parsed.title").alias("title"),
        F.lit(None).cast("string").alias("name"),
        F.col("parsed.headings").alias("headings"),
        F.col("parsed.snippet").alias("snippet"),
        urls.kind(F.col("url")).alias("kind"),
        (i % 3 == 0).alias("visited"),
        F.when(i % 3 == 0, i % 5).otherwise(0).alias("visit_count"),
        F.when(i % 3 == 0, NOW - (i % 60) * 86400).alias("last_visit"),
        F.when(i % 3 == 0, (i * 13 % 100) / 100).otherwise(0.0).alias("revisit"),
        F.when(i % 7 == 0, NOW - (i % 3) * 43200).alias("crawled_at"),
    )


def html_links(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """page_id, link_seq, href, target (normalised), anchor, context of each link that leads to the web."""
    rows = (parsed_pages(spark, sf_dir) if parsed is None else parsed).select("page_id", "url", F.posexplode("parsed.links").alias("link_seq", "l"))
    rows = rows.select("page_id", "url", "link_seq", F.col("l.href").alias("href"), urls.normalize(F.col("l.href")).alias("target"), F.col("l.anchor").alias("anchor"), F.col("l.context").alias("context"))
    return rows.where("target is not null")


def links(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, anchor, context, link_seq: each link of a page, made to lead to another page of the table."""
    n = raw_pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    rows = html_links(spark, sf_dir, parsed).join(F.broadcast(n))  # one row
    to = (F.col("page_id") * 7 + F.col("link_seq") * 3 + 1) % F.col("n")
    context = F.when(F.col("link_seq") % 2 == 1, F.concat(F.lit("row "), F.col("link_seq") % 3)).otherwise(F.lit(""))
    rows = rows.select(F.col("page_id").alias("from_id"), to.alias("to_id"), "anchor", context.alias("context"), (F.col("page_id") * 1000 + F.col("link_seq")).alias("link_seq"))
    return rows.where("from_id != to_id")


def places(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """place_id, origin, path_prefix, scope, alias, revisit, status: one for each host of pages."""
    rows = (pages(spark, sf_dir) if known is None else known).groupBy(urls.host(F.col("url")).alias("h")).agg(F.min("page_id").alias("place_id"), F.min_by(urls.origin(F.col("url")), "page_id").alias("origin"))
    revisit = F.col("place_id") * 37 % 100 / 100
    status = F.when(F.col("place_id") % 11 == 0, "hub").when(revisit >= 0.5, "active").when(revisit >= 0.2, "probation").otherwise("dropped")
    prefix = F.lit("/")
    return rows.select("place_id", "origin", prefix.alias("path_prefix"), F.concat("origin", prefix).alias("scope"), urls.alias(F.col("origin"), prefix).alias("alias"), revisit.alias("revisit"), status.alias("status"))


def first_words(text: str, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.col(text), " "), lambda w: w != ""), 1, n), " ")


def picks(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """pick_id, query, page_id, ts_s: each click event picks page k, by the first two words of its title."""
    n = raw_pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    clicks = events(spark, sf_dir).where("event_type = 'click'").join(F.broadcast(n))  # one row
    clicks = clicks.select(F.col("event_id").alias("pick_id"), (F.col("k") % F.col("n")).cast("long").alias("page_id"), "ts_s")
    titles = (pages(spark, sf_dir) if known is None else known).select("page_id", first_words("title", 2).alias("query"))
    return clicks.join(titles, "page_id").select("pick_id", "query", "page_id", "ts_s")


def query_log(spark: SparkSession, sf_dir: str, picked: DataFrame | None = None) -> DataFrame:
    """query_id, query: the distinct queries of picks (by page) and the first three words of each benchmark text."""
    asked = (picks(spark, sf_dir) if picked is None else picked).select((F.col("page_id") + 1_000_000).alias("query_id"), "query").distinct()
    return asked.union(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), first_words("text", 3).alias("query")))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, job_id, type, key, at, what, error: errors post jobs, then clicks claim, purchases finish and signups
    fail the job that their k names."""
    rows = events(spark, sf_dir).where("event_type in ('error', 'click', 'purchase', 'signup')")
    what = F.when(F.col("event_type") == "error", "post").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return rows.select("event_id", F.col("k").cast("long").alias("job_id"), F.lit("crawl").alias("type"), F.concat(F.lit("key"), F.col("k") % 20).alias("key"), F.col("ts_s").alias("at"), what.alias("what"), F.when(F.col("event_type") == "signup", F.concat(F.lit("error "), F.col("k"))).alias("error"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, type, key, status, attempts, started_at: a job for each error event."""
    rows = events(spark, sf_dir).where("event_type = 'error'")
    status = F.when(F.col("k") % 4 == 0, "pending").when(F.col("k") % 4 == 1, "running").when(F.col("k") % 4 == 2, "done").otherwise("failed")
    return rows.select(F.col("event_id").alias("job_id"), F.when(F.col("k") % 2 == 0, "crawl").otherwise("name").alias("type"), F.concat(F.lit("key"), F.col("k") % 20).alias("key"), status.alias("status"), (F.col("k") % 3).alias("attempts"), F.col("ts_s").alias("started_at"))
