"""From ticks ("what is on screen now") to visits, and views of them.

Every relation has user_id as its outer key, so that users are independent and a window never spans two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import urls

DAY = 86400


def utc_day(ts: Column) -> Column:
    """Days since 1970 in UTC."""
    return F.floor(ts / DAY).cast("int")


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """Calendar date in a zone, whatever the session's is."""
    if zone == "UTC":
        return F.date_from_unix_date(utc_day(ts))
    micros = F.round(ts * 1_000_000).cast("long")
    there = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("TIMESTAMP_NTZ '1970-01-01'") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)")))
    return F.to_date(there)


def window_of(visits: DataFrame, now: float, days: int = DEFAULT.history_days) -> DataFrame:
    return visits.where(F.col("ts_s") >= now - days * DAY)


def sessionize(ticks: DataFrame) -> DataFrame:
    """user_id, url, title, start_s, duration_s, from_url of each visit in ticks (user_id, tick_id, ts_s, tab_id,
    incognito, url, title; a null tab_id is a tick without a tab).

    A visit is a run of ticks of one tab and URL. It ends when the next run begins - ticks without a web page are a
    run, too, but not a visit - and the last one at its last tick. from_url: what the tab showed before, unless that
    is the same URL. Title: the one at the start.
    """
    seen = ticks.withColumn("url", F.when(~F.coalesce("incognito", F.lit(False)), urls.normalize(F.col("url"))))
    seen = seen.withColumn("tab", F.when(F.col("url").isNotNull(), F.col("tab_id")))
    order = Window.partitionBy("user_id").orderBy("ts_s", "tick_id")
    same = F.col("url").eqNullSafe(F.lag("url").over(order)) & F.col("tab").eqNullSafe(F.lag("tab").over(order))
    new = F.when((F.row_number().over(order) == 1) | ~same, 1).otherwise(0)
    runs = seen.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    first = F.min(F.struct("ts_s", "tick_id", "title"))["title"]
    runs = runs.groupBy("user_id", "run").agg(F.first("tab").alias("tab"), F.first("url").alias("url"), F.min("ts_s").alias("start_s"), F.max("ts_s").alias("last_s"), first.alias("title"))
    by_run = Window.partitionBy("user_id").orderBy("run")
    runs = runs.withColumn("end_s", F.coalesce(F.lead("start_s").over(by_run), "last_s")).where("url is not null")
    return with_referrer(runs, "tab", "start_s", "run").select("user_id", "url", "title", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "from_url")


def with_referrer(visits: DataFrame, tab: str = "tab_id", ts: str = "ts_s", tie: str = "event_id") -> DataFrame:
    """visits and from_url: the URL before in the same tab, null if there is none or it is the same."""
    before = F.lag("url").over(Window.partitionBy("user_id", tab).orderBy(ts, tie))
    return visits.withColumn("from_url", F.nullif(before, F.col("url")))


def url_days(visits: DataFrame, zone: str = "UTC") -> DataFrame:
    """user_id, url, n_days: on how many dates each URL was visited."""
    return visits.groupBy("user_id", "url").agg(F.count_distinct(local_day(F.col("ts_s"), zone)).alias("n_days"))
