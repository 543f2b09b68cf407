"""Visits from a stream of ticks, with state for each user: the visit in progress and each tab's last URL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls

VISIT = "user_id long, url string, title string, start_s double, duration_s double, from_url string"
STATE = "current string, tabs string"
NAMES = [c.split()[0] for c in VISIT.split(", ")]
#: Seconds into a visit at which its page is read; the next, if the page had no text yet.
CAPTURE_AT_S = (3.0, 15.0)


#: Tabs whose last URL is remembered, for each user: the most recent ones.
TABS = 200


def _advance(key, batches, state: GroupState, idle_ms: int | None = None):
    """State: the visit in progress with its last tick, and each tab's last URL, oldest first. Ticks that are older than
    the last one seen come too late and are left out."""
    current, tabs = (json.loads(x) for x in state.get) if state.exists else (None, {"": None})
    last = tabs.pop("", None)
    out = []

    def close(end: float) -> None:
        nonlocal current
        out.append((key[0], current["url"], current["title"], current["start"], end - current["start"], current["from"]))
        tabs.pop(current["tab"], None)
        tabs[current["tab"]] = current["url"]
        current = None

    if state.hasTimedOut:  # no tick for long: the visit ended with the last
        if current:
            close(last)
        state.remove()
        if out:
            yield pd.DataFrame(out, columns=NAMES)
        return
    ticks = pd.concat(list(batches)).sort_values(["ts_s", "tick_id"])
    if last is not None:
        ticks = ticks[ticks["ts_s"] >= last]
    if len(ticks):
        # only ticks at which something else is looked at matter
        web = ticks["web_url"].where(ticks["web_url"].notna(), None)
        tab = ticks["tab_id"].astype(str).where(ticks["web_url"].notna(), None)
        ticks = ticks.assign(web_url=web, tab_id=tab)
        same = (web.fillna("") == web.fillna("").shift(fill_value="\0")) & (tab.fillna("") == tab.fillna("").shift(fill_value="\0"))
        last = float(ticks["ts_s"].iloc[-1])
        for t in ticks[~same].itertuples():
            if current and (current["url"], current["tab"]) != (t.web_url, t.tab_id):
                close(t.ts_s)
            if t.web_url and not current:
                before = tabs.get(t.tab_id)
                current = {"url": t.web_url, "tab": t.tab_id, "title": t.title, "start": t.ts_s, "from": before if before != t.web_url else None}
    kept = dict(list(tabs.items())[-TABS:])
    state.update((json.dumps(current), json.dumps({"": last} | kept)))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    if out:
        yield pd.DataFrame(out, columns=NAMES)


def visit_stream(ticks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """VISIT rows as visits end. ticks: a stream of user_id, tick_id, ts_s, tab_id, incognito, url, title.

    idle_ms: how long after its last tick a user's visit counts as over. Without it the last visit stays open until
    the next tick; a stream that is to be drained needs that, as timeouts keep a drained stream waiting.
    """
    web = F.when(~F.coalesce("incognito", F.lit(False)), urls.normalize(F.col("url")))
    rows = ticks.withColumn("web_url", web).select("user_id", "tick_id", "ts_s", "tab_id", "web_url", "title")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def advance(key, batches, state):
        yield from _advance(key, batches, state, idle_ms)

    return rows.groupBy("user_id").applyInPandasWithState(advance, VISIT, STATE, "append", timeout)


def ingest(ticks: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the stream; `write` gets each batch of visits once and its number, to append and to post crawls."""
    return visit_stream(ticks).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def captures(visits: DataFrame, texts: DataFrame, at_s: tuple[float, ...] = CAPTURE_AT_S, visit: str | None = None) -> DataFrame:
    """Of what a page's text was at times (texts: user_id, ts_s, url, text), the readings that count: of each visit
    (user_id, url, start_s, duration_s) the first one from each of at_s on and after the one before, until one of them
    has text. user_id, url, start_s, turn (from 0), ts_s, text. A visit that ends before has none. visit: a column that
    tells visits apart, if texts say in which of them they were read; else they are matched by URL and time."""
    key = ["user_id", "url", "start_s", *([visit] if visit else [])]
    end = F.col("start_s") + F.col("duration_s")
    rows = visits.select(*key, end.alias("end_s")).join(texts, ["user_id", "url", *([visit] if visit else [])]).where(F.col("ts_s").between(F.col("start_s") + at_s[0], F.col("end_s")))
    rows = rows.select(*key, "ts_s", F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for turn, s in enumerate(at_s):
        now = rows.where(F.col("ts_s") >= F.col("start_s") + s)
        if out is not None:
            empty = out.where((F.col("turn") == turn - 1) & (F.col("text") == "")).select(*key, F.col("ts_s").alias("before"))
            now = now.join(empty, key).where("ts_s > before")
        first = now.groupBy(*key).agg(F.lit(turn).alias("turn"), F.min("ts_s").alias("ts_s"), F.min_by("text", "ts_s").alias("text"))
        out = first if out is None else out.union(first)
    return out
