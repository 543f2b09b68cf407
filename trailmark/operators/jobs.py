"""A job queue as a log of events. There is one writer; state is what the log says.

jobs: job_id, type, payload (JSON; its _key is the key), status, attempts, created_at, started_at (seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload_key(payload: Column) -> Column:
    """The key that a job's payload (JSON) holds, if any."""
    return F.get_json_object(payload, "$._key")


def with_key(payload: Column, key: Column) -> Column:
    """The payload (a JSON object) with a key in it; a null key leaves it as it is."""
    own = F.to_json(F.struct(key.alias("_key")))
    open_ = F.regexp_replace(F.trim(payload), r"\s*\}$", "")
    return F.when(key.isNull(), payload).otherwise(F.concat(open_, F.when(open_ == "{", "").otherwise(","), F.substr(own, F.lit(2))))


def accepted(posts: DataFrame, pending: DataFrame) -> DataFrame:
    """Of new posts (post_id, type, key; a null key is never a repeat) those whose key has no pending job of the type,
    and the first of each key among themselves."""
    free = posts.join(pending.select("type", "key").distinct(), ["type", "key"], "left_anti").select(*posts.columns)
    turn = F.row_number().over(Window.partitionBy("type", "key").orderBy("post_id"))
    return free.withColumn("turn", F.when(F.col("key").isNull(), 1).otherwise(turn)).where("turn = 1").drop("turn")


def claimed(jobs: DataFrame, types: list[str], n: int, now: float) -> DataFrame:
    """The n oldest pending jobs of these types, as running, with one more attempt."""
    oldest = jobs.where((F.col("status") == "pending") & F.col("type").isin(types)).orderBy("job_id").limit(n)
    return oldest.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "started_at": F.lit(float(now))})


def state(events: DataFrame) -> DataFrame:
    """job_id, type, key, status, attempts, changed_at, error from events (event_id, job_id, type, key, at, what:
    post, claim, done, failed, requeue; error)."""
    last = lambda c: F.max_by(c, F.struct("at", "event_id"))
    names = F.create_map(*(F.lit(x) for x in ("post", "pending", "claim", "running", "done", "done", "failed", "failed", "requeue", "pending")))
    rows = events.groupBy("job_id").agg(
        F.min_by("type", F.struct("at", "event_id")).alias("type"),
        F.min_by("key", F.struct("at", "event_id")).alias("key"),
        last("what").alias("what"),
        F.sum(F.when(F.col("what") == "claim", 1).otherwise(0)).alias("attempts"),
        F.max("at").alias("changed_at"),
        last("error").alias("error"),
    )
    return rows.withColumn("status", F.element_at(names, F.col("what"))).drop("what")


def requeued(jobs: DataFrame, now: float, older_s: float = 3600) -> DataFrame:
    """jobs, with those that have run longer than older_s pending again; `requeued` says which."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - older_s)
    return jobs.withColumns({"requeued": F.coalesce(stale, F.lit(False)), "status": F.when(stale, "pending").otherwise(F.col("status"))})
