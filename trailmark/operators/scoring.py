"""How likely somebody is to come back: features of a place's or page's visits, and their logistic score.

`place` stands for any key columns. One aggregation over visits gives all features but those of days, which come
from the distinct (place, day) rows; both shuffle on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from .visits import local_day


def day_features(visits: DataFrame, keys: list[str], now: float, half_life: float, zone: str = "UTC") -> DataFrame:
    """keys, n_days, days (each day counts half as much for each half-life of its age), regular (1 - variation of the
    gaps between days, of 3 days or more)."""
    days = visits.select(*keys, local_day(F.col("ts_s"), zone).alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(*keys).orderBy("day")))
    today = local_day(F.lit(float(now)), zone)
    worth = F.pow(F.lit(0.5), F.greatest(F.datediff(today, "day"), F.lit(0)) / F.lit(float(half_life)))
    steady = 1 - F.least(F.lit(1.0), F.stddev_pop("gap") / F.avg("gap"))
    return days.withColumns({"gap": gap, "worth": worth}).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.round(F.sum("worth"), 4).alias("days"),
        F.round(F.when(F.count(F.lit(1)) >= 3, steady).otherwise(0.0), 4).alias("regular"),
    )


def day_gaps(visits: DataFrame, keys: list[str], zone: str = "UTC") -> DataFrame:
    days = visits.select(*keys, local_day(F.col("ts_s"), zone).alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(*keys).orderBy("day")))
    return days.withColumn("gap", gap).where("gap is not null")


def visit_features(visits: DataFrame, keys: list[str], bounce_s: float = DEFAULT.bounce_s) -> DataFrame:
    """keys, visits, breadth, bounce, from_search, first_visit, last_visit. visits also has `arrival` and `from_hub`
    (booleans); a dwell of 0 is unknown and no bounce."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return visits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_distinct("url").alias("breadth"),
        share((F.col("duration_s") > 0) & (F.col("duration_s") < bounce_s)).alias("bounce"),
        F.round(F.coalesce(F.avg(F.when(F.col("arrival"), F.when(F.col("from_hub"), 1.0).otherwise(0.0))), F.lit(0.0)), 4).alias("from_search"),
        F.min("ts_s").alias("first_visit"),
        F.max("ts_s").alias("last_visit"),
    )


def with_arrivals(visits: DataFrame, place: str = "scope") -> DataFrame:
    """visits and `arrival`: not from a URL of the same place. A null from_url arrives."""
    members = visits.select(F.col("user_id").alias("__user"), F.col(place).alias("__place"), F.col("url").alias("__member")).distinct()
    same = (F.col("user_id") == F.col("__user")) & (F.col(place) == F.col("__place")) & (F.col("from_url") == F.col("__member"))
    joined = visits.join(members, same, "left")
    return joined.withColumn("arrival", F.col("__member").isNull()).drop("__user", "__place", "__member")


def revisit(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Sigmoid of the weighted features; days and breadth enter as log(1 + x), features that are not given not at all."""
    weights = weights or DEFAULT.weights
    x = F.lit(weights["bias"])
    for name, w in weights.items():
        if name in features:
            x = x + F.lit(w) * (F.log1p(features[name]) if name in ("days", "breadth") else features[name])
    return 1 / (1 + F.exp(-x))


def place_features(visits: DataFrame, keys: list[str], now: float, half_life: float = DEFAULT.place_half_life, breadth: bool = True, zone: str = "UTC") -> DataFrame:
    """All features and the score. visits: as for visit_features."""
    both = visit_features(visits, keys).join(day_features(visits, keys, now, half_life, zone), keys)
    used = {c: F.col(c) for c in ("days", "bounce", "regular", *(["breadth"] if breadth else []))}
    return both.withColumn("revisit", F.round(revisit(used), 4))


def status(revisit_: Column, last_visit: Column, now: float) -> Column:
    recent = F.lit(float(now)) - last_visit <= DEFAULT.probation_days * 86400
    return F.when(revisit_ >= DEFAULT.active, "active").when((revisit_ >= DEFAULT.probation) & recent, "probation").otherwise("dropped")
