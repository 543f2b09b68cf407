"""One cycle over the recorded visits: hubs, places, scores, what changed, what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import urls
from ..sources import store
from ..sources.shared import settled
from . import places, scoring, visits


class Cycle:
    """visits: user_id, event_id, ts_s, url, duration_s, from_url."""

    def __init__(self, seen: DataFrame, now: float, zone: str = "UTC"):
        self.now, self.zone = now, zone
        self.visits = settled(visits.window_of(seen, now))
        self.hubs = places.hubs(self.visits)
        self.flagged = settled(places.with_hub_flags(self.visits, self.hubs))
        self.regular = places.group(visits.url_days(self.flagged.where("not on_hub"), zone))
        self.hub_only = places.hub_places(visits.url_days(self.flagged.where("on_hub"), zone), self.regular)

    def placed(self) -> DataFrame:
        """user_id, scope, origin, path_prefix, url, is_hub."""
        columns = ["user_id", "scope", "origin", "path_prefix", "url"]
        return self.regular.select(*columns, F.lit(False).alias("is_hub")).union(self.hub_only.select(*columns, F.lit(True).alias("is_hub")))

    def places(self) -> DataFrame:
        """One row for each place: its features, score, status and alias."""
        member = self.placed()
        rows = settled(self.flagged.join(member, ["user_id", "url"]))
        feats = scoring.place_features(scoring.with_arrivals(rows), ["user_id", "scope", "origin", "path_prefix", "is_hub"], self.now, zone=self.zone)
        status = F.when(F.col("is_hub"), "hub").otherwise(scoring.status(F.col("revisit"), F.col("last_visit"), self.now))
        return feats.withColumns({"status": status, "alias": urls.alias(F.col("origin"), F.col("path_prefix"))})

    def pages(self) -> DataFrame:
        """One row for each URL of a regular place: user_id, url, scope, kind, visit_count, last_visit, revisit."""
        rows = self.flagged.withColumn("arrival", F.lit(True)).join(self.regular.select("user_id", "url", "scope"), ["user_id", "url"])
        feats = scoring.place_features(rows, ["user_id", "url", "scope"], self.now, DEFAULT.page_half_life, breadth=False, zone=self.zone)
        return feats.select("user_id", "url", "scope", urls.kind(F.col("url")).alias("kind"), F.col("visits").alias("visit_count"), "last_visit", "revisit")

    def changes(self, old_places: DataFrame, old_pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Places now (first_visit is the earliest known), pages that differ from the stored, places that are gone."""
        now = self.places()
        before = old_places.select("user_id", "scope", F.col("first_visit").alias("__first"))
        now = now.join(before, ["user_id", "scope"], "left").withColumn("first_visit", F.least("first_visit", "__first")).drop("__first")
        pages = store.changed(self.pages(), old_pages, ["user_id", "url"], ["scope", "visit_count", "last_visit", "revisit"])
        return now, pages, store.retired(old_places, now, ["user_id", "scope"])


def summary(found: DataFrame) -> DataFrame:
    """user_id and the number of places by status. found: as from Cycle.places()."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return found.groupBy("user_id").agg(F.count_if(~F.col("is_hub")).alias("places"), count("active"), count("probation"), count("dropped"), count("hub"))
