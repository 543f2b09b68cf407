"""Hubs, and grouping visited URLs into places.

Grouping walks down each site's directories, a level at a time for all sites at once. A URL's state is the directory
it belongs to; at each level the URLs of a directory either stay (and form a place there) or go down into a child.
Children whose URLs have alike shapes are tenants and all go down. Alike means to agree on half of the shape's
positions, that is, to agree on some choice of that many positions: so each short shape is expanded into its choices,
and a choice that two children share marks both - an aggregation, where comparing children pairwise would be quadratic.
Long shapes have too many choices. Of these, two that agree on `need` of m positions share one of the m - need + 1
rarest values (with their positions) of either, so shapes meet by these alone and are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import urls
from ..sources.shared import settled
from .visits import utc_day

#: Positions of a shape up to which its choices of half of them are few (252).
MOST_CHOSEN = 10


def hub_statistics(visits: DataFrame, bounce_s: float = DEFAULT.bounce_s) -> DataFrame:
    """user_id, path_key, n_visits, distinct_share (queries over (query, UTC day) pairs), n_origins (other origins that
    its visits lead to), brief_share (bounces among known dwells; 0 without)."""
    url = F.col("url")
    known = F.col("duration_s") > 0
    brief = F.when(known, F.when(F.col("duration_s") < bounce_s, 1).otherwise(0))
    at = visits.select("user_id", urls.path_key(url).alias("path_key"), urls.query(url).alias("q"), utc_day(F.col("ts_s")).alias("day"), brief.alias("brief"))
    # day by day, then query by query: what is distinct is counted without a copy of the visits for each count
    per = at.groupBy("user_id", "path_key", "q", "day").agg(F.count(F.lit(1)).alias("n"), F.count("brief").alias("known"), F.coalesce(F.sum("brief"), F.lit(0)).alias("brief"))
    per = per.groupBy("user_id", "path_key", "q").agg(F.count(F.lit(1)).alias("days"), *(F.sum(c).alias(c) for c in ("n", "known", "brief")))
    stats = per.groupBy("user_id", "path_key").agg(
        F.sum("n").alias("n_visits"),
        F.round(F.count("q") / F.sum("days"), 6).alias("distinct_share"),
        F.round(F.when(F.sum("known") > 0, F.sum("brief") / F.sum("known")).otherwise(0.0), 6).alias("brief_share"),
    )
    left = visits.where(F.col("from_url").isNotNull() & (urls.origin(url) != urls.origin(F.col("from_url"))))
    out = left.groupBy("user_id", urls.path_key(F.col("from_url")).alias("path_key")).agg(F.count_distinct(urls.origin(url)).alias("n_origins"))
    return stats.join(out, ["user_id", "path_key"], "left").withColumn("n_origins", F.coalesce("n_origins", F.lit(0)))


def is_hub() -> Column:
    """Over hub_statistics: a page that one passes through to many other sites, with ever new queries."""
    brief = (F.col("brief_share") >= DEFAULT.hub_brief) & (F.col("distinct_share") >= DEFAULT.hub_distinct_brief)
    enough = (F.col("n_visits") >= DEFAULT.hub_visits) & (F.col("n_origins") >= DEFAULT.hub_origins)
    return enough & ((F.col("distinct_share") >= DEFAULT.hub_distinct) | brief)


def hubs(visits: DataFrame) -> DataFrame:
    return hub_statistics(visits).where(is_hub()).select("user_id", "path_key")


def with_hub_flags(visits: DataFrame, hub_keys: DataFrame) -> DataFrame:
    """visits, with on_hub (its own URL is a hub's) and from_hub (where it came from is)."""
    keyed = visits.withColumns({"own_key": urls.path_key(F.col("url")), "from_key": urls.path_key(F.col("from_url"))})
    own = hub_keys.select("user_id", F.col("path_key").alias("own_key"), F.lit(True).alias("on_hub"))
    came = hub_keys.select("user_id", F.col("path_key").alias("from_key"), F.lit(True).alias("from_hub"))
    keyed = keyed.join(own, ["user_id", "own_key"], "left").join(came, ["user_id", "from_key"], "left")
    no = F.lit(False)
    return keyed.select(*visits.columns, F.coalesce("on_hub", no).alias("on_hub"), F.coalesce("from_hub", no).alias("from_hub"))


def _path(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.concat(s, F.lit("/"))), ""))


def directories(url_days: DataFrame, max_depth: int = DEFAULT.max_depth) -> DataFrame:
    """user_id, url, n_days, origin, own (path segments), node (segments of its directory). A page /a/b beside a
    directory /a/b/ belongs to that directory, and so on for each level that can still matter."""
    url = F.col("url")
    rows = url_days.select(
        "user_id", "url", "n_days", urls.origin(url).alias("origin"), urls.segments(url).alias("own"), F.filter(F.split(urls.directory(url), "/"), lambda s: s != "").alias("node")
    )
    rows = settled(rows)
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size("node"), F.lit(max_depth))), lambda i: _path(F.slice("node", 1, i)))
    known = rows.where(F.size("node") > 0).select("user_id", "origin", F.explode(prefixes).alias("into")).distinct().withColumn("there", F.lit(True))
    known = settled(known)
    for _ in range(max_depth):
        last = F.try_element_at("own", F.lit(-1))
        into = F.when((F.size("node") < max_depth) & last.isNotNull(), _path(F.concat("node", F.array(last))))
        rows = rows.withColumn("into", into).join(known, ["user_id", "origin", "into"], "left")
        rows = rows.withColumn("node", F.when(F.col("there"), F.concat("node", F.array(F.try_element_at("own", F.lit(-1))))).otherwise(F.col("node"))).drop("into", "there")
    return rows


def _choices(shape: Column) -> Column:
    """Each choice of half of the shape's positions (one at least), with what stands there. For shapes of up to
    MOST_CHOSEN positions."""
    m, need = F.size(shape), _need(shape)
    masks = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), m).cast("int") - 1), lambda x: F.bit_count(x) == need)
    text = lambda mask: F.array_join(F.transform(shape, lambda s, i: F.when(mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0, s).otherwise(F.lit("/"))), "|")
    return F.transform(masks, lambda x: F.concat_ws(":", m.cast("string"), text(x)))


def _need(shape: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(shape) / 2).cast("int"))


def _meeting_shapes(shaped: DataFrame) -> DataFrame:
    """The rows of shaped whose shape is also another child's, or agrees on half of the positions with another
    child's. Equal shapes are taken together first; the others meet by their rarest values."""
    node = ["user_id", "origin", "at"]
    kinds = settled(shaped.groupBy(*node, "shape").agg(F.min("child").alias("least"), F.max("child").alias("most")))
    values = kinds.select(*node, "shape", "least", "most", F.size("shape").alias("m"), F.posexplode("shape").alias("i", "value"))
    common = values.groupBy(*node, "m", "i", "value").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy(*node, "shape").orderBy("n", "i")
    ranked = values.join(common, [*node, "m", "i", "value"]).withColumn("r", F.row_number().over(rarest))
    rare = settled(ranked.where((F.col("r") <= F.col("m") - _need(F.col("shape")) + 1) & (F.col("n") > 1)))
    a, b = rare.alias("a"), rare.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*node, "m", "i", "value")]
    pairs = a.join(b, same).where("a.shape < b.shape").select(*(F.col(f"a.{c}") for c in node), F.col("a.shape").alias("one"), F.col("b.shape").alias("two"), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("least", "most")))
    agreed = F.size(F.filter(F.zip_with("one", "two", lambda x, y: x == y), lambda x: x))
    # of one and the same child only, they mark nobody
    two_children = ~((F.col("a_least") == F.col("b_most")) & (F.col("a_most") == F.col("b_least")))
    alike = pairs.where(two_children & (agreed >= _need(F.col("one")))).select(*node, F.explode(F.array("one", "two")).alias("shape"))
    found = alike.union(kinds.where("least != most").select(*node, "shape")).distinct()
    return shaped.join(found, [*node, "shape"], "left_semi")


def tenants(rows: DataFrame, depth: int) -> DataFrame:
    """user_id, origin, at (directory), child of the children that share a shape with another child. rows: as from
    directories(), in their directory of this depth, with `at` and `child`."""
    below = F.slice("own", depth + 2, F.greatest(F.size("own") - depth - 1, F.lit(0)))
    shape = F.transform(F.slice(below, 2, F.greatest(F.size(below) - 1, F.lit(0))), urls.segment_shape)
    shaped = settled(rows.where(F.col("child").isNotNull() & (F.size("own") - depth - 1 >= 2)).select("user_id", "origin", "at", "child", shape.alias("shape")).distinct())
    short, long_ = (shaped.where(c) for c in (F.size("shape") <= MOST_CHOSEN, F.size("shape") > MOST_CHOSEN))
    chosen = settled(short.select("user_id", "origin", "at", "child", F.explode(_choices(F.col("shape"))).alias("choice")).distinct())
    shared = chosen.groupBy("user_id", "origin", "at", "choice").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = chosen.join(shared, ["user_id", "origin", "at", "choice"], "left_semi").select("user_id", "origin", "at", "child")
    return found.union(_meeting_shapes(long_).select("user_id", "origin", "at", "child")).distinct()


def at_level(rows: DataFrame, depth: int) -> DataFrame:
    at = _path(F.slice("node", 1, depth)) if depth else F.lit("/")
    return rows.withColumns({"at": at, "child": F.get("node", F.lit(depth))})


def group(url_days: DataFrame, max_depth: int = DEFAULT.max_depth, concentration: float = DEFAULT.concentration) -> DataFrame:
    """user_id, origin, path_prefix, scope, url, n_days: the place of each URL. url_days: user_id, url, n_days.

    A directory goes down into its tenants; without any, into a child that has `concentration` of its weight (days
    over URLs; of equally heavy ones the first by name); what does not go down is a place.
    """
    rows = settled(directories(url_days, max_depth))
    out = None
    for depth in range(max_depth + 1):
        here = at_level(rows, depth)
        if depth < max_depth:
            node = ["user_id", "origin", "at"]
            similar = settled(tenants(here, depth))
            weight = here.groupBy(*node, "child").agg(F.sum("n_days").alias("w"))
            total = Window.partitionBy(*node)
            best = weight.withColumn("total", F.sum("w").over(total)).where("child is not null")
            best = best.withColumn("r", F.row_number().over(total.orderBy(F.desc("w"), "child"))).where((F.col("r") == 1) & (F.col("w") >= concentration * F.col("total")))
            has = similar.select(*node).distinct()
            best = best.join(has, node, "left_anti").select(*node, "child", F.lit(True).alias("heavy"))
            goes = similar.join(best, [*node, "child"], "full").select(*node, "child", F.lit(True).alias("goes"))
            here = settled(here.join(goes, [*node, "child"], "left"))
        else:
            here = here.withColumn("goes", F.lit(None).cast("boolean"))
        stays = here.where("goes is null").select("user_id", "origin", F.col("at").alias("path_prefix"), F.concat("origin", "at").alias("scope"), "url", "n_days")
        out = stays if out is None else out.union(stays)
        rows = here.where("goes").select("user_id", "url", "n_days", "origin", "own", "node")
    return out


def hub_places(hub_urls: DataFrame, regular: DataFrame) -> DataFrame:
    """Places of hub URLs (user_id, url, n_days): one for each directory that is no regular place's scope."""
    url = F.col("url")
    own = hub_urls.select("user_id", urls.origin(url).alias("origin"), urls.directory(url).alias("path_prefix"), F.concat(urls.origin(url), urls.directory(url)).alias("scope"), "url", "n_days")
    return own.join(regular.select("user_id", "scope").distinct(), ["user_id", "scope"], "left_anti").select("user_id", "origin", "path_prefix", "scope", "url", "n_days")
