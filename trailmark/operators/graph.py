"""The link graph: pages (page_id, ...), links (from_id, to_id, anchor, context, link_seq), places (place_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T


def page_with_place(pages: DataFrame, places: DataFrame) -> DataFrame:
    """pages, with place_revisit, status, place_alias, place_origin, path_prefix; null outside any place."""
    named = places.select("place_id", F.col("revisit").alias("place_revisit"), "status", F.col("alias").alias("place_alias"), F.col("origin").alias("place_origin"), "path_prefix")
    return pages.join(named, "place_id", "left")


def not_hubs(placed: DataFrame) -> DataFrame:
    return placed.where(F.coalesce("status", F.lit("")) != "hub")


def from_places(pages: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """links, with the linking page's place (inner)."""
    origin = pages.select(F.col("page_id").alias("from_id"), "place_id")
    return links.join(origin, "from_id").join(places, "place_id")


def inherited_revisit(pages: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """page_id, inherited: the largest revisit score among the places that link to the page."""
    return from_places(pages, links, places).groupBy(F.col("to_id").alias("page_id")).agg(F.max("revisit").alias("inherited"))


def effective_revisit(placed: DataFrame, inherited: DataFrame) -> DataFrame:
    """placed and rv: the page's own score or, if larger, its place's (without one, the inherited)."""
    joined = placed.join(inherited, "page_id", "left")
    return joined.withColumn("rv", F.greatest("revisit", F.coalesce("place_revisit", "inherited", F.lit(0.0)))).drop("inherited")


def linking_site(pages: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """page_id, site: of the places that link there, that with the largest revisit score (of equals the first by name)."""
    site = F.coalesce("alias", "origin")
    sites = from_places(pages, links, places).select(F.col("to_id").alias("page_id"), site.alias("site"), "revisit")
    first = Window.partitionBy("page_id").orderBy(F.desc("revisit"), "site")
    per = sites.groupBy("page_id", "site").agg(F.max("revisit").alias("revisit"))
    return per.withColumn("r", F.row_number().over(first)).where("r = 1").select("page_id", "site")


def recent_or_near(pages: DataFrame, links: DataFrame, now: float, days: int | None = DEFAULT.recent_days) -> DataFrame:
    """Pages visited within `days`, and unvisited pages that one of those links to; all pages if days is None."""
    if days is None:
        return pages
    recent = pages.where(F.col("visited") & (F.col("last_visit") >= now - days * 86400))
    near = links.join(recent.select(F.col("page_id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("page_id"))
    return recent.unionByName(pages.where(~F.col("visited")).join(near, "page_id", "left_semi").select(*pages.columns))


def first_texts(links: DataFrame, column: str, most: int = DEFAULT.max_link_texts) -> DataFrame:
    """to_id, texts: the first distinct non-empty texts of incoming links, spaces squeezed, in order."""
    said = links.select("to_id", T.squeeze(F.col(column)).alias("t"), "link_seq").where("t != ''")
    said = said.groupBy("to_id", "t").agg(F.min("link_seq").alias("seq"))
    few = said.withColumn("r", F.row_number().over(Window.partitionBy("to_id").orderBy("seq", "t"))).where(F.col("r") <= most)
    return few.groupBy("to_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("texts"))


def link_texts(links: DataFrame, most: int = DEFAULT.max_link_texts) -> DataFrame:
    """page_id, anchors, contexts (arrays) of pages with links to them."""
    anchors = first_texts(links, "anchor", most).withColumnRenamed("texts", "anchors")
    contexts = first_texts(links, "context", most).withColumnRenamed("texts", "contexts")
    none = F.array().cast("array<string>")
    both = anchors.join(contexts, "to_id", "full")
    return both.select(F.col("to_id").alias("page_id"), F.coalesce("anchors", none).alias("anchors"), F.coalesce("contexts", none).alias("contexts"))


def deduped_targets(links: DataFrame, page: str = "page_id") -> DataFrame:
    """One link for each target of a page: the first with a text, else the first; it stands where the first stood."""
    best = Window.partitionBy(page, "target").orderBy(F.col("anchor") == "", "link_seq")
    place = F.min("link_seq").over(Window.partitionBy(page, "target"))
    ranked = links.withColumns({"r": F.row_number().over(best), "seq": place}).where("r = 1")
    return ranked.select(page, "target", "anchor", "context", F.col("seq").alias("link_seq"))


def first_anchors(links: DataFrame, useless: str) -> DataFrame:
    """page_id, anchor: of the incoming links, the first text (trimmed) that does not match `useless`."""
    said = links.select(F.col("to_id").alias("page_id"), F.trim("anchor").alias("anchor"), "link_seq")
    return said.where((F.col("anchor") != "") & ~F.col("anchor").rlike(useless)).groupBy("page_id").agg(F.min_by("anchor", F.struct("link_seq", "anchor")).alias("anchor"))


def incoming_anchors(links: DataFrame) -> DataFrame:
    """page_id, anchors: all non-empty anchors in order."""
    said = links.where("anchor is not null and anchor != ''").groupBy(F.col("to_id").alias("page_id"))
    return said.agg(F.transform(F.array_sort(F.collect_list(F.struct("link_seq", "anchor"))), lambda x: x["anchor"]).alias("anchors"))


# Link texts that say nothing about a page.
SAYS_NOTHING = (
    r"(?i)^\W*(slides?|pdf|ppt|pptx|here|click here|link|video|recording|download|view|open|notes|handout|"
    r"html|watch|more|read more|\d+)?\W*$"
)


def label(anchors: Column, contexts: Column, title: Column, headings: Column, last_segment: Column, host: Column) -> Column:
    """What to call a page: a telling link text, else a context with the first link text, else title, heading, path."""
    telling = F.try_element_at(F.filter(anchors, lambda a: ~a.rlike(SAYS_NOTHING)), F.lit(1))
    first, around = F.try_element_at(anchors, F.lit(1)), F.try_element_at(contexts, F.lit(1))
    first_heading = F.try_element_at(headings, F.lit(1))
    return F.coalesce(
        F.left(telling, F.lit(120)),
        F.concat(F.left(around, F.lit(100)), F.lit(" — "), first),
        F.when(title != "", F.left(T.squeeze(title), F.lit(120))),
        F.left(T.squeeze(first_heading), F.lit(120)),
        last_segment,
        host,
    )


def description(label_: Column, site: Column, bare_host: Column, plain_path: Column, kind: Column, contexts: Column, anchors: Column, snippet: Column, n: int = 400) -> Column:
    """One line that tells a page from others: label | site › place | kind | what links say, else the snippet."""
    extra = F.concat(F.filter(contexts, lambda c: ~F.contains(label_, c)), F.slice(anchors, 2, 2))
    said = F.array_join(extra, " · ")
    excerpt = F.when(said != "", said).otherwise(T.squeeze(F.coalesce(snippet, F.lit(""))))
    where = F.concat(site, F.lit(" › "), bare_host, F.when(plain_path == "", F.lit("/")).otherwise(plain_path))
    return F.left(F.concat_ws(" | ", label_, where, kind, excerpt), F.lit(n))
