"""Short names of pages from their own words and their site's habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..sources.shared import settled
from . import graph

# Separators, unread counts, titles and link texts that are no names, and how many pages share a habit.
SEPARATOR = r"\s+[–—|·•-]\s+"
UNREAD = r"\s*\(\d[\d,]*\)"
DEFAULT_TITLE = (
    r"(?i)^(powerpoint presentation|presentation\d*|untitled( document| presentation| spreadsheet)?|"
    r"document\d*|microsoft (word|powerpoint|excel) - .*|slide \d+|new tab)$"
)
NO_NAME = r"(?i)^(here|link|pdf|slides?|video|recording|notes|click here|download|code|handout|\[.*\]|\d+|more|open|view)$"
SUFFIX_PAGES, TITLE_PAGES, NAME_CHARS = 3, 2, 100


def plain_title(title: Column) -> Column:
    """Spaces squeezed, unread counts gone; null is empty."""
    return F.trim(F.regexp_replace(T.squeeze(F.coalesce(title, F.lit(""))), UNREAD, ""))


def _ending(title: Column) -> Column:
    return F.when(title.rlike(SEPARATOR), F.lower(F.try_element_at(F.split(title, SEPARATOR), F.lit(-1))))


def site_suffixes(pages: DataFrame) -> DataFrame:
    """host, suffix: what at least SUFFIX_PAGES different titles of a site end with. pages: url, title."""
    titles = pages.where("title != ''").select(urls.bare_host(F.col("url")).alias("host"), plain_title(F.col("title")).alias("t")).distinct()
    ends = titles.select("host", _ending(F.col("t")).alias("suffix")).where("suffix is not null")
    return ends.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUFFIX_PAGES)


def clean_title(title: Column, suffixes: Column) -> Column:
    """The title without endings that are in `suffixes` (array), one after the other. The parts of a title are looked
    at from the last; the fold stops at the first part that is no suffix, and never takes the first part."""
    plain = plain_title(title)
    parts = F.split(plain, SEPARATOR)

    def drop(left: Column, _: Column) -> Column:
        last = F.lower(F.try_element_at(F.split(left, SEPARATOR), F.lit(-1)))
        ends = left.rlike(SEPARATOR) & F.array_contains(suffixes, last)
        shorter = F.regexp_replace(F.substr(left, F.lit(1), F.greatest(F.length(left) - F.length(last), F.lit(0))), r"[ –—|·•-]+$", "")
        return F.when(ends, shorter).otherwise(left)

    return F.trim(F.aggregate(F.slice(parts, 2, F.size(parts)), plain, drop))


def with_clean_titles(pages: DataFrame) -> DataFrame:
    """pages, host and clean (title without the site's suffixes)."""
    suffixes = site_suffixes(pages).groupBy("host").agg(F.collect_list("suffix").alias("suffixes"))
    known = pages.withColumn("host", urls.bare_host(F.col("url"))).join(suffixes, "host", "left")
    none = F.array().cast("array<string>")
    return known.withColumn("clean", clean_title(F.col("title"), F.coalesce("suffixes", none))).drop("suffixes")


def generic_titles(cleaned: DataFrame) -> DataFrame:
    """host, lowered: clean titles that TITLE_PAGES or more pages of a site have."""
    lowered = cleaned.where("title != ''").groupBy("host", F.lower("clean").alias("lowered"))
    return lowered.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TITLE_PAGES)


def names(pages: DataFrame, links: DataFrame) -> DataFrame:
    """url, name. pages: page_id, url, title, headings (array); links: to_id, anchor, link_seq."""
    cleaned = settled(with_clean_titles(pages))
    generic = generic_titles(cleaned).select("host", "lowered", F.lit(True).alias("generic"))
    rows = cleaned.withColumn("lowered", F.lower("clean")).join(generic, ["host", "lowered"], "left").join(graph.first_anchors(links, NO_NAME), "page_id", "left")
    usable = (F.col("clean") != "") & ~F.col("clean").rlike(DEFAULT_TITLE)
    tail = F.coalesce(urls.unquoted(F.try_element_at(urls.segments(F.col("url")), F.lit(-1))), F.col("host"))
    cut = lambda c: F.left(c, F.lit(NAME_CHARS))
    name = F.coalesce(
        cut(F.col("anchor")),
        F.when(usable & F.col("generic").isNull(), cut(F.col("clean"))),
        cut(F.try_element_at("headings", F.lit(1))),
        F.when(usable, cut(F.concat("clean", F.lit(" · "), tail))),
        cut(tail),
    )
    return rows.select("url", name.alias("name"))
