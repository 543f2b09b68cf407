"""One query for each operator, over the relations of sources.world. Arrays are shown as text, scores rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import html as H
from ..functions import text as T
from ..functions import urls
from ..operators import crawl, graph, index, jobs, naming, places, scoring, search, visits, watch
from ..sources import store, world
from ..sources.shared import settled
from ..sources.world import NOW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def shown(c: Column | str, sep: str = " | ") -> Column:
    return F.array_join(c, sep)


# --- URLs


def _url_query(name: str, columns: Callable[[], tuple]) -> None:
    def run(spark, sf):
        rows = world.raw_pages(spark, sf).select("page_id", urls.normalize(F.col("url")).alias("url"), F.col("url").alias("raw"))
        return rows.select("page_id", *columns())

    QUERIES[name] = run


_url_query("url_normalize", lambda: (F.col("url").alias("url"),))
_url_query("url_origin", lambda: (urls.origin(F.col("raw")).alias("origin"),))
_url_query("url_segments", lambda: (shown(urls.segments(F.col("raw")), "|").alias("segments"), F.size(urls.segments(F.col("raw"))).alias("n"),))
_url_query("url_kind", lambda: (urls.kind(F.concat(urls.origin(F.col("url")), urls.path(F.col("url")), F.element_at(F.array(*map(F.lit, ["", ".pdf", "x.pptx", "v.mp4", "a.zip", "b.PDF", ".md"])), (F.col("page_id") % 7 + 1).cast("int")))).alias("kind"),))
_url_query("url_template", lambda: (urls.template(F.col("url")).alias("template"),))
_url_query("url_words", lambda: (urls.words(F.col("url")).alias("words"),))
_url_query("url_directory", lambda: (urls.directory(F.col("url")).alias("directory"), urls.path_key(F.col("url")).alias("path_key"),))
_url_query("segment_shape", lambda: (shown(F.transform(urls.segments(F.col("url")), urls.segment_shape), "|").alias("shapes"),))
_url_query("action_urls", lambda: (urls.is_action(F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, ["", "/logout", "/edit", "/edits", "?do=Delete"])), (F.col("page_id") % 5 + 1).cast("int")))).alias("is_action"),))
_url_query("short_url", lambda: (urls.short(F.concat(F.col("url"), F.repeat(F.lit("/abcdefghij"), (F.col("page_id") % 5).cast("int")))).alias("short"),))
_url_query("place_alias", lambda: (urls.alias(urls.origin(F.col("url")), F.concat(F.regexp_replace(urls.path(F.col("url")), r"/?$", "/"), F.when(F.col("page_id") % 2 == 0, F.lit("My%20Docs/")).otherwise(F.lit("")))).alias("alias"),))


@query
def url_relation(spark, sf):
    rows = world.html_links(spark, sf).select("page_id", "link_seq", "target", "url")
    return rows.select("page_id", "link_seq", urls.relation(F.col("url"), F.col("target"), urls.origin(F.col("url")), F.lit("/")).alias("relation"))


# --- HTML


def _parsed(spark, sf):
    return world.parsed_pages(spark, sf).select("page_id", "url", "parsed.*")


@query
def html_title(spark, sf):
    return _parsed(spark, sf).select("page_id", "title")


@query
def html_headings(spark, sf):
    return _parsed(spark, sf).select("page_id", shown("headings").alias("headings"), F.size("headings").alias("n"))


@query
def html_links(spark, sf):
    return world.html_links(spark, sf).select("page_id", "link_seq", "target", "anchor", "context")


@query
def html_snippet(spark, sf):
    return _parsed(spark, sf).select("page_id", "snippet")


@query
def page_outline(spark, sf):
    rows = world.raw_pages(spark, sf).select("page_id", H.outline("html", "url").alias("o"))
    return rows.select("page_id", shown("o.headings").alias("headings"), shown("o.blocks", " … ").alias("blocks"), F.size("o.links").alias("n_links"))


@query
def compose_snippet(spark, sf):
    rows = _parsed(spark, sf)
    crumb = F.when(F.col("page_id") % 2 == 0, urls.host(F.col("url"))).otherwise(F.lit(""))
    return rows.select("page_id", T.snippet(F.col("title"), crumb, shown("headings")).alias("snippet"))


@query
def clip_text(spark, sf):
    return _parsed(spark, sf).select("page_id", T.clip(F.col("title"), 20).alias("clipped"))


@query
def headings_json(spark, sf):
    raw = F.when(F.col("page_id") % 4 == 0, F.to_json("headings")).when(F.col("page_id") % 4 == 1, F.lit('"one"')).when(F.col("page_id") % 4 == 2, F.lit("not json")).otherwise(F.lit(None))
    rows = _parsed(spark, sf).withColumn("raw", raw)
    return rows.select("page_id", shown(T.headings_list(F.col("raw"))).alias("kept"), shown(T.headings_list(F.col("raw"), "none")).alias("strict"))


@query
def login_wall(spark, sf):
    form = F.when(F.col("page_id") % 5 == 0, F.lit('<form><INPUT name=p type = "password"></form>')).otherwise(F.lit(""))
    return world.raw_pages(spark, sf).select("page_id", H.has_login_form(F.concat("html", form)).alias("login"))


@query
def content_kind(spark, sf):
    kinds = F.array(*map(F.lit, ["text/html; charset=utf-8", "application/pdf", "image/png", "", "Application/XHTML+xml ;q=1"]))
    rows = world.raw_pages(spark, sf).select("page_id", F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")).alias("t"))
    return rows.select("page_id", crawl.is_html(F.col("t")).alias("is_html"), crawl.content_kind(F.col("t")).alias("kind"))


# --- visits and scores


@query
def visits_window(spark, sf):
    return visits.window_of(world.visits(spark, sf), NOW, 14).select("user_id", "event_id", "url")


@query
def visit_referrer(spark, sf):
    rows = world.visits(spark, sf).withColumn("tab_id", F.col("event_id") % 3)
    return visits.with_referrer(rows).select("event_id", "tab_id", "url", "from_url")


@query
def sessionize(spark, sf):
    rows = visits.sessionize(world.ticks(spark, sf))
    return rows.select("user_id", "url", "title", F.round("start_s", 3).alias("start_s"), F.round("duration_s", 3).alias("duration_s"), "from_url")


@query
def url_days(spark, sf):
    return visits.url_days(world.visits(spark, sf))


@query
def day_gaps(spark, sf):
    return scoring.day_gaps(world.stand_in_places(world.visits(spark, sf)), ["user_id", "scope"]).select("user_id", "scope", F.col("day").cast("string").alias("day"), "gap")


def _visits(spark, sf):
    """Hubs are found in the visits by two paths, and then meet them: they are made once."""
    return settled(world.visits(spark, sf))


def _flagged(spark, sf):
    rows = _visits(spark, sf)
    return settled(places.with_hub_flags(rows, places.hubs(rows)))


def _stand_ins(spark, sf):
    return settled(scoring.with_arrivals(world.stand_in_places(_flagged(spark, sf))))


KEYS = ["user_id", "scope"]


@query
def arrivals(spark, sf):
    return _stand_ins(spark, sf).groupBy(*KEYS).agg(F.count_if("arrival").alias("arrivals"), F.count(F.lit(1)).alias("visits"))


def _feature(name: str) -> None:
    QUERIES[{"days": "decayed_days", "bounce": "bounce_rate", "regular": "regularity", "from_search": "from_search_share"}[name]] = lambda spark, sf: scoring.place_features(_stand_ins(spark, sf), KEYS, NOW).select(*KEYS, name)


for _name in ("days", "bounce", "regular", "from_search"):
    _feature(_name)


@query
def place_features(spark, sf):
    return scoring.place_features(_stand_ins(spark, sf), KEYS, NOW).select(*KEYS, "visits", "n_days", "days", "breadth", "bounce", "regular", "from_search")


@query
def features_json(spark, sf):
    rows = scoring.place_features(_stand_ins(spark, sf), KEYS, NOW)
    return rows.select(*KEYS, F.to_json(F.struct("visits", "n_days", "breadth")).alias("features"))


@query
def place_span(spark, sf):
    rows = scoring.visit_features(_stand_ins(spark, sf), KEYS)
    known = F.when(F.length("scope") % 2 == 0, F.lit(NOW - 40 * 86400))
    return rows.select(*KEYS, F.round(F.least("first_visit", known), 3).alias("first_visit"), F.round("last_visit", 3).alias("last_visit"))


@query
def revisit_score(spark, sf):
    return scoring.place_features(_stand_ins(spark, sf), KEYS, NOW).select(*KEYS, "revisit")


@query
def page_scores(spark, sf):
    rows = _flagged(spark, sf).withColumn("arrival", F.lit(True))
    return scoring.place_features(rows, ["user_id", "url"], NOW, DEFAULT.page_half_life, breadth=False).select("user_id", "url", "visits", "days", "bounce", "regular", "from_search", "revisit")


@query
def place_status(spark, sf):
    rows = scoring.place_features(_stand_ins(spark, sf), KEYS, NOW)
    return rows.select(*KEYS, scoring.status(F.col("revisit"), F.col("last_visit"), NOW).alias("status"))


# --- hubs and places


@query
def hub_stats(spark, sf):
    return places.hub_statistics(_visits(spark, sf))


@query
def hubs(spark, sf):
    return places.hubs(_visits(spark, sf))


@query
def hub_split(spark, sf):
    return _flagged(spark, sf).groupBy("user_id", "on_hub", "from_hub").agg(F.count(F.lit(1)).alias("n"))


def _regular_days(spark, sf):
    return visits.url_days(_flagged(spark, sf).where("not on_hub"))


@query
def prefix_weights(spark, sf):
    rows = places.directories(_regular_days(spark, sf))
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.size("node")), lambda i: F.concat(F.lit("/"), F.array_join(F.transform(F.slice("node", 1, i), lambda s: F.concat(s, F.lit("/"))), ""))))
    return rows.select("user_id", "origin", prefix.alias("prefix"), "n_days").groupBy("user_id", "origin", "prefix").agg(F.sum("n_days").alias("weight"))


@query
def tenant_children(spark, sf):
    rows = settled(places.directories(_regular_days(spark, sf)))
    out = None
    for depth in range(DEFAULT.max_depth):
        found = places.tenants(places.at_level(rows.where(F.size("node") >= depth), depth), depth)
        out = found if out is None else out.union(found)
    return out


@query
def place_groups(spark, sf):
    rows = places.group(_regular_days(spark, sf))
    return rows.groupBy("user_id", "scope").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n_days").alias("weight"))


@query
def all_places(spark, sf):
    return watch.Cycle(world.visits(spark, sf), NOW).placed().groupBy("user_id", "scope", "is_hub").agg(F.count(F.lit(1)).alias("n_urls"))


def _old_places(spark, sf):
    rows = watch.Cycle(world.visits(spark, sf).where(F.col("ts_s") < NOW - 14 * 86400), NOW).places()
    return rows.select("user_id", "scope", "status", "revisit", "first_visit")


@query
def retired_places(spark, sf):
    """Places of the whole history that the last two days no longer give."""
    now = watch.Cycle(world.visits(spark, sf).where(F.col("ts_s") >= NOW - 2 * 86400), NOW).placed()
    old = watch.Cycle(world.visits(spark, sf), NOW).places().select("user_id", "scope", "status", "revisit")
    return store.retired(old, now, ["user_id", "scope"])


@query
def watch_summary(spark, sf):
    return watch.summary(watch.Cycle(world.visits(spark, sf), NOW).places())


# --- the store


def _titles(spark, sf):
    return settled(world.pages(spark, sf).select("page_id", "url", "title", "headings", "visit_count", "revisit"))


def _stored_pages(rows):
    return rows.select("url", "title", "visit_count", "revisit")


def _fresh_pages(rows):
    """Every third page with another title, and a new page for every fifth."""
    again = rows.where("page_id % 3 = 0").select("url", F.when(F.col("page_id") % 2 == 0, F.concat("title", F.lit("!"))).alias("title"), F.lit(7).cast("long").alias("visit_count"), F.lit(9.0).alias("revisit"))
    return again.union(rows.where("page_id % 5 = 0").select(F.concat("url", F.lit("#new")), F.lit("new"), F.lit(1).cast("long"), F.lit(1.0)))


@query
def upsert_pages(spark, sf):
    rows = _titles(spark, sf)
    return store.upsert(_stored_pages(rows), _fresh_pages(rows), ["url"], ["title", "visit_count"], {"revisit": F.lit(0.0)})


@query
def upsert_places(spark, sf):
    old = world.places(spark, sf).select("scope", "alias", "status", "revisit")
    new = old.where("revisit >= 0.5").select("scope", F.lit("known").alias("alias"), F.lit("active").alias("status"), (F.col("revisit") / 2).alias("revisit"))
    new = new.union(spark.range(1).select(F.lit("https://new.example/"), F.lit("new"), F.lit("active"), F.lit(0.5)))
    return store.upsert(old, new, ["scope"], ["status", "revisit"]).select("scope", "alias", "status", F.round("revisit", 6).alias("revisit"))


@query
def upsert_links(spark, sf):
    rows = settled(world.links(spark, sf))
    new = rows.select("from_id", "to_id", F.concat("anchor", F.lit("!")).alias("anchor"), "context", (F.col("link_seq") + 10_000_000).alias("link_seq")).where("to_id % 2 = 0")
    return store.upsert_links(rows, new)


@query
def changed_pages(spark, sf):
    rows = _titles(spark, sf)
    old = _stored_pages(rows)
    return store.changed(_fresh_pages(rows).withColumn("revisit", F.lit(0.0)), old, ["url"], ["title", "visit_count"]).select("url", "title", "visit_count")


@query
def changed_names(spark, sf):
    read = world.read_pages(spark, sf)
    rows = world.pages(spark, sf, read).select("page_id", "url", "title", "headings")
    old = rows.select("url", F.when(F.col("page_id") % 2 == 0, F.col("title")).alias("name"))
    new = naming.names(rows, world.links(spark, sf, read)).where("name != ''")
    return store.changed(new, old, ["url"], ["name"])


@query
def places_listing(spark, sf):
    rows = world.places(spark, sf).where(F.col("status").isin("active", "probation"))
    pages = world.pages(spark, sf).select("place_id", "page_id")
    out = rows.join(pages, "place_id", "left").groupBy("scope", "status", F.round("revisit", 6).alias("revisit")).agg(F.count("page_id").alias("pages"))
    return out.orderBy(F.desc("revisit"), "scope").limit(30)


# --- the graph


def _graph(spark, sf):
    read = world.read_pages(spark, sf)
    pages = settled(world.pages(spark, sf, read))
    return pages, settled(world.links(spark, sf, read)), settled(world.places(spark, sf, pages))


@query
def link_dedup(spark, sf):
    rows = settled(world.html_links(spark, sf))
    twice = rows.union(rows.withColumns({"link_seq": F.col("link_seq") + 100, "anchor": F.concat("anchor", F.lit(" again"))}))
    some = twice.withColumn("anchor", F.when(F.col("link_seq") % 3 == 0, F.lit("")).otherwise(F.col("anchor")))
    return graph.deduped_targets(some).select("page_id", "target", "anchor", "link_seq")


@query
def link_texts(spark, sf):
    return graph.link_texts(settled(world.links(spark, sf))).select("page_id", shown("anchors").alias("anchors"), shown("contexts").alias("contexts"))


@query
def incoming_anchors(spark, sf):
    return graph.incoming_anchors(world.links(spark, sf)).select("page_id", shown("anchors").alias("anchors"))


@query
def page_with_place(spark, sf):
    pages, _, spots = _graph(spark, sf)
    return graph.page_with_place(pages, spots).select("page_id", "status", "place_alias", F.round("place_revisit", 6).alias("place_revisit"))


@query
def non_hub_pages(spark, sf):
    pages, _, spots = _graph(spark, sf)
    return graph.not_hubs(graph.page_with_place(pages, spots)).select("page_id")


@query
def inherited_revisit(spark, sf):
    return graph.inherited_revisit(*_graph(spark, sf)).select("page_id", F.round("inherited", 6).alias("inherited"))


@query
def effective_revisit(spark, sf):
    pages, links, spots = _graph(spark, sf)
    return graph.effective_revisit(graph.page_with_place(pages, spots), graph.inherited_revisit(pages, links, spots)).select("page_id", F.round("rv", 6).alias("rv"))


@query
def linking_site(spark, sf):
    return graph.linking_site(*_graph(spark, sf))


@query
def recent_or_one_hop(spark, sf):
    pages, links, _ = _graph(spark, sf)
    return graph.recent_or_near(pages, links, NOW).select("page_id", "visited")


@query
def page_label(spark, sf):
    return search.described_pages(*_with_texts(spark, sf)).select("page_id", "label")


@query
def page_description(spark, sf):
    return search.described_pages(*_with_texts(spark, sf)).select("page_id", "site", "description")


def _with_texts(spark, sf):
    pages, links, spots = _graph(spark, sf)
    return pages, graph.link_texts(links), links, spots


# --- names


def _titled(spark, sf, read=None):
    """Pages with a site's name at the end of some titles, unread counts and empty titles."""
    i = F.col("page_id")
    title = F.when(i % 6 == 0, F.lit("")).when(i % 3 == 0, F.concat(F.lit("("), i, F.lit(") "), "title", F.lit(" – Site Name"))).when(i % 3 == 1, F.lit("Home · Site Name")).otherwise(F.col("title"))
    rows = world.pages(spark, sf, world.read_pages(spark, sf) if read is None else read)
    return rows.select("page_id", F.concat(F.lit("https://site"), i % 5, F.lit(".example/p/"), i).alias("url"), title.alias("title"), "headings")


@query
def site_suffixes(spark, sf):
    return naming.site_suffixes(_titled(spark, sf))


@query
def clean_title(spark, sf):
    return naming.with_clean_titles(_titled(spark, sf)).select("page_id", "clean")


@query
def generic_titles(spark, sf):
    return naming.generic_titles(naming.with_clean_titles(_titled(spark, sf)))


@query
def page_names(spark, sf):
    read = world.read_pages(spark, sf)
    return naming.names(_titled(spark, sf, read), world.links(spark, sf, read).where("to_id % 4 = 0"))


# --- text, index and retrieval


@query
def normalize_text(spark, sf):
    return world.raw_pages(spark, sf).select("page_id", T.normalize_text(F.concat_ws(" ", F.lit("CSE452 L04! 007"), "url")).alias("normal"))


@query
def query_tokens(spark, sf):
    asked = F.concat(F.lit("the page of "), "query")
    return world.query_log(spark, sf).select("query_id", shown(T.query_tokens(asked), " ").alias("tokens"))


def _with_synonyms(spark, sf):
    return world.query_log(spark, sf).withColumn("query", F.concat("query", F.lit(" lectures pull request class hw the pr")))


@query
def match_string(spark, sf):
    groups = T.query_groups(T.query_tokens(F.col("query")))
    return _with_synonyms(spark, sf).select("query_id", T.match_string(groups).alias("match"))


@query
def query_atoms(spark, sf):
    return index.query_atoms(_with_synonyms(spark, sf)).select("query_id", "group_no", "atom_no", "kind", shown("words", " ").alias("words"))


def _doc_index(spark, sf):
    """Tokens are read several times, by tokens, by words and for lengths; they are made once, as lists."""
    docs = world.table(spark, sf, "documents").select(F.col("doc_id"), F.col("text"))
    lists = settled(index.token_lists(docs, "doc_id", ["text"]))
    return lists, index.doc_stats(docs.select("doc_id"), lists)


def _doc_queries(spark, sf):
    return world.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), world.first_words("text", 3).alias("query"))


@query
def fts_tokens(spark, sf):
    docs = world.table(spark, sf, "documents").select("doc_id", "text")
    # by document first: what is counted then is one row for each document and token, where the document's list is
    lists = index.token_lists(docs, "doc_id", ["text"]).repartition("doc_id")
    per = lists.select("doc_id", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


def _page_rows(spark, sf):
    read = world.read_pages(spark, sf)
    return index.page_fields(world.pages(spark, sf, read), graph.link_texts(settled(world.links(spark, sf, read))))


@query
def fts_postings(spark, sf):
    return index.postings(_page_rows(spark, sf), "page_id", list(DEFAULT.field_weights))


@query
def fts_incremental(spark, sf):
    rows = settled(_page_rows(spark, sf))
    old = index.postings(rows.withColumn("title", F.lit("stale")), "page_id", list(DEFAULT.field_weights))
    return index.updated_postings(old, rows.where("page_id % 2 = 0"), "page_id", list(DEFAULT.field_weights))


def _hits(spark, sf, kind: str, queries: DataFrame | None = None):
    posts = index.placed(_doc_index(spark, sf)[0])
    atoms = index.query_atoms(_doc_queries(spark, sf) if queries is None else queries).where(F.col("kind") == kind)
    return index.hits(posts, atoms).select(shown("words", " ").alias("words"), "doc_id", "pos")


@query
def fts_match(spark, sf):
    return _hits(spark, sf, "term")


@query
def fts_prefix(spark, sf):
    return _hits(spark, sf, "prefix")


@query
def fts_phrase(spark, sf):
    """The first two words of each benchmark text, as a phrase."""
    posts = index.placed(_doc_index(spark, sf)[0])
    two = T.split_words(T.index_text(world.first_words("text", 2)))
    atoms = world.table(spark, sf, "benchmark").select(F.lit("phrase").alias("kind"), two.alias("words")).where(F.size("words") == 2)
    return index.hits(posts, atoms).select(shown("words", " ").alias("words"), "doc_id", "pos")


@query
def bm25_stats(spark, sf):
    lists, stats = _doc_index(spark, sf)
    per = lists.repartition("doc_id").select("doc_id", F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    df = per.groupBy("token").agg(F.count("doc_id").alias("df"))
    whole = stats.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("len"), 6).alias("avg_len"))
    return df.join(F.broadcast(whole))  # one row


def _doc_matches(spark, sf):
    lists, stats = _doc_index(spark, sf)
    atoms = index.query_atoms(_doc_queries(spark, sf))
    return index.matches(index.hits(index.placed(lists), atoms), atoms, stats)


@query
def bm25(spark, sf):
    return _doc_matches(spark, sf).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@query
def term_coverage(spark, sf):
    return _doc_matches(spark, sf).select("query_id", "doc_id", "covered")


@query
def alias_word_df(spark, sf):
    return search.alias_word_df(world.places(spark, sf))


def _alias_queries(spark, sf):
    """Queries that name places: an alias after another word."""
    return world.places(spark, sf).select(F.col("place_id").alias("query_id"), F.concat(F.lit("open "), "alias", F.lit(" notes")).alias("query"))


@query
def alias_places(spark, sf):
    return search.alias_places(_alias_queries(spark, sf), world.places(spark, sf))


@query
def alias_boost(spark, sf):
    pages, links, spots = _graph(spark, sf)
    return search.alias_boosted(_alias_queries(spark, sf), pages, links, search.Aliases(spots))


@query
def applicable_picks(spark, sf):
    picked = settled(world.picks(spark, sf))
    return search.applicable_picks(world.query_log(spark, sf, picked), picked)


@query
def lookalike_collapse(spark, sf):
    rows = world.pages(spark, sf).select((F.col("page_id") % 3).alias("query_id"), "page_id", "url", F.round(F.col("revisit") + F.col("page_id") % 7, 6).alias("score"))
    return search.collapse(rows, 20).select("query_id", "page_id", "score", "rank")


def _index(spark, sf):
    pages, links, spots = _graph(spark, sf)
    return search.Index(pages, links, spots, world.picks(spark, sf, pages))


@query
def retrieve(spark, sf):
    made = _index(spark, sf)
    found = made.retrieve(world.query_log(spark, sf, made.picks), NOW)
    return found.select("query_id", "rank", "page_id", F.round("score", 4).alias("score"), "n_picks")


@query
def search_query(spark, sf):
    made = _index(spark, sf)
    return search.search(made, world.query_log(spark, sf, made.picks), NOW).select("query_id", "place", "page_id")


@query
def eval_loo(spark, sf):
    return search.evaluate(_index(spark, sf), NOW)


@query
def eval_summary(spark, sf):
    return search.summary(search.evaluate(_index(spark, sf), NOW))


# --- reranking


def _candidates(spark, sf):
    """Three candidates for each benchmark item."""
    items = world.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = items.select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"), "text")
    return rows.select("query_id", "rank", (F.col("query_id") * 3 + F.col("rank")).alias("page_id"), F.concat(F.lit("option "), "rank", F.lit(" of "), "query_id").alias("description"), ((F.col("query_id") + F.col("rank")) % 3).alias("n_picks"))


def _answers(spark, sf):
    i = F.col("item_id")
    say = F.element_at(
        F.array(
            F.lit('{"probabilities": {"c0": 0.1, "c1": 0.7, "c2": "x"}}'),
            F.lit('{"choice": "c2"}'),
            F.lit('{"choice": "c1", "confidence": 0.4}'),
            F.lit("not json"),
            F.lit('{"probabilities": {"c0": -1, "c1": 0}}'),
            F.lit('{"probabilities": {"c0": 0.04, "c2": 0.06}}'),
        ),
        (i % 6 + 1).cast("int"),
    )
    return world.table(spark, sf, "benchmark").select(i.alias("query_id"), say.alias("answer"))


@query
def rerank_request(spark, sf):
    return search.rerank_request(_candidates(spark, sf))


@query
def rerank_parse(spark, sf):
    return search.rerank_parse(_candidates(spark, sf), _answers(spark, sf)).select("query_id", "rank", "probability")


@query
def rerank_cutoff(spark, sf):
    rows = search.rerank_parse(_candidates(spark, sf), _answers(spark, sf))
    return search.ordered(rows).select("query_id", "place", "page_id")


# --- jobs and crawling


@query
def job_dedupe(spark, sf):
    rows = world.job_events(spark, sf)
    posts = rows.where("what = 'post'").select(F.col("event_id").alias("post_id"), "type", F.when(F.col("job_id") % 10 != 0, F.col("key")).alias("key"))
    pending = world.jobs(spark, sf).where("status = 'pending' and job_id % 2 = 0")
    return jobs.accepted(posts, pending)


@query
def job_claim(spark, sf):
    return jobs.claimed(world.jobs(spark, sf), ["crawl"], 5, NOW).select("job_id", "type", "status", "attempts")


@query
def job_state(spark, sf):
    return jobs.state(world.job_events(spark, sf)).select("job_id", "type", "key", "status", "attempts", F.round("changed_at", 3).alias("changed_at"), "error")


@query
def job_requeue(spark, sf):
    return jobs.requeued(world.jobs(spark, sf), NOW, 10 * 86400).select("job_id", "status", "requeued")


@query
def crawl_requests(spark, sf):
    n = world.html_links(spark, sf).groupBy("url").agg(F.count(F.lit(1)).alias("n_links"))
    captures = world.pages(spark, sf).select("url").join(n, "url", "left").select("url", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return crawl.requests(captures, world.pages(spark, sf), NOW)


def _targets(spark, sf, read=None):
    """Links of each page, and its neighbour in the table as a link of its site."""
    rows = world.html_links(spark, sf, read).select(F.col("page_id").alias("job_id"), F.col("url").alias("from_url"), F.col("target").alias("url"), "link_seq")
    own = world.pages(spark, sf).select(F.col("page_id").alias("job_id"), F.col("url").alias("from_url"), "url", F.lit(90).alias("link_seq"))
    below = own.select("job_id", "from_url", F.concat(urls.origin(F.col("url")), urls.directory(F.col("url")), F.lit("deep/page.html")).alias("url"), F.lit(91).alias("link_seq"))
    return rows.union(own).union(below)


def _frontier(spark, sf):
    read = world.read_pages(spark, sf)
    return crawl.frontier(_targets(spark, sf, read), world.pages(spark, sf, read), NOW)


@query
def crawl_frontier(spark, sf):
    return _frontier(spark, sf).select("from_url", "url", "link_seq", "relation")


@query
def crawl_budget(spark, sf):
    return crawl.budgeted(_frontier(spark, sf), 3).select("from_url", "url", "turn")


@query
def crawl_discover(spark, sf):
    scopes = world.pages(spark, sf).select(F.col("url").alias("from_url"), urls.origin(F.col("url")).alias("origin"), urls.directory(F.col("url")).alias("path_prefix"))
    return crawl.discovered(_targets(spark, sf), world.pages(spark, sf), scopes)


def _replies(spark, sf):
    """What fetching each page would give."""
    i = F.col("page_id")
    status = F.when(i % 9 == 0, 404).when(i % 9 == 1, 0).otherwise(200)
    kind = F.when(i % 9 == 2, "application/pdf").when(i % 9 == 3, "image/png").otherwise("text/html; charset=utf-8")
    form = F.when(i % 9 == 4, F.lit('<input type="password">')).otherwise(F.lit(""))
    body = F.when(F.startswith(kind, F.lit("text/")) & (status == 200), F.concat("html", form))
    return world.raw_pages(spark, sf).select("page_id", urls.normalize(F.col("url")).alias("url"), status.alias("status"), kind.alias("content_type"), urls.normalize(F.col("url")).alias("final_url"), body.alias("body"))


@query
def crawl_fetch_join(spark, sf):
    wanted = _frontier(spark, sf).select("url").distinct()
    got = wanted.join(_replies(spark, sf), "url", "left")
    return got.select("url", F.coalesce("status", F.lit(0)).alias("status"), F.col("body").isNotNull().alias("has_body"))


@query
def crawl_record(spark, sf):
    rows = crawl.recorded(_replies(spark, sf), world.pages(spark, sf), NOW, "page_id")
    return rows.select("url", "fetch_status", "kind", "title", F.size(F.coalesce("headings", F.array())).alias("n_headings"))


@query
def crawl_run(spark, sf):
    """Fetching by a function that knows no page but the even ones, and fails on the rest."""

    def fetch(url):
        if int("".join(c for c in url if c.isdigit()) or 0) % 2:
            raise ConnectionError(url)
        return 200, "text/html", url, f"<title>{url.partition('?')[0]}</title>"

    wanted = crawl.budgeted(_frontier(spark, sf)).select("url").distinct()
    return crawl.recorded(crawl.fetched(wanted, fetch), world.pages(spark, sf), NOW).select("url", "fetch_status", "title")


def _link_jobs(spark, sf, read=None):
    """A crawl job for each page with links, with all of its links; the payload of every tenth is broken."""
    rows = world.html_links(spark, sf, read).groupBy(F.col("page_id").alias("job_id"), "url").agg(F.array_sort(F.collect_list(F.struct("link_seq", "href", "anchor"))).alias("all"))
    links = F.transform("all", lambda x: F.array(x["href"], x["anchor"], F.lit("row")))
    payload = F.when(F.col("job_id") % 10 == 0, F.lit("broken")).otherwise(F.to_json(F.struct("url", links.alias("links"))))
    return rows.select("job_id", payload.alias("payload"))


@query
def crawl_counts(spark, sf):
    def fetch(url):
        return 200, "text/plain", url, None

    read = world.read_pages(spark, sf)
    pages = settled(world.pages(spark, sf, read))
    return crawl.run_jobs(_link_jobs(spark, sf, read), pages, world.places(spark, sf, pages), NOW, fetch, delay_s=0.0)["counts"]


@query
def job_keys(spark, sf):
    rows = world.job_events(spark, sf).where("what = 'post'")
    payload = F.when(F.col("job_id") % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"url": "u'), "job_id", F.lit('"}')))
    made = jobs.with_key(payload, F.when(F.col("job_id") % 4 != 0, F.col("key")))
    return rows.select("event_id", made.alias("payload"), jobs.payload_key(made).alias("key"))


@query
def upsert_meta(spark, sf):
    pages = world.raw_pages(spark, sf)
    old = pages.select(F.concat(F.lit("k"), "page_id").alias("key"), F.lit("old").alias("value"))
    new = pages.where("page_id % 3 = 0").select(F.concat(F.lit("k"), F.col("page_id") * 2).alias("key"), F.lit("new").alias("value"))
    return store.upsert(old, new, ["key"], ["value"])


@query
def robots_policy(spark, sf):
    i = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 500, 503, 0))), (i % 7 + 1).cast("int"))
    rows = world.pages(spark, sf).withColumn("url", F.concat(F.lit("https://h"), i % 7, F.lit(".example/"), F.when(i % 2 == 0, F.lit("private/")).otherwise(F.lit("open/")), i))
    robots = world.pages(spark, sf).select(F.concat(F.lit("https://h"), i % 7, F.lit(".example")).alias("origin"), status.alias("status"), F.lit("User-agent: *\nDisallow: /private/\n").alias("body")).distinct()
    return crawl.allowed(rows, robots).select("page_id", "allowed")


# --- streaming


@query
def page_captures(spark, sf):
    """Two readings into each visit: the first has no text on two of three."""
    from ..streaming.visits import captures

    visits = world.visits(spark, sf).select("event_id", "user_id", "url", F.col("ts_s").alias("start_s"), (F.col("duration_s") % 40).alias("duration_s"))
    seen = visits.join(world.events(spark, sf).select("event_id", "k"), "event_id")
    said = lambda after, text: seen.select("event_id", "user_id", (F.col("start_s") + after).alias("ts_s"), "url", text.alias("text"))
    texts = said(2.0, F.lit("too early")).union(said(4.0, F.when(F.col("k") % 3 == 0, F.lit("first")).otherwise(F.lit("")))).union(said(9.0, F.lit("between"))).union(said(16.0, F.lit("second")))
    return captures(visits, texts, visit="event_id").select("user_id", "url", F.round("start_s", 3).alias("start_s"), "turn", F.round(F.col("ts_s") - F.col("start_s"), 3).alias("after"), "text")


@query
def stream_visits(spark, sf):
    """The ticks as a stream, drained."""
    import tempfile

    from ..streaming.visits import VISIT, visit_stream

    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="trailmark-")
    import uuid

    base = f"{shared.rstrip('/')}/trailmark/stream-{uuid.uuid4().hex}"
    world.ticks(spark, sf).write.parquet(f"{base}/ticks")
    ticks = spark.readStream.schema(spark.read.parquet(f"{base}/ticks").schema).parquet(f"{base}/ticks")
    started = visit_stream(ticks).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/visits").trigger(availableNow=True).start()
    started.awaitTermination()
    rows = spark.read.schema(VISIT).parquet(f"{base}/visits")
    return rows.select("user_id", "url", "title", F.round("start_s", 3).alias("start_s"), F.round("duration_s", 3).alias("duration_s"), "from_url")
