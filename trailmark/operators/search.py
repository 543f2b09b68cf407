"""Retrieval, reranking and evaluation, for any number of queries at once: one search is a batch of one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..functions import urls
from ..sources.shared import settled
from . import graph, index


def alias_words(places: DataFrame) -> DataFrame:
    """place_id, words: of the places' aliases."""
    return places.where("alias != ''").select("place_id", T.split_words(T.index_text(F.col("alias"))).alias("words"))


def alias_word_df(places: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """word, n: in how many places' aliases each word is."""
    said = (alias_words(places) if named is None else named).select("place_id", F.explode(F.array_distinct("words")).alias("word"))
    return said.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Aliases:
    """The places' aliases, run together and by the words that at most two of them have."""

    def __init__(self, places: DataFrame, keep: Callable[[DataFrame], DataFrame] = settled):
        named = keep(alias_words(places))
        self.whole = keep(named.select("place_id", F.array_join("words", "").alias("gram")))
        rare = alias_word_df(places, named).where("n <= 2").select("word")
        self.words = keep(named.select("place_id", F.explode(F.array_distinct("words")).alias("word")).join(rare, "word"))

    def named_by(self, queries: DataFrame) -> DataFrame:
        """query_id, place_id: places that a query names - one to three neighbouring words of it, run together, are the
        alias run together, or it has a word that at most two aliases have. Both are equi joins."""
        said = queries.select("query_id", index.tokens_of(queries).alias("tokens")).where(F.size("tokens") > 0)
        starts = F.sequence(F.lit(1), F.size("tokens"))
        grams = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.transform(starts, lambda i: F.array_join(F.slice("tokens", i, n), ""))))
        grams = said.select("query_id", F.explode(F.array_distinct(grams)).alias("gram"))
        words = said.select("query_id", F.explode(F.array_distinct("tokens")).alias("word"))
        return grams.join(self.whole, "gram").select("query_id", "place_id").union(words.join(self.words, "word").select("query_id", "place_id")).distinct()


def alias_places(queries: DataFrame, places: DataFrame) -> DataFrame:
    return Aliases(places).named_by(queries)


class PastPicks:
    """Past picks (pick_id, query, page_id) by the distinct sets of their queries' words, for looking up what applies.

    A word set lies in another only if its rarest word is in the other, so each meets the others by that one word, and
    is then compared; common words bring nothing together."""

    def __init__(self, picks: DataFrame, keep: Callable[[DataFrame], DataFrame] = settled):
        rows = keep(picks.select("page_id", _word_set(picks).alias("past")).where(F.size("past") > 0).groupBy("past", "page_id").agg(F.count(F.lit(1)).alias("n")))
        self.per = rows
        self.words = keep(rows.select("past").distinct().select("past", F.explode("past").alias("w")))
        self.common = keep(self.words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
        self.rarest = keep(self.words.join(self.common, "w").groupBy("past").agg(F.min_by("w", F.struct("n", "w")).alias("w")))

    def applicable(self, queries: DataFrame) -> DataFrame:
        """query_id, page_id, n_picks: past picks whose query's words are all in the query, or the other way round."""
        asked = queries.select("query_id", _word_set(queries).alias("tokens")).where(F.size("tokens") > 0)
        mine = asked.select("tokens").distinct().select("tokens", F.explode("tokens").alias("w"))
        own = mine.join(self.common, "w", "left").groupBy("tokens").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
        wider = own.join(self.words, "w").where(F.size(F.array_except("tokens", "past")) == 0)
        narrower = mine.join(self.rarest, "w").where(F.size(F.array_except("past", "tokens")) == 0)
        alike = wider.select("tokens", "past").union(narrower.select("tokens", "past")).distinct()
        return asked.join(alike, "tokens").join(self.per, "past").groupBy("query_id", "page_id").agg(F.sum("n").alias("n_picks"))


def _word_set(queries: DataFrame) -> Column:
    return F.array_sort(F.array_distinct(index.tokens_of(queries)))


def applicable_picks(queries: DataFrame, picks: DataFrame) -> DataFrame:
    return PastPicks(picks).applicable(queries)


def recorded_pick(picks: DataFrame, query: str, page_id: int, now: float) -> DataFrame:
    """picks (pick_id, query, page_id, ts_s) and one more: that this page was opened for this query."""
    last = picks.agg((F.coalesce(F.max("pick_id"), F.lit(-1)) + 1).alias("pick_id"))
    return picks.unionByName(last.select("pick_id", F.lit(query).alias("query"), F.lit(page_id).cast("long").alias("page_id"), F.lit(float(now)).alias("ts_s")), allowMissingColumns=True)


def collapse(ranked: DataFrame, k: int) -> DataFrame:
    """Of each query's first 2k by score, the best of each URL template, k at most, numbered by rank (from 1)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    first = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k)
    alike = Window.partitionBy("query_id", urls.lookalike_key(F.col("url"))).orderBy("r")
    one = first.withColumn("a", F.row_number().over(alike)).where("a = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).where(F.col("rank") <= k).drop("r", "a")


class Index:
    """What retrieval reads: pages (page_id, url, kind, name, title, headings, snippet, place_id, visited, last_visit,
    revisit), links, places, picks (pick_id, query, page_id), and the postings of the pages.

    Built from relations, or opened over postings that a catalog keeps and brings up to date (stored())."""

    def __init__(self, pages: DataFrame, links: DataFrame, places: DataFrame, picks: DataFrame, settings: Settings = DEFAULT, posts: DataFrame | None = None):
        keep = settled if posts is None else (lambda df: df)
        self.pages, self.links, self.places, self.picks, self.settings = keep(pages), keep(links), keep(places), keep(picks), settings
        self.texts = keep(graph.link_texts(self.links, settings.max_link_texts))
        if posts is None:
            posts = settled(index.postings(index.page_fields(self.pages, self.texts), "page_id", list(settings.field_weights)))
        self.posts = posts
        self.stats = keep(index.doc_stats(self.pages, self.posts, "page_id"))
        self.rated = keep(self._rated())
        self.seen = keep(self.pages.select("page_id", "visited", "last_visit"))
        self.past = PastPicks(self.picks, keep)
        self.aliases = Aliases(self.places, keep)
        self.tokens = keep(index.token_heads(self.posts))

    def _rated(self) -> DataFrame:
        """Pages outside hubs and their score of being visited again."""
        placed = graph.page_with_place(self.pages, self.places)
        rated = graph.effective_revisit(graph.not_hubs(placed), graph.inherited_revisit(self.pages, self.links, self.places))
        return rated.select("page_id", "url", "kind", "rv")

    def resident(self) -> Index:
        """The same, with what a search reads in the executors' memory, spread over them."""
        parts = [(self, n) for n in ("pages", "posts", "stats", "rated", "seen", "links", "tokens")] + [(self.past, n) for n in ("per", "words", "common", "rarest")] + [(self.aliases, n) for n in ("whole", "words")]
        for holder, name in parts:
            setattr(holder, name, getattr(holder, name).persist())
            getattr(holder, name).count()
        return self

    def retrieve(self, queries: DataFrame, now: float, k: int | None = None, recent_days: int | None = DEFAULT.recent_days) -> DataFrame:
        """query_id, rank, page_id, url, kind, score, n_picks of the first k candidates of each query (query_id, query; with
        a column `hidden`, one past pick of that query for that page does not count). Each distinct text is looked up once."""
        k = k or self.settings.candidates
        asked = queries.withColumn("text_id", F.xxhash64("query"))
        texts = asked.groupBy(F.col("text_id").alias("query_id")).agg(F.any_value("query").alias("query"))
        texts = settled(texts.select("query_id", T.query_tokens(F.col("query")).alias("tokens")))
        atoms = index.query_atoms(texts)
        found = index.matches(index.hits(self.posts, atoms, self.tokens), atoms, self.stats, self.settings.field_weights).withColumnRenamed("doc_id", "page_id")
        rated = self.rated.join(graph.recent_or_near(self.seen, self.links, now, recent_days).select("page_id"), "page_id", "left_semi")
        picks = self.past.applicable(texts)
        boosted = alias_boosted(texts, self.pages, self.links, self.aliases).withColumn("boost", F.lit(self.settings.alias_boost))
        rows = found.join(rated, "page_id").join(picks, ["query_id", "page_id"], "left").join(boosted, ["query_id", "page_id"], "left")
        rows = rows.withColumnRenamed("query_id", "text_id").join(asked.drop("query"), "text_id")
        own = (F.col("hidden") == F.col("page_id")).cast("int") if "hidden" in queries.columns else F.lit(0)
        n_picks = F.coalesce("n_picks", F.lit(0)) - F.coalesce(own, F.lit(0))
        relevance = F.col("bm25") + self.settings.coverage * F.col("covered")
        # the last places of a sum depend on its order, and must not decide
        score = F.round(relevance * (0.5 + F.col("rv")) * (1 + n_picks) * F.coalesce("boost", F.lit(1.0)), 10)
        return collapse(rows.select("query_id", "page_id", "url", "kind", score.alias("score"), n_picks.alias("n_picks")), k)

    def described(self, candidates: DataFrame) -> DataFrame:
        """candidates, with label and description."""
        shown = described_pages(self.pages, self.texts, self.links, self.places).select("page_id", "label", "description")
        return candidates.join(shown, "page_id")


def described_pages(pages: DataFrame, texts: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """pages, with label (the name, if there is one), site and description."""
    none = F.array().cast("array<string>")
    url = F.col("url")
    tail = urls.unquoted(F.try_element_at(urls.segments(url), F.lit(-1)))
    rows = graph.page_with_place(pages, places).join(texts, "page_id", "left").join(graph.linking_site(pages, links, places), "page_id", "left")
    rows = rows.withColumns({"anchors": F.coalesce("anchors", none), "contexts": F.coalesce("contexts", none)})
    rows = rows.withColumn("label", F.coalesce(F.nullif("name", F.lit("")), graph.label(F.col("anchors"), F.col("contexts"), F.col("title"), F.col("headings"), tail, urls.host(url))))
    rows = rows.withColumn("site", F.coalesce("place_alias", "place_origin", "site", urls.host(url), F.lit("")))
    text = graph.description(F.col("label"), F.col("site"), urls.bare_host(url), urls.unquoted(urls.path(url)), F.col("kind"), F.col("contexts"), F.col("anchors"), F.col("snippet"))
    return rows.withColumn("description", text)


def alias_boosted(queries: DataFrame, pages: DataFrame, links: DataFrame, aliases: Aliases) -> DataFrame:
    """query_id, page_id: pages in a place that the query names, or that a page in one links to."""
    named = aliases.named_by(queries)
    inside = named.join(pages.select("place_id", "page_id"), "place_id")
    linked = inside.select("query_id", F.col("page_id").alias("from_id")).join(links.select("from_id", F.col("to_id").alias("page_id")), "from_id")
    return inside.select("query_id", "page_id").union(linked.select("query_id", "page_id")).distinct()


# --- reranking


def rerank_request(candidates: DataFrame, most: int = DEFAULT.candidates) -> DataFrame:
    """query_id, criteria (JSON object: c0, c1, ... -> description, in rank order)."""
    few = candidates.where(F.col("rank") <= most)
    pair = F.struct("rank", F.concat(F.lit("c"), (F.col("rank") - 1).cast("string")).alias("k"), F.col("description").alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))
    return few.groupBy("query_id").agg(F.to_json(F.map_from_entries(rows)).alias("criteria"))


def rerank_parse(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """candidates and probability. answers: query_id, answer (JSON: choice, confidence, probabilities by c0, c1, ...).

    What is missing, negative or no number is 0. An answer with a choice only gives that one its confidence (or 1). An
    answer that cannot be read, or has nothing above 0, gives nulls: the local order stands."""
    schema = "choice string, confidence string, probabilities map<string,string>"
    a = F.from_json("answer", schema)
    number = lambda s: F.greatest(F.coalesce(s.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    read = answers.select("query_id", a["choice"].alias("choice"), a["confidence"].alias("confidence"), a["probabilities"].alias("probabilities"))
    rows = candidates.join(read, "query_id", "left")
    key = F.concat(F.lit("c"), (F.col("rank") - 1).cast("string"))
    listed = F.coalesce(F.size("probabilities"), F.lit(-1)) > 0
    only = F.when(F.col("choice") == key, F.when(F.col("confidence").isNull(), 1.0).otherwise(number(F.col("confidence")))).otherwise(0.0)
    p = F.when(listed, number(F.try_element_at("probabilities", key))).when(F.col("choice") != "", only).otherwise(0.0)
    best = F.max("p").over(Window.partitionBy("query_id"))
    return rows.withColumn("p", p).withColumn("probability", F.when(best > 0, F.col("p"))).drop("p", "choice", "confidence", "probabilities")


def ordered(rows: DataFrame, k: int = DEFAULT.results, least: float = DEFAULT.least_probability) -> DataFrame:
    """The k results of each query, `place` from 1: by probability times (1 + past picks), those under `least` left out;
    without probabilities by rank."""
    rated = rows.withColumn("weight", F.col("probability") * (1 + F.col("n_picks"))).where("weight is null or weight >= " + repr(least))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("weight"), "rank")
    return rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("weight")


Scorer = Callable[[str, list[str]], str | None]


def asked(queries: DataFrame, requests: DataFrame, scorer: Scorer) -> DataFrame:
    """query_id, answer: what a scorer (query, descriptions -> JSON) says; a failure is no answer. Requests with one
    candidate are not sent."""
    rows = queries.select("query_id", "query").join(requests, "query_id")

    def run(batches):
        import json

        for batch in batches:
            out = []
            for query, criteria in zip(batch["query"], batch["criteria"]):
                try:
                    choices = list(json.loads(criteria).values())
                    out.append(scorer(query, choices) if len(choices) > 1 else None)
                except Exception:  # noqa: BLE001  a search never fails because of its scorer
                    out.append(None)
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": out})

    return rows.select("query_id", "query", "criteria").mapInPandas(run, rows.select("query_id", F.lit(None).cast("string").alias("answer")).schema)


def search(index_: Index, queries: DataFrame, now: float, scorer: Scorer | None = None, k: int = DEFAULT.results, **how) -> DataFrame:
    """query_id, place, page_id, url, kind, score, probability of each query's results."""
    found = index_.retrieve(queries, now, **how)
    if scorer is None:
        rows = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        rows = rerank_parse(found, asked(queries, rerank_request(index_.described(found)), scorer))
    return ordered(rows, k).select("query_id", "place", "page_id", "url", "kind", "score", "probability")


# --- evaluation


def evaluate(index_: Index, now: float, **how) -> DataFrame:
    """case_id, picked, got (first result), hit1, hit5: every past pick's query, with just that pick hidden. A pick always
    applies to its own query, so hiding it takes one from its page's picks; equal picks share one search."""
    cases = index_.picks.join(index_.pages.select("page_id"), "page_id", "left_semi").select("pick_id", "query", "page_id")
    own = F.xxhash64("query", "page_id")
    queries = cases.groupBy("query", "page_id").agg(F.count(F.lit(1))).select(own.alias("query_id"), "query", F.col("page_id").alias("hidden"))
    top = search(index_, queries, now, **how)
    per = top.groupBy("query_id").agg(F.min_by("page_id", "place").alias("got"), F.collect_set("page_id").alias("all"))
    rows = cases.select("pick_id", own.alias("query_id"), F.col("page_id").alias("picked")).join(per, "query_id", "left")
    return rows.select(
        F.col("pick_id").alias("case_id"), "picked", "got", F.coalesce(F.col("got") == F.col("picked"), F.lit(False)).alias("hit1"), F.coalesce(F.array_contains("all", F.col("picked")), F.lit(False)).alias("hit5")
    )


def summary(cases: DataFrame) -> DataFrame:
    """cases, top1, top5 (shares, 2 places), misses."""
    share = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 2), F.lit(0.0))
    return cases.agg(F.count(F.lit(1)).alias("cases"), share("hit1").alias("top1"), share("hit5").alias("top5"), F.coalesce(F.sum((~F.col("hit1")).cast("long")), F.lit(0)).alias("misses"))
