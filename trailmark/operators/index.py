"""Full-text index as tables, and weighted BM25 over any number of queries at once.

postings: doc_id, field, pos, token; doc_stats: doc_id, len. Queries are atoms - a word, a word's beginning, a phrase.
Beginnings are first resolved against the distinct tokens, by an equi join on their first three letters, so that no
atom meets the postings by anything but equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..functions import urls
from ..sources.shared import settled

#: Values of a token's hash that postings are sifted by.
SIEVE = 1 << 16
K1, B_LENGTH, LEAST_IDF = 1.2, 0.75, 1e-6


def page_fields(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id and the six texts of a page. pages: page_id, url, name, title, snippet, headings (array); texts: as
    from graph.link_texts."""
    none = F.array().cast("array<string>")
    joined = pages.join(texts, "page_id", "left")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return joined.select(
        "page_id",
        F.concat_ws(" | ", full("name"), full("title")).alias("title"),
        F.array_join(F.coalesce("anchors", none), " | ").alias("anchors"),
        F.array_join(F.coalesce("contexts", none), " | ").alias("contexts"),
        F.array_join(F.coalesce("headings", none), " ").alias("headings"),
        F.coalesce("snippet", F.lit("")).alias("snippet"),
        urls.words(F.col("url")).alias("words"),
    )


def token_lists(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """doc_id, field, tokens (array) of the texts in `fields`: postings in a row for each text."""
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("part")
    long = rows.select(F.col(key).alias("doc_id"), parts).select("doc_id", "part.*")
    return long.select("doc_id", "field", T.split_words(T.index_text(F.col("text"))).alias("tokens"))


def placed(lists: DataFrame) -> DataFrame:
    """doc_id, field, pos, token of token_lists()."""
    return lists.select("doc_id", "field", F.posexplode("tokens").alias("pos", "token"))


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """doc_id, field, pos, token of the texts in `fields`."""
    return placed(token_lists(rows, key, fields))


def doc_stats(all_docs: DataFrame, posts: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, len (tokens in all fields; 0 for a document without any). posts: postings or token_lists()."""
    size = F.sum(F.size("tokens")) if "tokens" in posts.columns else F.count(F.lit(1))
    sizes = posts.groupBy("doc_id").agg(size.alias("len"))
    return all_docs.select(F.col(key).alias("doc_id")).join(sizes, "doc_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))


def updated_postings(old: DataFrame, new_rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The index after the rows in new_rows (those that are dirty) have been indexed again."""
    kept = old.join(new_rows.select(F.col(key).alias("doc_id")), "doc_id", "left_anti")
    return kept.unionByName(postings(new_rows, key, fields))


def tokens_of(queries: DataFrame) -> Column:
    """The queries' tokens: those that have been made, else from their texts."""
    return F.col("tokens") if "tokens" in queries.columns else T.query_tokens(F.col("query"))


def query_atoms(queries: DataFrame) -> DataFrame:
    """query_id, group_no, atom_no, kind, words of each query (query_id, and query or tokens)."""
    grouped = queries.select("query_id", F.posexplode(T.query_groups(tokens_of(queries))).alias("group_no", "atoms"))
    return grouped.select("query_id", "group_no", F.posexplode("atoms").alias("atom_no", "atom")).select("query_id", "group_no", "atom_no", "atom.kind", "atom.words")


def token_heads(posts: DataFrame) -> DataFrame:
    """token, head: the distinct tokens and their first three letters."""
    return posts.select("token").distinct().withColumn("head", F.left("token", F.lit(3)))


def _sifted(posts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The postings of tokens whose hash one of `tokens` has: few, for few tokens, before anything is sent by its token.
    The hashes are one row of SIEVE flags, whatever the number of tokens."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("int")
    have = tokens.select(at("token").alias("i")).distinct().withColumn("there", F.lit(True))
    all_ = tokens.sparkSession.range(SIEVE).select(F.col("id").cast("int").alias("i")).join(have, "i", "left")
    flags = all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("there", F.lit(False)).alias("there")))), lambda x: x["there"]).alias("flags"))
    return posts.join(F.broadcast(flags), F.get("flags", at("token"))).select(*posts.columns)  # one row


def hits(posts: DataFrame, atoms: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """kind, words, doc_id, field, pos: where each distinct atom is found; a phrase within one field. tokens: as from
    token_heads(posts), if it is stored; else the postings are for one use, and sifted first."""
    once = tokens is None
    tokens = token_heads(posts) if once else tokens
    wanted = atoms.select("kind", "words").distinct()
    first = F.try_element_at("words", F.lit(1))
    exact = wanted.where("kind = 'term'").select("kind", "words", first.alias("token"))
    starts = wanted.where("kind = 'prefix'").select("kind", "words", first.alias("start"), F.left(first, F.lit(3)).alias("head"))
    begun = tokens.join(starts, "head").where(F.startswith("token", F.col("start"))).select("kind", "words", "token")
    keyed = exact.union(begun)
    phrases = wanted.where("kind = 'phrase'").select("kind", "words", F.size("words").alias("n"), F.posexplode("words").alias("i", "token"))
    if once:
        keyed = settled(keyed)
        posts = _sifted(posts, keyed.select("token").union(phrases.select("token")))
    single = posts.join(keyed, "token").select("kind", "words", "doc_id", "field", "pos")
    places = posts.join(phrases, "token").select("kind", "words", "n", "doc_id", "field", (F.col("pos") - F.col("i")).alias("pos"), "i")
    whole = places.groupBy("kind", "words", "n", "doc_id", "field", "pos").agg(F.count_distinct("i").alias("found")).where("found = n")
    return single.union(whole.select("kind", "words", "doc_id", "field", "pos"))


def matches(found: DataFrame, atoms: DataFrame, stats: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, bm25, covered (groups with a hit). An atom that two groups have counts twice; the frequency
    is over all documents; an idf that is not positive becomes LEAST_IDF."""
    weights = weights or DEFAULT.field_weights
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()), F.lit(1.0))
    per = found.groupBy("kind", "words", "doc_id").agg(F.sum(weight).alias("f"))
    df = per.groupBy("kind", "words").agg(F.count(F.lit(1)).alias("n"))
    whole = stats.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rated = per.join(df, ["kind", "words"]).join(stats, "doc_id").join(F.broadcast(whole))  # one row
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    length = K1 * (1 - B_LENGTH + B_LENGTH * F.col("len") / F.col("avg_len"))
    rated = rated.select("kind", "words", "doc_id", (idf * F.col("f") * (K1 + 1) / (F.col("f") + length)).alias("score"))
    return atoms.join(rated, ["kind", "words"]).groupBy("query_id", "doc_id").agg(F.sum("score").alias("bm25"), F.count_distinct("group_no").alias("covered"))
