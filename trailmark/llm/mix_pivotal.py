"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken f = target / source size times. The whole part is fixed; the rest is a
probability. Probabilities meet in duels: two documents of nearly the same size exchange mass - counted in words, so
that the source's expected words stay exactly as they are - in a random direction until one of them is at 0 or 1.
Each bounded block leaves at most one undecided document, the blocks' leftovers meet in the next level's blocks, and
so on up to one leftover for each source, which is rounded to the nearer whole number. Chances come from hashes, so
that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .space import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, get the weights in turn; a target above `most`
    times its source is cut there and the excess goes to the others by weight. Sorted by cap / weight, a source is
    cut exactly when its cap is at most its part of what the sources before it leave - so one pass replaces the loop.
    The windows are over sources, not documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    per = sums.withColumn("weight", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "mass": F.sum("source_size").over(whole) * F.lit(float(share)),
            "before": F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", (F.col("mass") - F.col("before")) / F.col("rest"))
    per = per.withColumn("cut", F.col("cap") <= F.col("level") * F.col("weight"))
    per = per.withColumn("common", F.min(F.when(~F.col("cut"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    target = F.when(F.col("cut"), F.col("cap")).otherwise(F.least(F.col("common") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _chance(seed: int, *of: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") / F.lit(float(1 << 53))


def _duels(units: Column, seed: int) -> Column:
    """Sequential duels over units sorted by size, largest first: array of units, of which the last may be undecided.

    A unit is struct(size, mark, row, p); size > 0. `mark` is a hash that breaks ties and feeds the chances.
    """

    def meet(state: Column, new: Column) -> Column:
        held = state["held"]
        up = F.least((1 - held["p"]) * held["size"], new["p"] * new["size"])
        down = F.least(held["p"] * held["size"], (1 - new["p"]) * new["size"])
        won = _chance(seed, held["mark"], new["mark"]) * (up + down) < down
        moved = F.when(won, up).otherwise(-down)
        a = held["p"] + moved / held["size"]
        b = new["p"] - moved / new["size"]
        snap = lambda p: F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)
        first, second = held.withField("p", snap(a)), new.withField("p", snap(b))
        settled = first["p"].isin(0.0, 1.0)
        return F.struct(
            F.concat(state["done"], F.array(F.when(settled, first).otherwise(second))).alias("done"),
            F.when(settled, second).otherwise(first).alias("held"),
        )

    start = F.struct(F.slice(units, 1, 0).alias("done"), F.get(units, F.lit(0)).alias("held"))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, meet, lambda s: F.concat(s["done"], F.array(s["held"])))


def copies(units: DataFrame, row: str = "row", seed: int = 17, block: int = BLOCK) -> DataFrame:
    """source, row, copies int for units of: source, row (any type, carried), size long, f double (0 to 2).

    Units without words are never taken. Blocks of the first level hold one size class of one source and about
    `block` units at most whatever a source's or class's share of all rows; later levels hold `block` leftovers.
    Equal units are counted, and told apart by numbers: so they are dealt to blocks like any others.
    """
    units = units.groupBy("source", F.col(row).alias("row"), "size", "f").agg(F.count(F.lit(1)).alias("n"))
    units = units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    whole = F.floor("f")
    rest = F.col("f") - whole
    rest = F.when(rest < 1e-9, 0.0).when(rest > 1 - 1e-9, 1.0).otherwise(rest)
    base = units.select("source", "row", "size", "nth", whole.cast("int").alias("whole"), rest.alias("p"))
    base = written(base.withColumn("mark", F.xxhash64(F.lit(seed), F.col("row"), F.col("size"), F.col("nth"))), "mix-units")
    settled = base.where((F.col("size") <= 0) | F.col("p").isin(0.0, 1.0))
    out = settled.select("source", "row", F.when(F.col("size") <= 0, 0).otherwise(F.col("whole") + F.col("p").cast("int")).cast("int").alias("copies"))
    open_ = base.where((F.col("size") > 0) & ~F.col("p").isin(0.0, 1.0))
    n = base.count()
    salts = max(1, -(-n // block))
    unit = F.struct("size", "mark", F.struct("row", "whole").alias("row"), "p")
    level = open_.select("source", F.floor(F.log2("size") * 4).cast("int").alias("class"), F.pmod("mark", F.lit(salts)).alias("salt"), unit.alias("unit"))
    keys, step = ["source", "class", "salt"], 0
    while True:
        step += 1
        met = level.groupBy(*keys).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        met = met.select(*keys, F.explode(_duels(F.col("units"), seed + step)).alias("unit"))
        met = written(met, f"mix-level{step}")
        last = keys == ["source"]
        whole_p = F.col("unit.p").isin(0.0, 1.0)
        done = met if last else met.where(whole_p)
        p = F.round(F.col("unit.p")).cast("int")
        out = out.unionByName(done.select("source", F.col("unit.row.row").alias("row"), (F.col("unit.row.whole") + p).alias("copies")))
        if last:
            return out
        level = met.where(~whole_p)
        if salts > 1:
            salts = -(-salts // block)
            level = level.withColumn("salt", F.floor(F.col("salt") / block).cast("long"))
        else:
            keys, level = ["source"], level.drop("class", "salt")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for each row of docs.

    Null texts have size 0, null sources are one source that comes last; repeated rows are each decided by
    themselves. An empty table, or one without words, gives no copies.
    """
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size")), "mix-sizes")
    targets = written(source_targets(sized), "mix-targets")
    same = sized["source"].eqNullSafe(targets["source"])
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(targets, same, "left").select(sized["source"], "doc_id", "size", "source_size", "target", f.alias("f"))
    units = joined.select("source", F.struct("doc_id", "size", "source_size", "target").alias("row"), "size", "f")
    return copies(units, **how).select("source", "row.*", "copies")


def mixed_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows that share an id are taken as often as one of them."""
    taken = mix(docs, text, doc_id, source, **how).groupBy("doc_id").agg(F.max("copies").alias("__tm_copies"))
    taken = taken.where("__tm_copies > 0").withColumnRenamed("doc_id", "__tm_id")
    joined = docs.join(taken, docs[doc_id].eqNullSafe(taken["__tm_id"]))
    return joined.withColumn("__tm_copy", F.explode(F.sequence(F.lit(1), "__tm_copies"))).select(*(docs[c] for c in docs.columns))
