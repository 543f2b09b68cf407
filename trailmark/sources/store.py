"""Snapshots of relations as Parquet folders, and writing to them by key.

A commit is one file that names the current folder of every relation. It gets the next number, and appears whole and at
once, by a rename to a name that does not exist yet: a reader sees all relations as they were before or as they are
after, and a crash at any point leaves the last commit. Who loses the race for a number reads the winner's commit and
takes the next, as long as the winner wrote other relations; else the write is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import file_system, hadoop_path


class Conflict(RuntimeError):
    """Another writer has committed one of the same relations since this one began."""


class Catalog:
    """Relations under a root folder of any file system that Spark can reach and that renames files atomically."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = file_system(spark, self.root)

    def _path(self, *parts: str):
        return hadoop_path(self.spark, "/".join((self.root, *parts)))

    def commits(self) -> list[int]:
        """Numbers of all commits."""
        if not self.fs.exists(self._path("commits")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("commits"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self) -> tuple[int, dict[str, str]]:
        """Number of the last commit (-1: none), and each relation's folder."""
        found = self.commits()
        if not found:
            return -1, {}
        stream = self.fs.open(self._path("commits", f"{found[-1]:012d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return found[-1], json.loads(raw)

    def version(self, name: str) -> str | None:
        return self.manifest()[1].get(name)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The relation as of the last commit. One that was never written is empty, if a schema is given."""
        version = self.version(name)
        if version is None:
            if schema is None:
                raise LookupError(f"{name} has not been written, and no schema is given")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> None:
        self.write_all({name: df})

    def write_all(self, relations: dict[str, DataFrame], before_commit: Callable[[], None] | None = None) -> int:
        """All or none: every relation is written before one commit makes all of them current. Returns its number."""
        _, began = self.manifest()
        done = {}
        for name, df in relations.items():
            done[name] = uuid.uuid4().hex
            df.write.parquet(f"{self.root}/{name}/{done[name]}")
        if before_commit:
            before_commit()
        self.fs.mkdirs(self._path("commits"))
        while True:
            number, now = self.manifest()
            if taken := [n for n in done if now.get(n) != began.get(n)]:
                raise Conflict(f"written by another: {', '.join(taken)}")
            if self._commit(number + 1, now | done):
                return number + 1

    def _commit(self, number: int, manifest: dict[str, str]) -> bool:
        """False if the number is taken."""
        target, temp = self._path("commits", f"{number:012d}.json"), self._path("commits", f".{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.exists(target) and self.fs.rename(temp, target):
            return True
        self.fs.delete(temp, False)
        return False

    def vacuum(self, keep: int = 2) -> None:
        """Removes commits but the last `keep`, and folders that none of those names. Not while others write."""
        found = self.commits()
        last = set()
        for number in found[-keep:]:
            stream = self.fs.open(self._path("commits", f"{number:012d}.json"))
            last |= {*json.loads(bytes(stream.readAllBytes())).items()}
            stream.close()
        for number in found[:-keep]:
            self.fs.delete(self._path("commits", f"{number:012d}.json"), False)
        for name in {n for n, _ in last}:
            for f in self.fs.listStatus(self._path(name)):
                if (name, f.getPath().getName()) not in last:
                    self.fs.delete(f.getPath(), True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new put in by key. Only `columns` are written - nulls too: what is not listed stays as it
    is, or takes its default in a new row. new has one row for each key."""
    defaults = defaults or {}
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    there = F.col("b.__new").isNotNull()
    was = F.col("a.__old").isNotNull()
    out = []
    for c in old.columns:
        if c in keys or c in columns:
            out.append(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            out.append(F.when(was, F.col(f"a.{c}")).otherwise(defaults.get(c, F.lit(None))).alias(c))
    return a.join(b, condition, "full").select(*out)


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links by (from_id, to_id): the latest texts, at the place of the first insertion."""
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    key = ["from_id", "to_id"]
    latest = Window.partitionBy(*key).orderBy(F.desc("__at"), F.desc("link_seq"))
    first = Window.partitionBy(*key).orderBy("__at", "link_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = both.withColumns({"__r": F.row_number().over(latest), "__first": F.first("link_seq").over(first)}).where("__r = 1")
    return ranked.select(*key, "anchor", "context", F.col("__first").alias("link_seq"))


def changed(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of new that are not in old, or differ from it in any of `columns`; nulls are equal to nulls."""
    before = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    differs = F.col("__there").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(before, keys, "left").where(differs).select(*new.columns)


def retired(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Places of old that were not found again and are not retired yet, as dropped with score 0."""
    gone = old.join(seen.select(*keys).distinct(), keys, "left_anti").where("status != 'dropped' or revisit != 0")
    return gone.select(*old.columns).withColumns({"status": F.lit("dropped"), "revisit": F.lit(0.0)})
