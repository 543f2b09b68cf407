"""The registered queries of this folder, with the parameters used in production, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compact_windows, decontaminate, license_index, lm_trie, mix_pivotal, oracle, quality_net, rules_forest, shard_histogram, simhash_gray, suffix_dedup
from .space import table


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.crc32("text").alias("text_crc32"), "text")
    out = shard_histogram.shard(keyed, carry=["doc_id", "text_crc32"])
    return out.select(
        "doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_pivotal.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules_forest.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules_forest.COUNTS, "base_failed", "kept")


def op4_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.scored(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op6_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_histogram_shards": op1_histogram_shards,
        "op2_pivotal_mix": op2_pivotal_mix,
        "op3_forest_rules": op3_forest_rules,
        "op4_lm_trie": op4_lm_trie,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_latent_leaks": op6_latent_leaks,
        "op7_compact_windows": op7_compact_windows,
        "op8_quality_net": op8_quality_net,
        "op9_simhash_gray": op9_simhash_gray,
        "op10_license_index": op10_license_index,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
