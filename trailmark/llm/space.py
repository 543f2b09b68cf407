"""Where intermediate tables live: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    """A path as Hadoop's, and its file system."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, with its file system. Only where the session names none (tests on one machine) is a local one chosen."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.sparkContext.setCheckpointDir(found)
    path, system = _path(spark, found)
    whole = system.makeQualified(path).toString().rstrip("/")
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder, which goes when the session ends."""
    folder = f"{shared_dir(spark)}/trailmark/{name}-{uuid.uuid4().hex}"
    path, system = _path(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors, has exact sizes."""
    folder = work_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
