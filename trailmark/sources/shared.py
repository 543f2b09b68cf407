"""Results that later steps read more than once, kept in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settled(df: DataFrame) -> DataFrame:
    """df, written and read back: computed once, with known size and a short plan."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/trailmark/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file_system(spark, path).deleteOnExit(hadoop_path(spark, path))  # when the session ends
    return spark.read.schema(df.schema).parquet(path)
