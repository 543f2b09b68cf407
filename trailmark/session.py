"""A session with the settings that the operators are tested under. On a cluster, pass its own master and sizes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "trailmark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
