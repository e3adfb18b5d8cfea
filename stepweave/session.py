"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stepweave", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override. Shuffle partitions and memory are the cluster's."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
