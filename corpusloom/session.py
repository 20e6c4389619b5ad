"""A session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; anything else through ``conf`` (dots as double underscores)."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
