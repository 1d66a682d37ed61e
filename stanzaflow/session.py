"""A session with the settings that the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stanzaflow", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew joins, ANSI; other settings by keyword with dots as double underscores."""
    made = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        made = made.config(k.replace("__", "."), v)
    return made.getOrCreate()
