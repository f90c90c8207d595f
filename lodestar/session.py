"""A session with the settings that the library's results rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "lodestar", **settings: str) -> SparkSession:
    """UTC, adaptive execution, ANSI casts; further settings by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
