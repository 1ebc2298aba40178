"""A session with the settings that the engine counts on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "siftwell", **conf: str) -> SparkSession:
    """The active session, or a local one: adaptive plans, UTC, no speculation (actions must not run twice at once)."""
    builder = SparkSession.builder.appName(name)
    if SparkSession.getActiveSession() is None and "SPARK_MASTER" not in os.environ:
        builder = builder.master("local[*]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.speculation": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
