"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lodeworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_CPUS", "8"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
