"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tally", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Shuffle partitions follow the cores locally; on a cluster AQE coalesces them."""
    cores = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": cores,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.appName(app).master(master or f"local[{cores}]").config(map=settings).getOrCreate()
