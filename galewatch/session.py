"""Session construction with the null, timestamp and adaptive-execution policy of the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "galewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local use; on a cluster the submitted settings win over these defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
