"""Session factory for tests, the benchmark and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "riskloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own SparkSession."""
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
