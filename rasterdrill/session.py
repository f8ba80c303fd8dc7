"""A Spark session with the settings the drills are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from rasterdrill.tuning import SESSION_CONF


def local_session(cpus: int | str | None = None) -> SparkSession:
    """A local session for tests and measurement."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rasterdrill")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
