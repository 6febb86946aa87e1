"""Session defaults for local runs and tests; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int = 8, shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, a small number of shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
