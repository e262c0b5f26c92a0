"""Session defaults for running the library outside a managed cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tesseral", cpus: int | str | None = None) -> SparkSession:
    """A local session; on a cluster the submitted configuration wins over these defaults."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERAL_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
