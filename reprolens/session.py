"""Session settings that the operators rely on: UTC, ANSI casts, adaptive plans."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "reprolens", cpus: int | None = None) -> SparkSession:
    """A local session; on a cluster, pass the same settings to the session that the cluster makes."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("REPROLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
