"""Session defaults shared by the CLI, the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the operators rely on; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
}


def build_session(master: str | None = None, app: str = "driftmark", **conf: str) -> SparkSession:
    """A session for scripts; on a cluster the existing session is used instead."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, "spark.ui.showConsoleProgress": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A single-machine session, as the tests and the benchmark use it."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    defaults = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
    }
    return build_session(f"local[{cores}]", **{**defaults, **conf})
