"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("locusweave")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def worker_path(spark: SparkSession | None) -> None:
    """Let Python workers of a local run import this package; a cluster gets it by --py-files."""
    if spark is not None:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
