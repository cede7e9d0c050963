"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes and splits shuffle partitions at run time; ANSI stays on, the operators use try_* functions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # recording a Python call site for every column expression costs more than building the plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus: str = "8", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and measurements."""
    spark = (
        configure(SparkSession.builder.appName("yieldengine").master(f"local[{cpus}]"))
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
