"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a popular key's partition even where that costs a later shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(name: str = "marquee") -> SparkSession.Builder:
    """Builder with the settings above; master, memory and folders are the caller's."""
    made = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def local(cores: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for one machine: tests and the benchmark."""
    return (
        builder()
        .master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
