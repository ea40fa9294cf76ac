"""Session factory with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(name: str = "corvane", cores: int | str = "*", shuffle_partitions: int = 8, memory: str | None = None) -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster, build the session there instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", memory or os.environ.get("CORVANE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
