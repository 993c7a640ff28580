"""Session helpers shared by every package: table loading and a tuned local session."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one Parquet table of a dataset folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def local_session(app: str = "wavemill", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is developed under."""
    return (
        SparkSession.builder.master(os.environ.get("WAVEMILL_MASTER", f"local[{cores}]"))
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WAVEMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
