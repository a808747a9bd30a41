"""Session defaults used by the tests, the bench and the command line."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the test and bench code share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chunkvault")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHUNKVAULT_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", os.environ.get("CHUNKVAULT_SHARED_DIR") or tempfile.mkdtemp(prefix="chunkvault-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One fixture table; only the columns that a query selects are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
