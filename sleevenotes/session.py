"""Session settings for stand-alone runs (tests, bench). A cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 32, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session. Shuffle partitions only bound the start: adaptive execution merges small ones."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sleevenotes")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()
