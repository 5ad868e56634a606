"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the cluster says that all machines see it (``spark.checkpoint.dir``).

    Only a local session may do without the setting; it gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        return tempfile.mkdtemp(prefix="sleevenotes-")
    return f"{root.rstrip('/')}/sleevenotes-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame as a table written now: its lineage ends here, and its real size is known to the planner.

    Meant for narrow id sets that restrict many scans. Joins with it are broadcast exactly if the written size is below
    the session's broadcast threshold.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
