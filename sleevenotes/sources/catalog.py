"""Read and import the catalogue tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CATALOG, DEFAULT_TABLE_SCHEMA, TABLE_SCHEMA

#: Tables that are read in id pages are stored in id order, so a page touches few row groups.
PAGED = ("artist", "release_group")
IMPORTS_AT_ONCE = 8


def keeps(name: str, keep_only: Collection[str]) -> bool:
    """Whether an allowlist keeps a name; an empty list keeps all."""
    return not keep_only or name in keep_only


def kept_tables(keep_tables: Collection[str] = (), keep_schemas: Collection[str] = ()) -> list[str]:
    return [
        t
        for t in CATALOG
        if keeps(t, keep_tables) and keeps(TABLE_SCHEMA.get(t, DEFAULT_TABLE_SCHEMA), keep_schemas)
    ]


def load_catalog(
    spark: SparkSession, path: str, keep_tables: Collection[str] = (), keep_schemas: Collection[str] = ()
) -> dict[str, DataFrame]:
    """One Parquet table per kept name, below ``path``. Only kept tables are touched."""
    return {t: spark.read.schema(CATALOG[t]).parquet(f"{path}/{t}") for t in kept_tables(keep_tables, keep_schemas)}


def is_imported(spark: SparkSession, path: str) -> bool:
    """Whether a table's write has finished: the committer leaves its marker last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def import_catalog(
    tables: Mapping[str, DataFrame], path: str, keep_tables: Collection[str] = (), keep_schemas: Collection[str] = ()
) -> None:
    """First import: write each kept table that is not there yet; what exists is left alone. A table whose write has not
    finished is not there.

    The tables are independent jobs, several of which run at a time so that small ones do not wait for large ones.
    """

    def write(name: str) -> None:
        rows = tables[name]
        if is_imported(rows.sparkSession, f"{path}/{name}"):
            return
        if name in PAGED:
            rows = rows.repartitionByRange("gid").sortWithinPartitions("gid")
        rows.write.mode("overwrite").parquet(f"{path}/{name}")

    wanted = [t for t in kept_tables(keep_tables, keep_schemas) if t in tables]
    with ThreadPoolExecutor(max_workers=IMPORTS_AT_ONCE) as pool:
        list(pool.map(write, wanted))


def is_empty(df: DataFrame) -> bool:
    """Probe for any row; reads no more than one."""
    return df.isEmpty()
