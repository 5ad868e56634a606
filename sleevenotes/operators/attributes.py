"""Filters and sorts that find ids first: an inverted index of attributes, and a narrow table of sort keys.

No document is built to find out which documents are wanted; those that are go through ``plans.entity.documents_of``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .artist import Catalog, group_release_date


def attribute_rows(entity: object, cat: Catalog) -> DataFrame:
    """``(field, value, gid)``: every value of every filterable field of every document; a list has a row per distinct member.

    Read from the entity's base and the flat tables of its lists, so a document with very many members is many rows.
    """
    base, lists = entity.base(cat), entity.tables(cat)
    scalars = [f for f in entity.filterable if f in base.columns]
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in scalars))
    parts = [base.select(F.inline(entries), F.col("id").alias("gid"))]
    ids = base.select("row_id", F.col("id").alias("gid"))
    members = {f: lists[f].select(F.lit(f).alias("field"), "value", "row_id") for f in entity.filterable if f not in scalars}
    # lists without repeats, the longest ones, do not go through the hash maps and the shuffle that make the others distinct
    kinds = [[rows for f, rows in members.items() if (f in entity.unrepeated) == known] for known in (False, True)]
    rows = [reduce(DataFrame.unionByName, k) for k in kinds if k]
    if rows:
        rows[0] = rows[0].distinct() if kinds[0] else rows[0]
        parts.append(reduce(DataFrame.unionByName, rows).join(ids, "row_id").select("field", "value", "gid"))
    return reduce(DataFrame.unionByName, parts).filter("value is not null")


def sort_rows(entity: object, cat: Catalog) -> DataFrame:
    """``(gid, rating, releasedate)``: the fields that documents are sorted by; artists have no date."""
    head = entity.tables(cat)["head"]
    rating = S.rating(F.col("meta.rating_count"), F.col("meta.rating"))["Value"]
    date = group_release_date("meta") if entity.name == "release_group" else F.lit(None).cast("string")
    return head.select(F.col("id").alias("gid"), rating.alias("rating"), date.alias("releasedate"))


def write_attributes(entity: object, cat: Catalog, path: str) -> None:
    """Store both, the index by field, value and id: a condition reads the row groups of its value, and a frequent value spans files."""
    rows = attribute_rows(entity, cat).repartitionByRange("field", "value", "gid").sortWithinPartitions("field", "value", "gid")
    rows.write.mode("overwrite").parquet(f"{path}/attributes")
    sort_rows(entity, cat).write.mode("overwrite").parquet(f"{path}/sorts")


def read_attributes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/attributes"), spark.read.parquet(f"{path}/sorts")


def ids_where(attributes: DataFrame, filterable: tuple[str, ...], **conditions: str) -> DataFrame:
    """``(gid)`` of the documents that meet all conditions. The conditions reach the scan; their ids meet in one shuffle."""
    for name in conditions:
        if name not in filterable:
            raise ValueError(f"{name} is not filterable; use one of {filterable}")
    if not conditions:
        return attributes.select("gid").distinct()
    meets = reduce(Column.__or__, ((F.col("field") == f) & (F.col("value") == v) for f, v in conditions.items()))
    found = attributes.filter(meets).groupBy("gid").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") == len(conditions)).select("gid")


def first_ids(sorts: DataFrame, fields: tuple[str, ...], size: int, ids: DataFrame | None = None) -> DataFrame:
    """``(gid, ...)`` of the first ``size`` documents by the fields, greatest first, absent last, ties by id; of ``ids`` if given."""
    rows = sorts if ids is None else sorts.join(ids, "gid", "left_semi")
    return rows.orderBy(*[F.col(f).desc_nulls_last() for f in fields], "gid").limit(size)
