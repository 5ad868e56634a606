"""The stages that turn raw documents into packed training sequences.

Each stage takes and returns documents (all columns), except the last, which returns the packed pieces. Rows of any content go
through: nulls and empty texts are rejected by the quality rules, repeated rows by near-duplicate removal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleevenotes.llm import decontaminate, language_crf, near_copies, packing, quality_rules
from sleevenotes.llm.queries import TOKENIZER, table
from sleevenotes.sources.work import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Share of its letters that a document's language has at least.
LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain limits and the n-gram likelihood ratio."""
    return quality_rules.kept(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one language for most of their letters; what to learn from is chosen as in the query of its own."""
    model = language_crf.fit(docs.filter(language_crf.learned_from(F.col("doc_id"))))
    return language_crf.identified(docs, model, LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: fingerprints of five-word shingles, then similarity 0.8."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces, placed in sequences."""
    return packing.packed_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
