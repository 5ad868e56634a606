"""The registered queries of this package and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleevenotes.llm import chat_repair, cotraining, decontaminate, filter_audit, language_crf, licences, packing, pii, quality_rules, simhash, token_files, url_rules, whitening
from sleevenotes.llm.decontaminate_sql import DECONTAMINATE_SQL
from sleevenotes.llm.filter_audit_sql import FILTER_AUDIT_SQL
from sleevenotes.llm.licence_sql import LICENCE_SQL
from sleevenotes.llm.quality_sql import QUALITY_SQL
from sleevenotes.llm.url_sql import url_sql

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scanned(table(spark, sf_dir, "documents"))
    return found.withColumn("licences", F.array_join("licences", ","))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.judged(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(f"quality.{c}" for c in columns))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    component = F.when(F.col("label") < simhash.NO_ID, F.col("label"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), component.alias("component_id"))


def op8_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.scored(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repaired(table(spark, sf_dir, "conversations"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_crf.learned_from(F.col("doc_id"))
    model = language_crf.fit(docs.filter(learned))
    found = language_crf.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(~learned, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Rules of the registered query: what to do, and the host and path it is for.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, URL_RULES), default="allow")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("part"), "text")
    return filter_audit.audited(docs, table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.documents_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s.added)
    kinds = F.transform(base, lambda s: s.kind)
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_licence_scans,
        op3_decontamination,
        op4_quality_rules,
        op5_token_files,
        op6_simhash_near_dedup,
        op7_url_rules,
        op8_quality_cotraining,
        op9_chat_repair,
        op10_language_crf,
        op11_filter_audit,
        op12_embedding_whitening,
        op13_pii,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_licence_scans": LICENCE_SQL,
    "op3_decontamination": DECONTAMINATE_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op11_filter_audit": FILTER_AUDIT_SQL,
    "op7_url_rules": url_sql(URL_RULES, "allow"),
}
