"""Quality rules: plain limits on each text, and a log-likelihood ratio of its n-grams between trusted and all documents.

The n-grams are all whole words and all pairs of neighbouring words (joined by a space), hashed into BUCKETS buckets by CRC-32 of their UTF-8
bytes. Two multinomials are counted: over all documents, and over the trusted ones. A document's score is the mean,
over its n-grams, of log(p_trusted / p_all), where PSEUDO more n-grams of the average kind are added to each bucket. Documents
under THRESHOLD are rejected, at every size of the corpus by the same number. With PSEUDO 1, an n-gram that
occurs once, in a document that is not trusted, weighs log(1/2); one that no trusted document holds falls further with each occurrence.

All of it is column expressions within the row: one pass counts, one pass scores, and only bucket counts are shuffled. All trusted
documents count; their ids meet the documents in one join, which sends up to IDS_IN_MEMORY ids to all machines and shuffles more of
them. The counts (BUCKETS rows at most, a parameter) are the only thing that reaches the driver.

Defined cases: a null or empty text has no words, all counts 0, score 0, base_failed and not kept. Without trusted documents, or without
documents, all scores are 0. Repeated rows are judged each. Null ids are judged, but never trusted. All other columns are returned
untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleevenotes.llm.text import SPACES, drawn, parts, positions
from sleevenotes.sources.work import written

BUCKETS = 1 << 17
PSEUDO = 1.0
THRESHOLD = -0.4
MIN_WORDS = 50
#: Trusted ids up to this number are sent to all machines (tens of MB); more meet the documents in a shuffle.
IDS_IN_MEMORY = 1 << 21


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Ids of documents labelled as good: all of them, or if asked for about ``most`` (and never twice as many)."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good if most is None else good.filter(drawn(F.col("doc_id"), most, good.count())).limit(2 * most)


def _grams(words: Column) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""

    def bucket(gram: Column) -> Column:
        return (F.crc32(gram) % BUCKETS).cast("int")

    pairs = F.transform(positions(F.size(words) - 1), lambda i: bucket(F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))
    return F.concat(F.transform(words, bucket), pairs)


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(doc_id, text, trusted)``: 1 for trusted documents, else null."""
    ids = trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).filter("doc_id is not null").distinct()
    ids = written(ids).withColumn("trusted", F.lit(1))
    # texts are moved for this join only where the ids are too many for the memory of every task
    ids = F.broadcast(ids) if ids.count() <= IDS_IN_MEMORY else ids
    return docs.select("doc_id", "text").join(ids, "doc_id", "left")


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(p_trusted / p_all) of each bucket."""
    split = marked(docs, trusted).select("trusted", parts(F.col("text"), SPACES).alias("words"))
    counted = (
        split.select("trusted", F.explode(_grams(F.col("words"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count("trusted").alias("t"))
        .collect()
    )
    n, t = sum(r.n for r in counted), sum(r.t for r in counted)
    weights = [0.0] * BUCKETS
    if t:
        share = t / n
        for r in counted:
            weights[r.bucket] = math.log((r.t + PSEUDO * share) / (r.n + PSEUDO) / share)
    return weights


def _score(words: Column, weights: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one constant
    # transform over an array of one names the buckets, so that they are made once
    return F.transform(
        F.array(_grams(words)),
        lambda grams: F.when(
            F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), lambda sum_, g: sum_ + F.get(table, g)) / F.size(grams)
        ).otherwise(F.lit(0.0)),
    )[0]


def _repeat_words(shingles: Column) -> Column:
    """Words within a shingle of three that occurs twice or more: equal shingles are neighbours once sorted."""
    s = F.sort_array(F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        again = F.filter(
            s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h)
        )
        words = F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2))
        return F.size(F.array_distinct(F.flatten(words)))

    # transform over an array of one names the sorted array, so that it is made once
    return F.transform(F.array(s), found)[0]


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one more column ``quality``: a struct of the counts, base_failed, score and kept."""
    weights = bucket_weights(docs, trusted)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.withColumn("_words", parts(F.col("text"), SPACES))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    shingled = words.withColumns(
        {
            "_lines": lines,
            "_shingles": F.transform(
                positions(F.size("_words") - 2),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
            "_score": _score(F.col("_words"), weights),
        }
    )
    distinct = F.size(F.array_distinct("_shingles"))
    counted = shingled.withColumn(
        "quality",
        F.struct(
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(distinct == F.size("_shingles"), 0).otherwise(_repeat_words(F.col("_shingles"))).cast("long").alias("n_repeat_words"),
            F.col("_score").alias("score"),
        ),
    ).drop("_words", "_lines", "_shingles", "_score")
    q = F.col("quality")
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > 50 * q.n_words)
    return counted.withColumn(
        "quality",
        F.struct(*(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                 failed.alias("base_failed"), q.score.alias("score"), (~failed & (q.score >= threshold)).alias("kept")),
    )


def kept(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    inner = plain.withColumns({"doc_id": F.col(f"c{names.index('doc_id')}"), "text": F.col(f"c{names.index('text')}")})
    # exploding an array of one keeps the planner from copying the whole judgement into the filter
    out = judged(inner, trusted).withColumn("quality", F.explode(F.array("quality"))).filter("quality.kept")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
