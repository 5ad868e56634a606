"""Benchmark passages in documents: an exact, prefix-filtered containment join over windows of item words.

A window is ``size`` consecutive words of an item; its tokens are the shingles of SHINGLE words in it. A document contains a
window only if it has all of the window's shingles, so it is enough to join on one of them, the necessary prefix; the rarest
in the corpus gives the fewest candidates, and a window with a shingle that no document has gives none. Candidates must
lie within the document (length and positional bounds) and are verified shingle by shingle, which is exact: shingles are
joined by hash and compared as text.

The benchmark's shingles and windows are joined in blocks of BLOCK shingles, each of which is small enough to be broadcast; so
documents are exploded but never shuffled by word. What remains per document are its matching positions, at most as many as
it has words; only these are shuffled, by document.

Defined cases: null and empty texts have no words, no hits and appear in the result; an item without words is ignored, an item of
fewer than ``size`` words is one window; equal items and repeated item rows each count by their id, once per id; items without
an id mark words but are not counted; each repeated document row gets its own equal result; an empty benchmark leaves all
documents clean. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleevenotes.llm.text import NOT_WORD, ascii_lower, parts, positions
from sleevenotes.sources.work import shared_folder, written

WINDOW = 10
SHINGLE = 5
BLOCK = 500_000


def words(text: Column) -> Column:
    return parts(ascii_lower(text), NOT_WORD)


def _hash(array: str, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(F.col(array), at + k) for k in range(n)))


def _text(array: str, at: Column, n: int | Column) -> Column:
    return F.array_join(F.slice(F.col(array), at + 1, n), " ")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: window_id, n_words, n (words in each shingle), shingles (texts in order), items (ids, ascending)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n_windows = F.greatest(F.size("w") - size + 1, F.lit(1))
    cut = items.select("item_id", F.explode(F.transform(positions(n_windows), lambda i: F.slice("w", i + 1, size))).alias("w"))
    n = F.least(F.size("w"), F.lit(SHINGLE))
    distinct = cut.groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return distinct.select(
        F.xxhash64(F.array_join("w", " ")).alias("window_id"),
        F.size("w").alias("n_words"),
        n.alias("n"),
        F.transform(positions(F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i + 1, n), " ")).alias("shingles"),
        "items",
    )


def shingle_matches(docs: DataFrame, windows: DataFrame, folder: str) -> DataFrame:
    """Where documents have shingles of windows: doc_id, key, pos, shingle; and one row per document (pos null) with n_words, copies."""
    shingles = windows.select("n", F.explode("shingles").alias("shingle")).distinct()
    shingles = written(
        shingles.withColumn("w", F.split("shingle", " ")).withColumn(
            "hash",
            F.coalesce(*(F.when(F.col("n") == k, _hash("w", F.lit(0), k)) for k in range(1, SHINGLE + 1))),
        ).select("n", "hash", "shingle"),
        folder,
    )
    lengths = sorted(r.n for r in shingles.select("n").distinct().collect())  # at most SHINGLE values
    blocks = max(1, math.ceil(shingles.count() / BLOCK))
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("key"), words(F.col("t")).alias("w")
    )
    out = []
    for n in lengths:
        # position -1 stands for the document itself; it is joined like a shingle and so kept by every block's first pass
        own = F.concat(F.array(F.lit(-1)), positions(F.size("w") - n + 1)) if not out else positions(F.size("w") - n + 1)
        at = split.select("doc_id", "key", "w", F.explode(own).alias("pos"))
        hashed = at.withColumn("hash", F.when(F.col("pos") >= 0, _hash("w", F.col("pos"), n)).otherwise(F.lit(0).cast("long")))
        for block in range(blocks):
            part = shingles.filter((F.col("n") == n) & (F.pmod("hash", F.lit(blocks)) == block)).select("hash", "shingle")
            if not out:
                part = part.unionByName(docs.sparkSession.sql("select 0L as hash, cast(null as string) as shingle"))
                rows = hashed
            else:
                rows = hashed.filter("pos >= 0")
            same = F.col("shingle").eqNullSafe(F.when(F.col("pos") >= 0, _text("w", F.col("pos"), n)))
            found = rows.join(F.broadcast(part), "hash").filter(same)  # BLOCK shingles at most
            out.append(
                found.select("doc_id", "key", F.when(F.col("pos") >= 0, F.col("pos")).alias("pos"), "shingle",
                             F.when(F.col("pos") < 0, F.size("w")).cast("long").alias("n_words"))
            )
    if not lengths:
        out = [split.select("doc_id", "key", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("shingle"),
                            F.size("w").cast("long").alias("n_words"))]
    all_rows = out[0]
    for df in out[1:]:
        all_rows = all_rows.unionByName(df)
    return written(all_rows, folder)


def prefixes(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """The rarest shingle of each window, by the rows that have it; windows that cannot occur are absent."""
    counts = matches.filter("pos is not null").groupBy("shingle").agg(F.count("*").alias("times"))
    tokens = windows.select("window_id", "n_words", "n", "shingles", "items", F.posexplode("shingles").alias("at", "shingle"))
    ranked = tokens.join(counts, "shingle", "left").groupBy("window_id", "n_words", "shingles", "items").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "at")).alias("rarest")
    )
    return ranked.filter("rarest.times > 0").select(
        F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("at"), "window_id", "n_words", "shingles", "items"
    )


def contained(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, key (hash of its text), n_words, spans (start and length of each window found, ascending), items."""
    folder = shared_folder(docs.sparkSession)
    windows = written(item_windows(benchmark, size), folder)
    matches = shingle_matches(docs, windows, folder)
    prefix = written(prefixes(matches, windows), folder)
    near = Window.partitionBy("doc_id", "key").orderBy("pos").rangeBetween(-size, size)
    placed = matches.filter("pos is not null").select("doc_id", "key", "pos", "shingle").distinct()
    around = placed.withColumn("near", F.collect_list(F.struct("pos", "shingle")).over(near))
    start = F.col("pos") - F.col("at")
    end = start + F.size("shingles")
    bounded = (
        around.join(prefix, "shingle")  # broadcast by the planner only if its written size allows
        .withColumn("start", start)
        .filter(start >= 0)
    )
    here = F.transform(
        F.filter("near", lambda x: (x.pos >= start) & (x.pos < end) & (F.size(F.split(x.shingle, " ")) == F.least(F.col("n_words"), F.lit(SHINGLE)))),
        lambda x: x.shingle,
    )
    verified = bounded.filter(here == F.col("shingles"))
    found = verified.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct("start", "n_words"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    whole = (
        matches.filter("pos is null").groupBy("doc_id", "key", "n_words").agg(F.count("*").alias("copies"))
        .withColumn("copies", F.expr("sequence(1, cast(copies as int))"))
    )
    joined = whole.alias("a").join(
        found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left"
    )
    return joined.select(
        "a.doc_id", "a.key", "n_words", "spans", F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
        F.explode("copies").alias("copy"),
    ).drop("copy")


def hit_words(spans: Column) -> Column:
    """Words inside any span: spans ascend by start, so each adds what reaches beyond the furthest end so far."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    done = F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            (acc.hit + F.greatest(s.start + s.n_words - F.greatest(s.start, acc.end), F.lit(0))).alias("hit"),
            F.greatest(acc.end, s.start + s.n_words).alias("end"),
        ),
    )
    return F.coalesce(done.hit, F.lit(0).cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    id_, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    found = contained(plain.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), benchmark, size)
    bad = found.filter(F.size("spans") > 0).select("doc_id", "key").distinct()
    same = plain[id_].eqNullSafe(bad["doc_id"]) & (F.xxhash64(F.coalesce(plain[text], F.lit(""))) == bad["key"])
    out = plain.join(bad, same, "left_anti")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
