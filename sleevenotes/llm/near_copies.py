"""Near copies beyond the reach of fingerprints: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Two texts of that similarity differ in about 10 of the 64 bits of their SimHash, too many for a tree to prune. So fingerprints link what is
almost equal (``simhash.components``, here on shingles of five words), and distinct texts of different components are compared by their sets. Candidates share a band: the
smallest hashes of their shingles under ROWS multipliers, for one of BANDS such groups of multipliers. Texts of similarity s share at
least one with probability 1 - (1 - s^5)^20, that is above 0.99 at 0.8. Every candidate pair is then verified on the whole sets.

No band lists its pairs. In each round one of its documents, another each time, is the centre, and the others are compared with it alone, unless
a link already gave them the centre's label (at first a component's by fingerprint). From the second round on the members of a band also have to agree in further smallest hashes, one more
each round: texts that have little in common part quickly, copies stay together. A band is closed when all of it has one label. A round's work is
one row for each document and band still open, and one comparison for those that no link holds yet.

Defined cases: a text with fewer words than a shingle has its whole sequence as the one shingle, one without words has the empty set and is
near no other; documents without an id count as later than all others; repeated rows and equal texts are copies. An empty table gives
an empty result. All columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleevenotes.llm import simhash
from sleevenotes.sources.work import shared_folder, written

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 20, 5
#: Odd multipliers of 64 bits, always the same ones.
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes (none empty), one key per band from the smallest hashes under the band's multipliers."""
    keys = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        for factor in FACTORS[band]:
            smallest = np.minimum.reduceat(values * factor, bounds[:-1])
            mixed = (keys[:, band] ^ smallest) * np.uint64(0x9E3779B97F4A7C15)
            keys[:, band] = mixed ^ (mixed >> np.uint64(29))
    return keys


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key and hashes (distinct) of each document."""
    text = F.coalesce("text", F.lit(""))
    return simhash.shingle_hashes(F.col("text"), SHINGLE)(docs.select("key", text.alias("text"))).select(
        "key", F.array_distinct("hashes").alias("hashes")
    )


def banded(docs: DataFrame) -> DataFrame:
    """key, n (shingles) and one row per band with its key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            n, bounds = np.diff(bounds), bounds - bounds[0]
            some = n > 0
            keys = band_keys(values, np.append(bounds[:-1][some], bounds[-1]))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(np.repeat(batch.column("key").to_numpy()[some], BANDS)),
                    "n": pa.array(np.repeat(n[some], BANDS)),
                    "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int64), len(keys))),
                    "part": pa.array(keys.ravel().view(np.int64)),
                }
            )

    # a filter on the sets would go below their projection and make them again for each word
    return shingle_sets(docs).mapInArrow(keyed, "key long, n long, band long, part long")


def centred(rows: DataFrame, turn: int) -> DataFrame:
    """The rows of bands with two labels or more, with this round's centre of the band: its key, size and label."""
    order = F.xxhash64("key", "band", F.lit(turn)).alias("order")
    groups = rows.groupBy("band", "part").agg(
        F.min(F.struct(order, "key", "n", "label")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    centres = groups.filter("low < high").select(
        "band", "part", F.col("c.key").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.label").alias("centre_label")
    )
    return rows.join(centres, ["band", "part"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (key, centre, and more), those of enough similarity."""
    one = pairs.join(sets, "key")
    other = sets.select(F.col("key").alias("centre"), F.col("hashes").alias("others"))
    common = F.size(F.array_intersect("hashes", "others"))
    sizes = F.size("hashes") + F.size("others")
    measured = one.join(other, "centre").select(*pairs.columns, common.alias("common"), sizes.alias("sizes"))
    return measured.filter(F.col("common") * (100 + PERCENT) >= F.col("sizes") * PERCENT).select(*pairs.columns)


def further(sets: DataFrame, open_: DataFrame, turn: int) -> DataFrame:
    """key and more: ``turn`` further smallest hashes, of the documents still open."""

    def smallest(seed: int) -> Column:
        return F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, F.lit(seed))))

    mine = sets.join(open_.select("key").distinct(), "key", "left_semi")
    return mine.select("key", F.xxhash64(*(smallest(turn * turn + k) for k in range(turn))).alias("more"))


def links(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (key, centre) of near copies; ``docs``: key (the same for equal texts) and text; ``labels``: key and label of each key once."""
    folder, turn = shared_folder(docs.sparkSession), 0
    rows = banded(docs).dropDuplicates(["key", "band"]).join(labels, "key")
    open_ = written(centred(rows, turn), folder)
    sets = shingle_sets(docs.join(open_.select("key").distinct(), "key", "left_semi")).dropDuplicates(["key"])
    sets = written(sets, folder)
    found = docs.select("key", F.col("key").alias("centre")).limit(0)
    while not open_.isEmpty():
        bounded = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * PERCENT
        pairs = open_.filter(F.col("label") != F.col("centre_label")).filter(bounded)
        low = F.least("label", "centre_label").alias("low")
        linked = written(similar(pairs.groupBy("key", "centre").agg(F.min(low).alias("low")), sets), folder)
        found = found.unionByName(linked.select("key", "centre"))
        lower = linked.select(F.explode(F.array("key", "centre")).alias("key"), "low").groupBy("key").agg(F.min("low").alias("low"))
        labelled = open_.join(lower, "key", "left").select("key", "n", "band", "part", F.coalesce("low", "label").alias("label"))
        turn += 1
        again = labelled.join(further(sets, open_, turn), "key").withColumn("part", F.xxhash64("part", "more")).drop("more")
        open_ = written(centred(written(again, folder), turn), folder)
    return found.distinct()


def components(docs: DataFrame) -> DataFrame:
    """As ``simhash.components``, with the smallest id in each group of near copies as the label; ``docs``: doc_id and text."""
    folder = shared_folder(docs.sparkSession)
    rows = written(simhash.components(docs, shingle=SHINGLE), folder)
    labels = written(rows.groupBy(F.col("text_hash").alias("key")).agg(F.min("label").alias("label")), folder)
    text = F.coalesce("text", F.lit(""))
    pairs = links(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), labels)
    centres = labels.select(F.col("key").alias("centre"), F.col("label").alias("other"))
    joined = written(pairs.join(labels, "key").join(centres, "centre").filter("label != other").select("label", "other").distinct(), folder)
    if joined.isEmpty():
        return rows
    # a pair of components is a group of two for the labels
    members = joined.select(F.struct("label", "other").alias("group"), F.explode(F.array("label", "other")).alias("fingerprint"))
    start = members.select("fingerprint", F.col("fingerprint").alias("label")).distinct()
    lowest = simhash.spread_labels(members, start, folder).select(F.col("fingerprint").alias("label"), F.col("label").alias("lowest"))
    return rows.join(lowest, "label", "left").withColumn("label", F.coalesce("lowest", "label")).drop("lowest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each group of near copies, with its own columns."""
    return simhash.one_of_each(docs, components)
