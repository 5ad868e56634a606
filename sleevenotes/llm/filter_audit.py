"""Filter interaction audit: what each of five filters removes in each of their orders, from a sparse document-term matrix.

One pass over the texts makes local shards: documents of up to SHARD_BYTES of text, SHARD_DOCS documents or SHARD_WORDS distinct words, with the
counts of their words. A shard's words are numbered by bucket of their checksum, and leave as one row per bucket. All shards' words of a bucket meet in one group,
which numbers them; with the sizes of the buckets before it this is a dictionary 0, 1, ... over the whole corpus. The numbers return to their shards as one row per
bucket and turn local numbers into columns of the global matrix: CSR in shards, per document the columns that are not zero, and their
counts. Row sums (words) decide filter A, numbers of nonzero entries (distinct words) decide B; the flags of C and D were attached in the first pass, E comes from the
smallest id of each digest of a text. What is left are at most 32 combinations of failures per part; all orders are sums over these.

Buckets are chosen from the bytes of all texts (BUCKET_BYTES each), so that a group stays small; a frequent word is one entry per shard in its group.

Filters: A fewer than 200 words; B distinct words under half of the words; C capitals A-Z over 2 % of the code points; D any of ``#$%&*|``;
E the text of a smaller doc_id, whether that one is removed or not. Words are what is between ASCII white space.

Defined cases: a null text is an empty one, which fails A alone (and E behind another empty one). A null part is the empty string. Repeated rows are documents of their own
and, as their ids are equal, not copies of each other; a row without id fails E never, nor makes others fail. An id is good or toxic if any
of its labels says so; label rows without id are ignored. Texts of any length are split whole. An empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleevenotes.sources.work import shared_folder, written

FILTERS = "ABCDE"
MIN_WORDS = 200
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
CONTINUED = bytes(range(0x80, 0xC0))
SHARD_BYTES = 64 << 20
SHARD_DOCS = 1 << 16
SHARD_WORDS = 1 << 19
#: Bytes of text for each bucket of words; numbers of buckets are powers of two between these.
BUCKET_BYTES = 64 << 20
FEWEST_BUCKETS, MOST_BUCKETS = 16, 1 << 16


# -- local shards ----------------------------------------------------------------------------------------------------


class Shard:
    """Documents with the counts of their words, the words numbered by first use."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.words: dict[bytes, int] = {}
        self.keys: list[pa.RecordBatch] = []
        self.failures, self.digests, self.sizes = array("i"), [], [0]
        self.terms, self.counts = array("i"), array("i")

    def add(self, text: bytes) -> None:
        counted, words = Counter(text.split()), self.words
        self.terms.extend([words.setdefault(w, len(words)) for w in counted])
        self.counts.extend(counted.values())
        self.sizes.append(len(counted))
        points = len(text.translate(None, CONTINUED))
        capitals = len(text) - len(text.translate(None, CAPITALS))
        marked = len(text.translate(None, MARKS)) < len(text)
        self.failures.append(4 * (100 * capitals > 2 * points) + 8 * marked)
        self.digests.append(hashlib.sha256(text).digest())
        self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.digests) >= SHARD_DOCS or len(self.words) >= SHARD_WORDS

    def batches(self, schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
        """The words of each bucket, then the documents, their words now numbered by bucket."""
        bucket = np.fromiter(map(crc32, self.words), np.int64, len(self.words)) % buckets
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        words = pa.array(list(self.words), pa.binary()).take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), words)
        n = len(used)
        yield of_schema({"shard": pa.array(np.full(n, self.number)), "bucket": pa.array(used.astype(np.int32)), "words": lists}, n, schema)

        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        terms, counts = number[np.array(self.terms, np.int32)], np.array(self.counts, np.int32)
        ends = np.cumsum(self.sizes)
        keys, n = pa.Table.from_batches(self.keys), len(self.digests)
        documents = {
            "shard": pa.array(np.full(n, self.number)),
            "doc_id": keys.column("doc_id").combine_chunks(),
            "part": keys.column("part").combine_chunks(),
            "failures": pa.array(self.failures, pa.int32()),
            "digest": pa.array(self.digests, pa.binary()),
            "terms": pa.array([terms[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
        }
        yield of_schema(documents, n, schema)


def of_schema(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def local_shards(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of documents (doc_id, part, failures, digest, terms, counts) and of words (bucket, words), both with their shard."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard = schema = None
        for batch in batches:
            if schema is None:
                types = {"shard": pa.int64(), "doc_id": batch.schema.field("doc_id").type, "part": pa.string(), "failures": pa.int32(),
                         "digest": pa.binary(), "terms": pa.binary(), "counts": pa.binary(), "bucket": pa.int32(),
                         "words": pa.list_(pa.binary())}
                schema, shard = pa.schema(list(types.items())), Shard(first)
            keys, begin = batch.select(["doc_id", "part"]), 0
            for k, text in enumerate(batch.column("text")):
                shard.add(text.as_buffer().to_pybytes())
                if shard.full():
                    shard.keys.append(keys.slice(begin, k + 1 - begin))
                    yield from shard.batches(schema, buckets)
                    shard, begin = Shard(shard.number + 1), k + 1
            if begin < batch.num_rows:
                shard.keys.append(keys.slice(begin))
        if shard is not None and shard.digests:
            yield from shard.batches(schema, buckets)

    plain = docs.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(
        build,
        f"shard long, doc_id {id_type}, part string, failures int, digest binary, terms binary, counts binary, bucket int, words array<binary>",
    )


def buckets_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))


# -- dictionary and matrix -------------------------------------------------------------------------------------------


def numbered_words(words: DataFrame) -> DataFrame:
    """Per bucket a row with its distinct words, and per shard a row with the numbers of its words among these."""

    def number(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("in_shard")
        lists = table.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
        numbers = pa.ListArray.from_arrays(pa.array(offsets), coded.indices)
        own = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        n = table.num_rows
        return pa.table(
            {
                "bucket": pa.array(np.full(n + 1, key[0].as_py(), np.int32)),
                "in_shard": pa.concat_arrays([table.column("in_shard").combine_chunks(), pa.nulls(1, pa.int64())]),
                "numbers": pa.concat_arrays([numbers, pa.nulls(1, numbers.type)]),
                "words": pa.concat_arrays([pa.nulls(n, own.type), own]),
            }
        )

    return words.groupBy("bucket").applyInArrow(number, "bucket int, in_shard long, numbers array<int>, words array<binary>")


def matrix(docs: DataFrame, folder: str | None = None, entries: bool = True) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of doc_id, part and text in CSR shards, a row for each document, and its dictionary (column, word).

    ``n_words`` is a row's sum, ``n_distinct`` the number of its nonzero entries; with ``entries`` also ``columns`` and ``counts``.
    """
    folder = folder or shared_folder(docs.sparkSession)
    local = written(local_shards(docs, buckets_for(docs)), folder)
    words = local.filter("bucket is not null").select(F.col("shard").alias("in_shard"), "bucket", "words")
    numbered = written(numbered_words(words), folder)
    own = numbered.filter("in_shard is null")
    sizes = own.select("bucket", F.size("words").alias("n")).orderBy("bucket").collect()  # a row for each bucket
    start = dict(zip((r.bucket for r in sizes), accumulate((r.n for r in sizes), initial=0)))
    documents = local.filter("bucket is null").drop("bucket", "words")

    def globally(rows: pa.Table, numbers: pa.Table) -> pa.Table:
        numbers = numbers.sort_by("bucket")
        lists = numbers.column("numbers").combine_chunks()
        starts = np.array([start[b] for b in numbers.column("bucket").to_pylist()], np.int64)
        column_of = np.repeat(starts, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
        terms = np.frombuffer(b"".join(rows.column("terms").to_pylist()), np.int32)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32)
        columns = column_of[terms]
        ends = np.cumsum([len(t) // 4 for t in rows.column("terms").to_pylist()])
        begins, sums = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        out = rows.drop_columns(["terms", "counts"])
        out = out.append_column("n_words", pa.array(sums[ends] - sums[begins])).append_column("n_distinct", pa.array(ends - begins))
        if entries:
            offsets = pa.array(np.append(begins, len(columns)).astype(np.int32))
            out = out.append_column("columns", pa.ListArray.from_arrays(offsets, pa.array(columns)))
            out = out.append_column("counts", pa.ListArray.from_arrays(offsets, pa.array(counts)))
        return out

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name not in ("terms", "counts"))
    more = ", columns array<long>, counts array<int>" if entries else ""
    to_shards = numbered.filter("in_shard is not null").select("in_shard", "bucket", "numbers")
    rows = documents.groupBy("shard").cogroup(to_shards.groupBy("in_shard")).applyInArrow(
        globally, f"{kept}, n_words long, n_distinct long{more}"
    )
    starts = docs.sparkSession.createDataFrame(list(start.items()), "bucket int, start long")
    each = own.select("bucket", F.posexplode("words").alias("at", "word")).join(starts, "bucket")
    return rows, each.select((F.col("start") + F.col("at")).alias("column"), F.col("word").cast("string").alias("word"))


# -- failures and orders ---------------------------------------------------------------------------------------------


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and set of failed filters (a bit for each of ABCDE): numbers of documents, good ones and toxic ones."""
    folder = shared_folder(docs.sparkSession)
    rows, _ = matrix(docs, folder, entries=False)
    few = F.when(F.col("n_words") < MIN_WORDS, 1).otherwise(0)
    repetitive = F.when(100 * F.col("n_distinct") < 50 * F.col("n_words"), 2).otherwise(0)
    # equal rows first, so that neither an id nor a text is hot in what follows
    equal = rows.groupBy("doc_id", "part", "digest", (few + repetitive + F.col("failures")).alias("failed")).agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marked = equal.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    same = written(
        marked.groupBy("digest", "part", "failed", "good", "toxic").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
            F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        ),
        folder,
    )
    firsts = same.groupBy("digest").agg(F.min("first").alias("earliest"))
    originals = F.col("without_id") + F.when(F.col("first") == F.col("earliest"), F.col("n_first")).otherwise(0)
    both = F.array(
        F.struct(F.col("failed"), originals.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - originals).alias("n"))
    )
    found = same.join(firsts, "digest").select("part", "good", "toxic", F.inline(both))
    share = {kind: F.sum(F.when(F.col(kind), F.col("n")).otherwise(0)).alias(kind) for kind in ("good", "toxic")}
    return found.groupBy("part", "failed").agg(F.sum("n").alias("n"), share["good"], share["toxic"])


#: Every order with its steps: the order, the step from 1, the filters before it as bits, and its own filter's bit.
STEPS = [
    (order, k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k]))
    for order in map("".join, permutations(FILTERS))
    for k in range(len(FILTERS))
]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def step_counts(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every step of STEPS, from numbers of documents by failed filters."""
    failed = np.arange(len(n))
    before, own = (np.array(s)[:, None] for s in list(zip(*STEPS))[2:])
    removed = (((failed & before) == 0) & ((failed & own) != 0)).astype(np.int64)
    out = {
        "kept": ((failed & (before | own)) == 0).astype(np.int64) @ n,
        "removed": removed @ n,
        "redundant": (((failed & before) != 0) & ((failed & own) != 0)).astype(np.int64) @ n,
        "unique_fails": (failed == own).astype(np.int64) @ n,
        "good_lost": removed @ good,
        "toxic_lost": removed @ toxic,
    }
    of_filter = own.ravel()
    out["shapley"] = np.array([out["removed"][of_filter == f].sum() for f in of_filter])
    return out


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step of that order: COUNTS. ``docs`` has doc_id, part and text, ``labels`` doc_id, quality and toxic."""

    def all_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part"), batch.column("found").to_pylist(), strict=True):
                vectors = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for f in found:
                    vectors[:, f["failed"]] = f["n"], f["good"], f["toxic"]
                counts = step_counts(*vectors)
                columns = [pa.array([part.as_py()] * len(STEPS)), pa.array([s[0] for s in STEPS]), pa.array([s[1] for s in STEPS], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(counts[c]) for c in COUNTS], names=["part", "filter_order", "step", *COUNTS]
                )

    # at most 32 entries for each part
    parts = failures(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("found"))
    return parts.mapInArrow(all_orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
