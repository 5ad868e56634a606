"""Token ids of all documents in binary files, in ascending order of the document ids, and reading them back.

A file holds whole documents. Its ids are replaced by their rank in the file's own table of ids by falling frequency, and a
rank takes one to four bytes: control bytes, four lengths of two bits each, are kept apart from the data bytes. So a reader
finds all places by table lookups on the control bytes, without a loop over ids. A file is written by one task from its own
rows alone and put in place by one rename: a repeated task writes the same file again.

Layout (little endian): 8 bytes mark; int64 n_docs, n_tokens, n_ranks, n_control, n_data; int64 doc ids; uint8 null flags of the
ids; uint32 tokens per document; uint32 ids by rank; control bytes; data bytes.

Defined cases: a null or empty text is the end id only; null ids come first; rows with equal ids follow in the order of their
texts; an empty table writes no file and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sleevenotes.llm.tokens import gathered, token_ids
from sleevenotes.sources.work import shared_folder, written

MARK = b"RANKTOK1"
TOKENS_PER_FILE = 8_000_000
TEXT_PER_PARTITION = 32 << 20
#: Lengths of the four ranks of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)
#: Ids coded in one step; divisible by four.
AT_ONCE = 1 << 20


# -- the code ------------------------------------------------------------------------------------------------------


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of the ranks (uint32); four ranks share a control byte."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) <= extra[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks, by table lookups on the control bytes."""
    out, at = np.empty(n, np.uint32), 0
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    for a in range(0, n, AT_ONCE):
        b = min(n, a + AT_ONCE)
        lengths = LENGTHS[control[a // 4 : -(-b // 4)]].ravel()[: b - a]
        starts = at + np.cumsum(lengths) - lengths
        value = data[starts].astype(np.uint32)
        for k in (1, 2, 3):
            more = np.flatnonzero(lengths > k)
            value[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[a:b] = value
        at = int(starts[-1] + lengths[-1])
    return out


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    runs = range(0, len(ids), AT_ONCE)
    times = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    for a in runs:
        times += np.bincount(ids[a : a + AT_ONCE], minlength=len(times))
    present = np.flatnonzero(times)
    by_rank = present[np.lexsort((present, -times[present]))]
    rank = np.zeros(len(times), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    coded = [encode_ranks(rank[ids[a : a + AT_ONCE]]) for a in runs]
    control, data = (np.concatenate([np.zeros(0, np.uint8), *p]) for p in zip(*coded, strict=True)) if coded else 2 * (np.zeros(0, np.uint8),)
    head = np.array([len(doc_ids), len(ids), len(by_rank), len(control), len(data)], "<i8")
    keys = np.array([k or 0 for k in doc_ids], "<i8")
    nulls = np.array([k is None for k in doc_ids], np.uint8)
    parts = (head, keys, nulls, counts.astype("<u4"), by_rank.astype("<u4"), control, data)
    return MARK + b"".join(p.tobytes() for p in parts)


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens per document, and all ids."""
    if content[:8] != MARK:
        raise ValueError("not a file of ranked ids")
    docs, tokens, ranks, n_control, n_data = np.frombuffer(content, "<i8", 5, 8).tolist()
    at = 48
    parts = []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", ranks), ("u1", n_control), ("u1", n_data)):
        parts.append(np.frombuffer(content, kind, n, at))
        at += parts[-1].nbytes
    keys, nulls, counts, by_rank, control, data = parts
    ids = by_rank[decode_ranks(control, data, tokens)] if tokens else np.zeros(0, np.uint32)
    return [None if null else k for k, null in zip(keys.tolist(), nulls.tolist(), strict=True)], counts.astype(np.int64), ids


# -- writing -------------------------------------------------------------------------------------------------------


def _put(folder: str, name: str, content: bytes) -> None:
    """A whole file or none: written under a name of this attempt, then renamed."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as out:
        out.write(content)
    store.move(attempt, f"{path}/{name}")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, tokens_per_file: int = TOKENS_PER_FILE
) -> DataFrame:
    """Write the files; returns their list (file, n_docs, n_tokens), in whose order of names the documents ascend."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranged = rows.repartitionByRange(int(size // TEXT_PER_PARTITION) + 1, "doc_id").sortWithinPartitions("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file_no = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal file_no
            name = f"part-{part:08d}-{file_no:06d}.ids"
            n, c, i = len(keys), np.concatenate(counts), np.concatenate(ids)
            _put(folder, name, file_bytes(keys, c, i))
            file_no += 1
            keys.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [n], "n_tokens": [len(i)]})

        for batch in batches:
            more, c = token_ids(tokenizer_path, batch.column("text"), end_id)
            names, ends = batch.column("doc_id").to_pylist(), np.cumsum(c)
            a = 0
            while a < len(c):  # whole documents only
                room = tokens_per_file - sum(map(len, ids))
                base = ends[a - 1] if a else 0
                b = max(a + (not ids), int(np.searchsorted(ends, base + room, side="right")))
                if b > a:
                    keys += names[a:b]
                    counts.append(c[a:b])
                    ids.append(more[base : ends[b - 1]])
                if b < len(c):
                    yield flush()
                a = b
        if keys:
            yield flush()

    return written(ranged.mapInArrow(save, "file string, n_docs long, n_tokens long"), folder)


# -- reading -------------------------------------------------------------------------------------------------------


def read_token_files(spark: SparkSession, folder: str, key_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """Documents of the files: file, at (ids before it in its file), doc_id, n_tokens, ids_crc32, and the ids if asked for."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                keys, counts, ids = read_file(content.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                columns = {
                    "file": pa.array([path.rpartition("/")[2]] * len(keys)),
                    "at": pa.array(ends - counts),
                    "doc_id": pa.array(keys, pa.int64()),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array(
                        [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.int64()
                    ),
                }
                if with_ids:
                    bounds = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    schema = "file string, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.mapInArrow(load, schema).withColumn("doc_id", F.col("doc_id").cast(key_type))


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the files, read them, and give each document its start in the whole: doc_id, start, n_tokens, ids_crc32[, ids]."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens"
    files = write_token_files(docs, folder, tokenizer_path)
    if files.isEmpty():
        schema = T.StructType([docs.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1)
        return spark.createDataFrame([], schema + ", start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # one row per file: a running sum over the partitions' own files, then over the partitions
    part = F.substring("file", 1, len("part-00000000"))
    own = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_file = files.withColumn("part", part).withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    by_part = by_file.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = by_file.join(by_part, "part").select("file", (F.col("base") + F.col("own")).alias("base"))
    read = read_token_files(spark, folder, docs.schema["doc_id"].dataType, with_ids)
    out = read.join(starts, "file").withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
