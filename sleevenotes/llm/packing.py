"""Best-fit packing of pieces into sequences of a fixed number of tokens, improved by local search.

Pieces are dealt by hash into shards of about SHARD pieces. Each shard is packed by itself: best fit in descending order of
length, then a local search over the bins with room left. It exchanges one piece for one, two for one, or moves a piece,
wherever that raises the sum of the squared fills, so that filled bins get fuller and emptied ones vanish. Bins of a shard
that stay open (more than SLACK tokens of room) are dissolved and packed again together with those of the other shards, in
rounds, until all that is left fits into one shard or a round no longer closes half. A shard is the largest group ever held by one task.

Defined cases: a null or empty text is one piece with the end id only; a document of more than ``limit`` tokens is cut
into pieces of ``limit`` of which only the first is shorter; repeated rows are pieces of their own; an empty table gives an empty
result. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleevenotes.llm.tokens import token_ids
from sleevenotes.sources.work import shared_folder, written

SHARD = 4_096
SLACK = 2
#: Bins among which the last part of the search tries all pairs.
TAIL = 24


# -- pieces --------------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = token_ids(tokenizer_path, batch.column("text"), end_id)
            n = -(-counts // limit)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            head = (counts - (n - 1) * limit)[doc]
            start = np.where(piece == 0, 0, head + (piece - 1) * limit)
            length = np.where(piece == 0, head, limit)
            at = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                bounds = np.concatenate([at, at[-1:] + length[-1:]]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


# -- one shard -----------------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the bin with the least room that holds it."""
    open_bins: list[list[list[int]]] = [[] for _ in range(limit + 1)]  # by room
    rooms, bins = 0, []  # bit r of rooms: a bin with room r is there
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + ((fitting & -fitting).bit_length() - 1)
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, own = limit, []
            bins.append(own)
        own.append(i)
        open_bins[room - n].append(own)
        rooms |= 1 << (room - n)
    return bins


def _better(room: int, mine: list[tuple[int, list[int]]], theirs: list[tuple[int, list[int]]]) -> tuple[int, list[int], list[int]] | None:
    """The exchange of some of mine for some of theirs that adds most to a bin with so much room: (added, mine, theirs)."""
    sums = [n for n, _ in theirs]
    best = None
    for out, give in mine:
        k = bisect.bisect_left(sums, out - room)  # the least that must come back
        if k < len(sums) and sums[k] < out and (best is None or out - sums[k] > best[0]):
            best = (out - sums[k], give, theirs[k][1])
            if best[0] == room:
                break
    return best


def local_search(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Empty the bin with the least in it into the others, again and again, as long as the sum of squared fills grows.

    Every step puts more into the fuller bin, so the sum grows strictly and the search ends. It ends early once the room in
    the other bins is less than what the next bin holds: that bin cannot vanish, nor can any fuller one. Then the emptiest bins
    exchange among themselves, until none of them gains or no bin can vanish.
    """
    room = [limit - sum(lengths[i] for i in own) for own in bins]
    sums: dict[int, tuple[list, list]] = {}

    def sums_of(b: int) -> tuple[list, list]:
        """Single pieces and pairs of the bin with their lengths, ascending."""
        if b not in sums:
            own = bins[b]
            ones = sorted((lengths[i], [i]) for i in own)
            twos = sorted((lengths[i] + lengths[j], [i, j]) for k, i in enumerate(own) for j in own[k + 1 :]) if len(own) <= 64 else []
            sums[b] = ones, twos
        return sums[b]

    nothing = [(0, [])]

    def step(source: int, target: int) -> bool:
        """The exchange that fills the target most, if the sum of squares grows by it."""
        if not room[target] or not bins[source]:
            return False
        (ones, twos), (t_ones, t_twos) = sums_of(source), sums_of(target)
        steps = (
            _better(room[target], ones[::-1], nothing),  # move one
            _better(room[target], ones[::-1], t_ones),  # one for one
            _better(room[target], twos[::-1], t_ones),  # two for one
            _better(room[target], ones[::-1], t_twos),  # one for two
        )
        added, give, take = max((s for s in steps if s), key=lambda s: s[0], default=(0, [], []))
        if not added or room[target] - added >= room[source]:  # it grows if the target ends fuller than the source was
            return False
        bins[source] = [i for i in bins[source] if i not in give] + take
        bins[target] = [i for i in bins[target] if i not in take] + give
        room[source], room[target] = room[source] + added, room[target] - added
        sums.pop(source), sums.pop(target)
        return True

    table: dict[str, np.ndarray] = {}

    def candidates(source: int) -> list[int]:
        """The open bins with anything to exchange for some of the source, in their order."""
        if not table:
            entries = [
                (n, b, kind) for b in open_bins for kind, found in enumerate((nothing, *sums_of(b))) for n in {n for n, _ in found}
            ]
            table["back"], table["bin"], table["kind"] = np.array(entries, np.int64).reshape(-1, 3).T
            table["most"] = table["back"] + np.array(room, np.int64)[table["bin"]]
        ones, twos = sums_of(source)
        fits = np.zeros(len(table["back"]), bool)
        for n in {n for n, _ in ones}:
            fits |= (table["back"] < n) & (table["most"] >= n)
        for n in {n for n, _ in twos}:
            fits |= (table["kind"] == 1) & (table["back"] < n) & (table["most"] >= n)
        found = set(table["bin"][fits].tolist())
        return [b for b in open_bins if b in found]

    open_bins = sorted((b for b in range(len(bins)) if room[b] > 0), key=lambda b: room[b])
    total = sum(room[b] for b in open_bins)
    while len(open_bins) > 1:
        source = open_bins.pop()
        if total - room[source] < limit - room[source]:
            break
        while any([step(source, target) for target in candidates(source)]):
            table.clear()
        total -= room[source]
        open_bins = [b for b in open_bins if room[b] > 0]
    # all pairs of the emptiest bins, as long as a bin more than the least number is there
    while sum(map(bool, bins)) * limit - sum(lengths) >= limit:
        tail = sorted((b for b in range(len(bins)) if bins[b] and room[b]), key=lambda b: -room[b])[:TAIL]
        if not any([step(a, b) for k, a in enumerate(tail) for b in tail[k + 1 :]]):
            break
    return [own for own in bins if own]


def pack_shard(lengths: list[int], limit: int) -> list[list[int]]:
    return local_search(best_fit(lengths, limit), lengths, limit)


def packer(limit: int, slack: int, round_no: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs the rows of one shard; bins with more room than slack stay open, unless it is the last round."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_uid", "ascending")])
        lengths = table.column("length").to_pylist()
        number, offset, closed = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.ones(len(lengths), bool)
        for b, own in enumerate(pack_shard(lengths, limit)):
            at = 0
            for i in own:
                number[i], offset[i] = b, at
                at += lengths[i]
            if not last and limit - at > slack:
                closed[own] = False
        number += (round_no << 56) + (key[0].as_py() << 16)
        for name, values in (("sequence_id", number), ("offset", offset), ("_closed", closed)):
            table = table.append_column(name, pa.array(values))
        return table.drop_columns(["_shard"])

    return packed


# -- all shards ----------------------------------------------------------------------------------------------------


def pack(items: DataFrame, limit: int = 1024, shard: int = SHARD, slack: int = SLACK) -> DataFrame:
    """The items (with a column length from 1 to limit) with sequence_id and offset, gapless from 0 in each sequence.

    Each round's result is written to the shared folder, so that a lost executor costs only its own shards.
    """
    spark, folder = items.sparkSession, shared_folder(items.sparkSession)
    names = items.columns
    left = written(items.withColumn("_uid", F.monotonically_increasing_id()), folder)
    n = left.count()
    done: list[DataFrame] = []
    round_no, stalled = 0, False
    while True:
        shards = max(1, math.ceil(n / shard))
        last = shards == 1 or stalled

        out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
        dealt = left.withColumn("_shard", F.pmod(F.xxhash64("_uid", F.lit(round_no)), F.lit(shards)))
        result = written(
            dealt.groupBy("_shard").applyInArrow(packer(limit, slack, round_no, last), out_schema + ", sequence_id long, offset long, _closed boolean"), folder
        )
        done.append(result.filter("_closed").select(*names, "sequence_id", "offset"))
        if last:
            break
        left = result.filter(~F.col("_closed")).drop("sequence_id", "offset", "_closed")
        now = left.count()
        if now == 0:
            break
        n, stalled, round_no = now, 2 * now > n, round_no + 1  # lengths that leave room wherever they go: one more round, which closes all
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def packed_documents(docs: DataFrame, tokenizer_path: str, limit: int = 1024, with_ids: bool = False) -> DataFrame:
    """All documents cut and packed: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(pieces(docs, tokenizer_path, limit, with_ids=with_ids), limit)
