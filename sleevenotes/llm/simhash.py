"""Near-duplicates: SimHash fingerprints, linked at few differing bits with vantage-point trees.

Two fingerprints of 64 bits that differ in at most 3 differ in at most 1 within their left or their right half. So there is
one tree for each half, and it need only find pairs within radius 1. In a tree, each node has a vantage point and a radius R:
what lies within R goes to the near child, what lies at R or beyond to the far child. By the triangle bound two halves within 1 of
each other always meet in one of the children; only those at exactly R go to both. (In the whole space with radius 3, half
of all points would go to both; see the README.) The trees are fitted on a bounded sample of fingerprints; all distinct fingerprints are routed
to their leaves, the shards, and compared exactly there by all 64 bits.

A shard returns no pairs but its components, as groups of at most GROUP members: larger ones become a tree of such groups, so no key is hot.
Labels (the smallest document id) then spread over groups until nothing changes; each round is written to the shared folder.

Defined cases: a text without words, also null, has fingerprint zero and is linked like any other; equal texts, repeated rows and
repeated ids are documents of their own with the same component; a document without an id counts as later than all others,
and its component_id is null only if no document with an id is in it. An empty table gives an empty result. Other columns are kept by
``one_of_each`` and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleevenotes.llm.text import SPACES, ascii_lower, drawn, parts, positions
from sleevenotes.sources.work import shared_folder, written

SHINGLE = 3
BITS = 3
#: Fingerprints that the trees are fitted on, about, if a quarter of all is more; 1 MB.
SAMPLE = 131_072
#: Distinct fingerprints that a leaf should own, about.
LEAF = 8_192
#: Up to so many are compared without a further split.
BRUTE = 1_024
GROUP = 64
HASHES_AT_ONCE = 1 << 14
NO_ID = 1 << 62


# -- fingerprints --------------------------------------------------------------------------------------------------


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Callable[[DataFrame], DataFrame]:
    """Adds ``hashes``: XXH64 with seed 42 of each shingle."""

    def add(docs: DataFrame) -> DataFrame:
        split = docs.withColumn("_w", parts(ascii_lower(text), SPACES))
        n = F.size("_w")
        each = F.transform(
            positions(n - shingle + 1), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("_w", i + k) for k in range(shingle))))
        )
        whole = F.when(n > 0, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(F.array().cast("array<bigint>"))
        return split.withColumn("hashes", F.when(n < shingle, whole).otherwise(each)).drop("_w")

    return add


def majority_bits(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes, the bits set in more than half of them."""
    n = np.diff(bounds)
    ones = np.zeros((len(n), 64), np.int64)
    for a in range(0, len(values), HASHES_AT_ONCE):
        b = min(len(values), a + HASHES_AT_ONCE)
        bits = np.unpackbits(values[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b, side="left")
        rows = np.arange(first, last)
        rows = rows[(bounds[rows + 1] > a) & (n[rows] > 0)]
        ones[rows] += np.add.reduceat(bits, np.maximum(bounds[rows] - a, 0), axis=0, dtype=np.int32)
    set_ = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def id_or_stand_in(doc_id: Column, text_hash: Column) -> Column:
    """The id, or for a missing one a number beyond all ids."""
    return F.coalesce(doc_id.cast("long"), text_hash.bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, id (doc_id, or what stands for a missing one), text_hash and fingerprint (long) of each row."""
    text = F.coalesce("text", F.lit(""))
    hashed = shingle_hashes(F.col("text"), shingle)(docs.select("doc_id", text.alias("text"))).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "hashes"
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            found = majority_bits(values, bounds - bounds[0])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fingerprint": pa.array(found.view(np.int64))}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = hashed.mapInArrow(fold, f"doc_id {kind}, text_hash long, fingerprint long")
    return out.withColumn("id", id_or_stand_in(F.col("doc_id"), F.col("text_hash")))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# -- trees ---------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes by number. A leaf has no children (0) and counts in ``leaf``."""

    vantage: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaf: np.ndarray

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which point goes to which leaf; some go to more than one."""
        rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            end = self.near[nodes] == 0
            done.append((rows[end], self.leaf[nodes[end]]))
            rows, nodes = rows[~end], nodes[~end]
            d = np.bitwise_count(points[rows] ^ self.vantage[nodes]).astype(np.int64)
            near, far = d <= self.radius[nodes], d >= self.radius[nodes]
            rows, nodes = np.concatenate([rows[near], rows[far]]), np.concatenate([self.near[nodes[near]], self.far[nodes[far]]])
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def best_split(points: np.ndarray) -> tuple[np.uint32, int, np.ndarray] | None:
    """Vantage point, radius and distances that leave the smallest larger child; none if no child would be smaller by a tenth."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        for vantage in (v, v ^ np.uint32(0x0F0F0F0F)):  # a member, and a point far from it
            d = np.bitwise_count(points ^ vantage).astype(np.int64)
            upto = np.cumsum(np.bincount(d, minlength=33))
            before = np.concatenate([[0], upto[:-1]])
            larger = np.maximum(upto, len(points) - before)
            r = int(np.argmin(larger))
            if best is None or larger[r] < best[0]:
                best = (larger[r], vantage, r, d)
    return best[1:] if best and best[0] <= 0.9 * len(points) else None


def fit_tree(sample: np.ndarray, leaf_share: float) -> Tree:
    """Splits until a node's share of the sample is at most leaf_share, or it cannot be split."""
    nodes: list[list[int]] = [[0, 0, 0, 0, 0]]
    todo, leaves, enough = [(0, sample)], 0, max(16.0, leaf_share * len(sample))
    while todo:
        k, points = todo.pop()
        split = best_split(points) if len(points) > enough else None
        if split is None:
            nodes[k][4], leaves = leaves, leaves + 1
            continue
        vantage, radius, d = split
        nodes[k][:4] = [int(vantage), radius, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), points[d <= radius]), (len(nodes) + 1, points[d >= radius])]
        nodes += [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
    columns = np.array(nodes, np.int64).T
    return Tree(columns[0].astype(np.uint32), *columns[1:])


# -- one shard -----------------------------------------------------------------------------------------------------


def _root(parent: np.ndarray, k: np.ndarray) -> np.ndarray:
    r = parent[k]
    while (parent[r] != r).any():
        r = parent[r]
    return r


def _link(whole: np.ndarray, half: np.ndarray, rows: np.ndarray, parent: np.ndarray, bits: int) -> None:
    """Join, in parent, all rows whose fingerprints differ in at most ``bits`` and whose halves differ in at most one."""
    split = best_split(half[rows]) if len(rows) > BRUTE else None
    if split is not None:
        _, radius, d = split
        _link(whole, half, rows[d <= radius], parent, bits)
        _link(whole, half, rows[d >= radius], parent, bits)
        return
    points = whole[rows]
    step = max(1, (1 << 20) // max(1, len(rows)))
    for a in range(0, len(rows), step):
        near = np.bitwise_count(points[a : a + step, None] ^ points[None, a:]) <= bits
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            own = _root(parent, rows[a:][near[i]])
            parent[own] = own.min()


def shard_components(whole: np.ndarray, half: np.ndarray, bits: int) -> np.ndarray:
    """For each distinct fingerprint the position of its component's first."""
    parent = np.arange(len(whole))
    _link(whole, half, parent.copy(), parent, bits)
    return _root(parent, np.arange(len(whole)))


def halves(whole: np.ndarray, side: int) -> np.ndarray:
    return ((whole >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def grouped_members(members: np.ndarray) -> list[np.ndarray]:
    """Groups of at most GROUP: the members in runs, then the first of each run in runs, and so on."""
    out = []
    while len(members) > 1:
        out += [members[a : a + GROUP] for a in range(0, len(members), GROUP)]
        members = members[::GROUP]
    return [g for g in out if len(g) > 1]


def linker(bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def linked(key: tuple, table: pa.Table) -> pa.Table:
        shard, side = key[0].as_py(), key[1].as_py()
        whole = np.unique(table.column("fingerprint").to_numpy()).view(np.uint64)
        root = shard_components(whole, halves(whole, side), bits)
        order = np.argsort(root, kind="stable")
        starts = np.flatnonzero(np.diff(root[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        groups = [g for a, b in zip(starts, ends, strict=True) if b - a > 1 for g in grouped_members(whole[order[a:b]])]
        number = np.repeat(np.arange(len(groups)), [len(g) for g in groups]) + ((2 * shard + side) << 32)
        members = np.concatenate(groups) if groups else np.zeros(0, np.uint64)
        return pa.table({"group": pa.array(number.astype(np.int64)), "fingerprint": pa.array(members.view(np.int64))})

    return linked


# -- all shards ----------------------------------------------------------------------------------------------------


def linked_groups(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """Groups (group, fingerprint) whose members are connected; two fingerprints are connected exactly if groups connect them."""
    wanted = min(SAMPLE, max(1, n // 4))
    rows = distinct.select("fingerprint").filter(drawn(F.col("fingerprint"), wanted, n)).limit(2 * wanted).collect()
    sample = np.array([r.fingerprint for r in rows], np.int64).view(np.uint64)
    trees = [fit_tree(halves(sample, side), LEAF / n) for side in (0, 1)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                at, leaf = trees[side].route(halves(whole, side))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(leaf, pa.int64()),
                        "side": pa.array(np.full(len(at), side), pa.int32()),
                        "fingerprint": pa.array(whole[at].view(np.int64)),
                    }
                )

    routed = distinct.select("fingerprint").mapInArrow(route, "shard long, side int, fingerprint long")
    return routed.groupBy("shard", "side").applyInArrow(linker(bits), "group long, fingerprint long")


def spread_labels(groups: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Labels (fingerprint, label) of all members, each the smallest in its component."""
    now = written(groups.select("fingerprint").distinct().join(labels, "fingerprint"), folder)
    while True:
        lowest = groups.join(now, "fingerprint").groupBy("group").agg(F.min("label").alias("lowest"))
        heard = groups.join(lowest, "group").groupBy("fingerprint").agg(F.min("lowest").alias("heard"))
        new = written(
            now.join(heard, "fingerprint").select(
                "fingerprint", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("changed")
            ),
            folder,
        )
        now = new.drop("changed")
        if new.filter("changed").isEmpty():
            return now


def components(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """id, text_hash, doc_id, fingerprint and label (the smallest id in the component) of each row."""
    folder = shared_folder(docs.sparkSession)
    rows = written(fingerprints(docs, shingle), folder)
    distinct = written(rows.groupBy("fingerprint").agg(F.min("id").alias("label")), folder)
    n = distinct.count()
    if not n:
        return rows.withColumn("label", F.col("id"))
    groups = written(linked_groups(distinct, n, bits), folder)
    final = distinct
    if not groups.isEmpty():
        spread = spread_labels(groups, distinct, folder).withColumnRenamed("label", "lower")
        final = distinct.join(spread, "fingerprint", "left").select("fingerprint", F.coalesce("lower", "label").alias("label"))
    return rows.join(final, "fingerprint")


def one_of_each(docs: DataFrame, found: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """The first document of each component, with its own columns; ``found`` makes the components."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    doc_id, text = plain[f"c{names.index('doc_id')}"], plain[f"c{names.index('text')}"]
    first = written(
        found(plain.select(doc_id.alias("doc_id"), text.alias("text")))
        .filter("id = label").groupBy("id", "fingerprint", "label").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("times"))
        .groupBy("id").agg(F.min("text_hash").alias("text_hash"), F.sum("times").alias("times"))
    )
    hashed = plain.withColumn("_h", F.xxhash64(F.coalesce(text, F.lit(""))))
    keyed = hashed.withColumn("_id", id_or_stand_in(doc_id, F.col("_h")))
    kept = keyed.join(
        first.select(F.col("id").alias("_id"), F.col("text_hash").alias("_h")), ["_id", "_h"], "left_semi"
    )
    if not first.filter("times > 1").isEmpty():  # repeated rows: one of them
        order = Window.partitionBy("_id", "_h").orderBy(*(f"c{k}" for k in range(len(names))))
        kept = kept.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
