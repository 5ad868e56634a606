"""Put the child rows of a parent together as one nested row.

All children and the parent's own columns travel through **one** shuffle: they are unioned as tagged rows
``(key, <one struct column per child>)`` and grouped once. ``collect_list`` skips the nulls of the other
children, and keeps null values because each value is wrapped in a struct.

A nested document is one row at every size. Where lists may be too long for a row, :func:`flat_tables` gives the same content
as a head row per parent and one row per entry.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """Rows that belong to a parent and how they become one column of it.

    ``agg``: ``list`` (sorted by ``order``, nulls and copies kept), ``set`` (sorted distinct), ``min``, ``max`` or
    ``sum``. ``where``: only these rows count; children that share one ``rows`` frame are read in one pass.
    ``copies``: how many entries of a list a row stands for, so that equal entries travel as one. ``dealt``: the rows
    are dealt by their parent already and are not moved again.
    """

    rows: DataFrame
    parent: str
    value: Column
    order: tuple[Column, ...] = ()
    agg: str = "list"
    where: Column | None = None
    copies: Column | None = None
    dealt: bool = False

    def entry(self) -> Column:
        if self.agg != "list":
            return self.value if self.where is None else F.when(self.where, self.value)
        order = self.order or (self.value,)
        keys = [k for o in order for k in (o.isNull(), o)]
        counted = [] if self.copies is None else [self.copies.cast("int").alias("n")]
        entry = F.struct(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("o"), self.value.alias("v"), *counted)
        return entry if self.where is None else F.when(self.where, entry)

    def aggregate(self, name: str) -> Column:
        if self.agg == "list":
            entries = F.sort_array(F.collect_list(name))
            values = F.transform(entries, lambda e: e["v"])
            if self.copies is None:
                return values
            some = F.when(F.exists(entries, lambda e: e["n"] != 1), F.transform(entries, lambda e: e["n"]))
            return F.struct(values.alias("v"), some.alias("n"))
        if self.agg == "set":
            return F.sort_array(F.collect_set(name))
        return {"min": F.min, "max": F.max, "sum": F.sum}[self.agg](name)


def repeated(runs: Column) -> Column:
    """The list that a child with ``copies`` stands for. Without copies, the counts are null and the values are the list."""
    return F.when(runs["n"].isNull(), runs["v"]).otherwise(F.flatten(F.zip_with(runs["v"], runs["n"], F.array_repeat)))


def assemble(
    base: DataFrame, key: str, children: dict[str, Child], by: str | None = None, runs: Collection[str] = ()
) -> DataFrame:
    """``base`` columns and one column per child; children without a base row are dropped.

    ``by``: a column of the base and of all children that a parent's rows share (the parent's own parent); the result is then dealt by it.
    ``runs``: children with ``copies`` that stay as they travel, to be written out by :func:`repeated`.
    """
    above = [] if by is None else [F.col(by).alias("_by")]
    keys = ["_key"] if by is None else ["_by", "_key"]
    tagged: dict[tuple[str, ...], DataFrame] = {
        ("_base",): base.select(*above, F.col(key).alias("_key"), F.struct(*base.columns).alias("_base"))
    }
    dealt = set()
    shared: dict[tuple[int, str], list[str]] = {}
    for name, child in children.items():
        shared.setdefault((id(child.rows), child.parent), []).append(name)
    for (_, parent), names in shared.items():
        rows = children[names[0]].rows
        tagged[tuple(names)] = rows.select(*above, F.col(parent).alias("_key"), *[children[n].entry().alias(n) for n in names])
        if children[names[0]].dealt:
            dealt.add(tuple(names))
    # every frame gets all columns at once, so that the union stays flat
    types = {n: df.schema[n].dataType for names, df in tagged.items() for n in names}

    def widened(names: tuple[str, ...], df: DataFrame) -> DataFrame:
        columns = [F.col(n) if n in names else F.lit(None).cast(t).alias(n) for n, t in types.items()]
        return df.select(*keys, *columns)

    together = reduce(DataFrame.union, [widened(names, df) for names, df in tagged.items() if names not in dealt])
    # dealt before they are grouped: a partial aggregate makes no list shorter, but sorts, spills and mixes the rows before the shuffle
    together = together.repartition(keys[0])
    # frames that are dealt alike stay so in a union
    together = reduce(DataFrame.union, [widened(names, tagged[names]) for names in tagged if names in dealt], together)
    aggs = [F.min("_base").alias("_base")] + [c.aggregate(n).alias(n) for n, c in children.items()]
    out = together.groupBy(*keys).agg(*aggs).filter(F.col("_base").isNotNull())
    made = [repeated(F.col(n)).alias(n) if c.copies is not None and n not in runs else F.col(n) for n, c in children.items()]
    if by is None:
        return out.select("_base.*", *made)
    # the column that the rows are dealt by goes on as itself, or the planner does not know it again in the structure
    return out.select(*[F.col("_by").alias(c) if c == by else F.col(f"_base.{c}").alias(c) for c in base.columns], *made)


def flat_tables(base: DataFrame, key: str, children: dict[str, Child]) -> dict[str, DataFrame]:
    """The same content without nesting: ``head``, one row per parent with all that is no list, and one table per list.

    A list's table has a row per entry, ``(<key>, order, value)``; ``order`` sorts the entries of a parent. So a parent with
    any number of entries is spread over tasks like any other rows.
    """
    lists = {n: c for n, c in children.items() if c.agg in ("list", "set")}
    out = {"head": assemble(base, key, {n: c for n, c in children.items() if n not in lists})}
    for name, child in lists.items():
        rows = child.rows if child.where is None else child.rows.filter(child.where)
        plain = replace(child, where=None, agg="list").entry()
        entries = rows.select(F.col(child.parent).alias(key), plain.alias("e"))
        if child.copies is not None:
            entries = entries.select(key, F.explode(F.array_repeat("e", F.col("e.n"))).alias("e"))
        entries = entries.select(key, F.col("e.o").alias("order"), F.col("e.v").alias("value"))
        entries = entries.filter("value is not null").distinct() if child.agg == "set" else entries
        out[name] = entries.join(base.select(key), key, "left_semi")
    return out


def spread(entries: DataFrame, key: str, partitions: int) -> DataFrame:
    """Entries of a flat list table in ranges of (parent, order), each sorted: written, the files follow each other in order.

    The limits are sampled over both, so a parent with a large share of all entries spans many tasks, and its order survives. Entries that
    are alike in all go by their value's hash.
    """
    place = [F.col(key), F.col("order"), F.xxhash64("value")]
    return entries.repartitionByRange(partitions, *place).sortWithinPartitions(*place)


def within(df: DataFrame, column: str, ids: DataFrame | None, id_column: str = "id") -> DataFrame:
    """Rows whose ``column`` is among ``ids``; all rows if there is no restriction."""
    if ids is None:
        return df
    return df.join(ids.select(F.col(id_column).alias(column)), column, "left_semi")


def list_per_key(child: Child, name: str) -> DataFrame:
    """``(<parent>, <name>)``: one list per key."""
    rows = child.rows.select(F.col(child.parent).alias("_key"), child.entry().alias(name))
    made = rows.groupBy("_key").agg(child.aggregate(name).alias(name))
    listed = F.col(name) if child.copies is None else repeated(F.col(name)).alias(name)
    return made.select(F.col("_key").alias(child.parent), listed)
