"""Attribute index, sort keys, flat lists with a hot parent, and builds range by range."""

import micro
import pytest
from pyspark.sql import functions as F

from sleevenotes.functions.assemble import spread
from sleevenotes.operators import attributes as T
from sleevenotes.operators import lookup as L
from sleevenotes.plans import entity as P
from sleevenotes.plans.entity import ALBUM, ARTIST, bulk_build
from sleevenotes.sources.documents import DocumentStore


def test_ids_first_finds_what_filters_of_documents_find(spark, tmp_path):
    cat = micro.catalog(spark)
    for entity, conditions in ((ARTIST, dict(genres="Hip-Hop", status="ended")), (ARTIST, dict(oldids="x0")), (ALBUM, dict(artistids="a1", type="Album")),
                               (ALBUM, dict(genres="nope")), (ARTIST, {})):
        path = str(tmp_path / entity.index)
        T.write_attributes(entity, cat, path)
        attributes, sorts = T.read_attributes(spark, path)
        found = {r.gid for r in T.ids_where(attributes, entity.filterable, **conditions).collect()}
        docs = entity.build(cat)
        assert found == {r.id for r in L.filter_by(docs, entity.filterable, **conditions).collect()}
        assert [r.gid for r in T.first_ids(sorts, ("rating", "releasedate"), 2).collect()] == [
            r.id for r in L.sort_by(docs, "rating.Value", *(["releasedate"] if entity is ALBUM else [])).limit(2).collect()
        ]
    with pytest.raises(ValueError):
        T.ids_where(attributes, ARTIST.filterable, overview="x")


def test_a_hot_parent_spans_tasks_in_order(spark):
    hot = spark.range(30_000).select(F.lit(7).cast("long").alias("row_id"), F.struct((F.col("id") % 999).alias("k0")).alias("order"), F.col("id").alias("value"))
    rest = spark.range(60_000).select((F.col("id") % 5000 + 10).alias("row_id"), F.struct(F.col("id").alias("k0")).alias("order"), F.col("id").alias("value"))
    dealt = spread(hot.unionByName(rest).repartition(7), "row_id", 30).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in dealt.groupBy("task").count().collect()]
    assert max(sizes) < 3 * 90_000 / 30 and dealt.filter("row_id = 7").select("task").distinct().count() >= 5
    runs = dealt.groupBy("task").agg(F.min(F.struct("row_id", "order")).alias("a"), F.max(F.struct("row_id", "order")).alias("z"))
    ends = sorted((r.task, (r.a.row_id, r.a.order.k0), (r.z.row_id, r.z.order.k0)) for r in runs.collect())
    assert all(z <= a for (_, _, z), (_, a, _) in zip(ends, ends[1:]))


def test_a_build_that_stopped_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    cat = micro.catalog(spark)
    docs = ARTIST.build(cat)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    store, write, written_ranges = DocumentStore(spark, str(tmp_path / "a"), schema), DocumentStore.write_range, []

    def stops(self, docs, k, version):
        if len(written_ranges) == 2:
            raise RuntimeError("lost")
        written_ranges.append(k)
        write(self, docs, k, version)

    monkeypatch.setattr(DocumentStore, "write_range", stops)
    with pytest.raises(RuntimeError):
        bulk_build(ARTIST, cat, store, 5, F.timestamp_seconds(F.lit(0)), ranges=3)
    assert not store.has("base", 0) and store.has("range-0", 0)
    monkeypatch.setattr(DocumentStore, "write_range", lambda self, d, k, v: (written_ranges.append(k), write(self, d, k, v)))
    marks = bulk_build(ARTIST, cat, store, 5, F.timestamp_seconds(F.lit(0)), ranges=3)
    assert sorted(written_ranges) == [0, 1, 2] and marks.count() == docs.count()
    assert micro.as_json(store.current()) == micro.as_json(docs)
    store.write_delta(docs.filter("id = 'a1'"), docs.filter("id = 'a2'"), 1)
    store.compact(1)
    store.write_delta(docs.limit(0), docs.limit(0), 2)
    store.compact(2)
    assert {r.id for r in store.current().collect()} == {r.id for r in docs.collect()} - {"a2"}
    assert P.documented(ARTIST, cat).count() == docs.count()
