"""Albums with some fields of what they embed, and the one shuffle of a nesting level."""

import re

from pyspark.sql import functions as F

from sleevenotes.functions.assemble import Child, assemble
from sleevenotes.operators.album import album_docs


def test_rows_are_dealt_before_lists_are_made(spark):
    base = spark.range(1000).select(F.col("id").alias("row_id"))
    rows = spark.range(5000).select((F.col("id") % 1000).alias("owner"), F.col("id").alias("v"))
    docs = assemble(base, "row_id", {"vs": Child(rows, "owner", F.col("v"))})
    plan = docs._jdf.queryExecution().sparkPlan().toString() + docs._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"(ObjectHashAggregate|SortAggregate|Exchange hashpartitioning)", docs._jdf.queryExecution().executedPlan().toString())
    assert "collect_list" in plan
    # from the top: both steps of the aggregate, and no aggregate below the exchange
    assert nodes.count("Exchange hashpartitioning") == 1 and nodes[-1] == "Exchange hashpartitioning", nodes
    assert docs.filter(F.size("vs") == 5).count() == 1000


def test_fields_of_embedded_documents_are_those_of_the_whole_ones(spark, imported):
    some = {"artists": ("artistname", "genres", "rating"), "Releases": ("Media", "Tracks", "Releasedate"), "Tracks": ("trackname", "oldids")}
    whole, part = album_docs(imported), album_docs(imported, embedded=some)
    artist, release, track = (
        part.select(F.explode("artists")).select("col.*").columns,
        part.select(F.explode("Releases")).select("col.*").columns,
        part.select(F.explode("Releases.Tracks")).select(F.explode("col")).select("col.*").columns,
    )
    assert artist == ["id", "artistname", "rating", "genres"]
    assert release == ["Id", "Releasedate", "Media", "Tracks"]
    assert track == ["id", "oldids", "trackname", "mediumnumber", "trackposition"]

    def taken(column, fields):
        return lambda e: F.struct(*[column(e, f).alias(f) for f in fields])

    def field(e, f):
        return F.transform(e["Tracks"], lambda t: F.struct(*[t[c].alias(c) for c in track])) if f == "Tracks" else e[f]

    cut = whole.withColumns(
        {"artists": F.transform("artists", taken(lambda e, f: e[f], artist)), "Releases": F.transform("Releases", taken(field, release))}
    )
    expected = {r.id: r for r in cut.collect()}
    found = {r.id: r for r in part.collect()}
    assert expected and found == expected


def test_bases_are_written_without_moving_the_documents(spark, tmp_path):
    from sleevenotes.sources.documents import DocumentStore

    store = DocumentStore(spark, str(tmp_path), "id string, n long")
    docs = spark.range(0, 1000, 1, 8).select(F.format_string("%06d", (F.col("id") * 37) % 1000).alias("id"), F.col("id").alias("n"))
    store.write_base(docs)
    assert len(list((tmp_path / "base=0").glob("*.parquet"))) == 8  # each task writes its own
    held = spark.read.parquet(str(tmp_path / "base=0")).withColumn("file", F.input_file_name())
    for file in held.select("file").distinct().collect():
        ids = [r.id for r in held.filter(F.col("file") == file.file).select("id").collect()]
        assert ids == sorted(ids)
    assert store.current().count() == 1000
