"""Equal entries and tracks on their way into albums."""

import re

import micro
from pyspark.sql import functions as F

from sleevenotes.functions.assemble import Child, assemble, flat_tables, list_per_key, repeated
from sleevenotes.operators.album import album_docs
from sleevenotes.operators.artist import artist_light_docs, genres

TWICE = [dict(name="hip-hop"), dict(name="rock"), dict(name="hip-hop"), dict(name="hip-hop")]


def test_equal_genres_travel_as_one_and_are_listed_as_often_as_they_are_there(spark):
    cat = micro.catalog(spark, genre=TWICE)
    rows = genres(cat["artist_tag"], "artist", cat).rows.collect()
    assert [(r.artist, r.genre, r.copies) for r in rows] == [(1, "Hip-Hop", 3)]
    light = artist_light_docs(cat, runs=("genres",)).filter("id = 'a1'").first().genres
    assert (list(light.v), list(light.n)) == (["Hip-Hop"], [3])
    lists = {r.id: r.genres for r in artist_light_docs(cat).collect()}
    assert lists == {"a1": ["Hip-Hop"] * 3, "a2": [], "a3": []}
    albums = {r.id: [a.genres for a in r.artists] for r in album_docs(cat).collect()}
    assert albums == {"g10": [lists["a1"], lists["a2"]], "g11": [lists["a2"]]}


def test_copies_keep_the_order_nulls_and_parents_of_a_list(spark):
    base = spark.createDataFrame([(1,), (2,), (None,)], "row_id long")
    rows = spark.createDataFrame([(1, "b", 2), (1, None, 2), (1, "a", 1), (None, "c", 3), (9, "d", 1)], "owner long, v string, n long")
    child = Child(rows, "owner", F.col("v"), copies=F.col("n"))
    expected = {1: ["a", "b", "b", None, None], 2: [], None: ["c"] * 3}
    assert {r.row_id: r.vs for r in assemble(base, "row_id", {"vs": child}).collect()} == expected
    packed = assemble(base, "row_id", {"vs": child}, runs=("vs",))
    assert {r.row_id: r.vs for r in packed.select("row_id", repeated(F.col("vs")).alias("vs")).collect()} == expected
    assert {r.owner: r.vs for r in list_per_key(child, "vs").filter("owner = 1").collect()} == {1: expected[1]}
    flat = flat_tables(base, "row_id", {"vs": child})["vs"]
    assert [r.value for r in flat.orderBy("order").collect()] == expected[1]


def test_tracks_are_moved_once_to_their_album(spark):
    cat = micro.catalog(spark)
    plan = album_docs(cat)._jdf.queryExecution().executedPlan().toString()
    lines = [(len(re.match("[ :]*", line)[0]), line.strip(" :+-")) for line in plan.splitlines()]
    dealt = [i for i, (_, what) in enumerate(lines) if what.startswith("Exchange hashpartitioning(_by")]
    assert len(dealt) == 1
    depth, above = lines[dealt[0]][0], []
    for d, what in reversed(lines[: dealt[0]]):
        if d < depth:
            depth = d
            above.append(what.split("(")[0].split()[0])
    # from the tracks' shuffle up to the albums: both lists are made without another one
    assert above.count("ObjectHashAggregate") == 4 and "Union" in above and "Exchange" not in above, above
    assert {r.id: [x.Id for x in r.Releases] for r in album_docs(cat).collect()} == {"g10": ["r100"], "g11": ["r102"]}


def test_releases_that_come_twice_or_change_their_group_keep_their_tracks(spark):
    twice = micro.ROWS["release"] + micro.ROWS["release"][:1]
    once = {r.id: r.Releases for r in album_docs(micro.catalog(spark)).collect()}
    assert {r.id: r.Releases for r in album_docs(micro.catalog(spark, release=twice)).collect()} == once
    assert [len(x.Tracks) for x in once["g10"]] == [2]


def test_empty_stores_read_no_table(spark, tmp_path):
    import __spark_entry__ as entry

    class Unread(dict):
        def __getitem__(self, name):
            raise AssertionError(f"{name} was read")

    stores = entry.empty_stores(spark, Unread(), str(tmp_path))
    for entity in (entry.ARTIST, entry.ALBUM):
        made = entity.build(micro.catalog(spark))
        assert stores[entity.name].schema == ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)


def test_contents_of_albums_make_the_documents_once(spark, monkeypatch):
    import __spark_entry__ as entry

    found = entry.album_contents(micro.catalog(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(Tracks") == 1
    rows = found.groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in rows} == {"track": 2, "medium": 1, "artist": 3}
