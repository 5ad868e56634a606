import json
import os
import random

import micro
import pytest
from pyspark.sql import functions as F

from sleevenotes.functions import scalars as S
from sleevenotes.functions.hosts import ascii_label
from sleevenotes.operators.album import album_docs, album_tables
from sleevenotes.operators.artist import artist_docs, artist_tables
from sleevenotes.operators.release import release_docs, release_tables
from sleevenotes.plans.entity import ALBUM, ARTIST, page
from sleevenotes.schemas import ARTIST_DOC
from sleevenotes.sources.catalog import import_catalog, is_empty, kept_tables, load_catalog
from sleevenotes.sources.documents import DocumentStore, decode_json, encode_json


def evaluate(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_partial_dates(spark):
    rows = [(None, None, None), (1999, None, 5), (None, 3, 4), (2021, 2, 30), (2021, 13, 1), (2020, 2, 29), (-5, 1, 1)]
    got = evaluate(spark, rows, "y int, m int, d int", S.partial_date(F.col("y"), F.col("m"), F.col("d")).cast("string"))
    assert [g[0] for g in got] == ["0001-01-01", "1999-01-05", "0001-03-04", None, None, "2020-02-29", None]


@pytest.mark.parametrize(
    "text, expected",
    [("hip-hop", "Hip-Hop"), ("r&b", "R&B"), ("rock 'n' roll", "Rock 'N' Roll"), ("2-step", "2-Step"), ("éTUDE", "Étude")],
)
def test_initcap(spark, text, expected):
    assert evaluate(spark, [(text,)], "t string", S.initcap_words(F.col("t"))) == [(expected,)]


def test_link_types(spark):
    cases = {
        "https://www.google.com/search": "google",
        "https://subdomain.example.co.uk": "subdomain",
        "http://github.com": "github",
        "ftp://testsite.org": "testsite",
        "mailto:a@b.c": None,
        "not a url": None,
        "https://a_b.com/x": "a_b",
        "HTTPS://u:p@WWW.Example.com:8080/a|b": "example",
        "https://www.b\u00fccher.example/x": "xn--bcher-kva",
        "https://M\u00dcNCHEN\u3002de/": "xn--mnchen-3ya",
        "https://\u4f8b\u3048.jp": "xn--r8jz45g",
    }
    got = evaluate(spark, [(u,) for u in cases], "u string", S.link_type(F.col("u")))
    assert [g[0] for g in got] == list(cases.values())


def test_labels_of_other_scripts(spark):
    rng = random.Random(3)
    alphabets = ["abcxyz019-", "\u00e4\u00f6\u00fc\u00df\u00e9", "\u3072\u3089\u304c\u306a", "\u0430\u0431\u0432\u0433", "\U0001f600\U0001f4a9", "\u4f8b\u5b50"]
    labels = ["plain", "\u00fc", "a\u00fc", "\u00fca", "\U0010ffff"] + [
        "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 40))) for _ in range(300)
    ]
    got = evaluate(spark, [(x,) for x in labels], "u string", ascii_label(F.col("u")))
    want = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    assert [g[0] for g in got] == want


def test_rating_and_status(spark):
    rows = [(85, 3, True), (None, None, None), (0, 1, False)]
    got = evaluate(spark, rows, "v int, c int, e boolean", S.rating(F.col("c"), F.col("v")), S.status(F.col("e")))
    assert [(tuple(r), s) for r, s in got] == [((3, 8.5), "ended"), ((0, None), "active"), ((1, 0.0), "active")]


def test_artist_document(spark):
    docs = {k: json.loads(v) for k, v in micro.as_json(artist_docs(micro.catalog(spark))).items()}
    joy = docs["a1"]
    assert list(joy) == [
        "id", "oldids", "artistname", "sortname", "artistaliases", "status", "disambiguation", "type", "rating", "links",
        "overview", "albums", "images", "genres",
    ]
    assert joy["oldids"] == ["x0", "x1"]
    assert joy["artistaliases"] == ["a", "a", None]
    assert joy["rating"] == {"Count": 3, "Value": 8.5}
    assert joy["links"] == [{"target": "google", "type": "https://www.google.com/search"}]
    assert joy["genres"] == ["Hip-Hop"]
    assert [a["id"] for a in joy["albums"]] == ["g10"]
    assert joy["albums"][0]["secondarytypes"] == ["Demo", "Live"]
    assert joy["albums"][0]["releasedate"] == "1999-01-05"
    assert docs["a2"]["albums"][0]["type"] == "Other"
    assert docs["a2"]["albums"][0]["releasedate"] == "0001-01-01"
    assert docs["a3"]["type"] is None and docs["a3"]["albums"] == [] and docs["a3"]["status"] == "active"


def test_album_document(spark):
    docs = {k: json.loads(v) for k, v in micro.as_json(album_docs(micro.catalog(spark))).items()}
    assert set(docs) == {"g10", "g11"}
    closer = docs["g10"]
    assert closer["aliases"] == ["Closer!", "R1"]
    assert closer["artistids"] == ["a1", "a2"] and [a["id"] for a in closer["artists"]] == ["a1", "a2"]
    assert closer["artists"][0]["albums"] == [] and closer["artists"][0]["images"] == []
    assert [i["CoverType"] for i in closer["images"]] == ["Cover", "Disc"]
    assert closer["images"][0]["remoteUrl"].endswith("/release/g10/8")
    assert closer["images"][1]["Url"].endswith("/release/g10/7")
    assert closer["overview"] is None and closer["releasestatuses"] is None
    assert [r["Id"] for r in closer["Releases"]] == ["r100"]
    release = closer["Releases"][0]
    assert release["Releasedate"] == "2005-06-07" and release["Label"] == ["Factory", "Factory"]
    assert release["Country"] == ["UK"] and release["TrackCount"] == 9
    assert release["Media"] == [{"format": "CD", "name": "m2", "position": 2}]
    assert [t["id"] for t in release["Tracks"]] == ["t2", "t1"]
    assert release["Tracks"][1]["oldids"] == ["u1"] and release["Tracks"][1]["oldrecordingids"] == ["v1"]
    assert docs["g11"]["images"] == [] and docs["g11"]["Releases"][0]["Releasedate"] == "0001-01-01"


def test_image_address_of_the_release(spark):
    docs = album_docs(micro.catalog(spark), use_release_gid=True)
    url = docs.filter("id = 'g10'").select(F.col("images")[0]["remoteUrl"]).first()[0]
    assert url.endswith("/release/r100/8")


def test_tracks_are_read_once(spark, imported):
    assert any("/track/" in f for f in imported["track"].inputFiles())
    docs = album_docs(imported)  # tracks have been read once and written with their releases
    assert not any("/track/" in f for f in docs.inputFiles())


def test_release_without_dates(spark):
    docs = release_docs(micro.catalog(spark, release_country=[], release_unknown_country=[]))
    assert [r[0] for r in docs.select("Releasedate").collect()] == [None, None]


def test_pages_are_the_whole(spark, imported):
    for entity in (ARTIST, ALBUM):
        whole = micro.as_json(entity.build(imported))
        seen, after = {}, "00000000-0000-0000-0000-000000000000"
        for _ in range(2):
            rows = encode_json(page(entity, imported, after, size=max(len(whole) // 2 + 1, 1))).collect()
            assert [r.id for r in rows] == sorted(r.id for r in rows)
            seen |= {r.id: r.json for r in rows}
            after = rows[-1].id if rows else after
        assert seen == whole


# -- the same content without nesting --------------------------------------------------------------------------------


def nested_again(tables, name, key="row_id"):
    rows = sorted(tables[name].collect(), key=lambda r: (r[key], tuple((v is None, str(v)) if not isinstance(v, (int, bool)) else (False, v) for v in r.order)))
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(repr(r.value))
    return out


@pytest.mark.parametrize(
    "build, flat, lists",
    [
        (artist_docs, artist_tables, ["oldids", "artistaliases", "links", "albums", "genres"]),
        (album_docs, album_tables, ["oldids", "aliases", "secondarytypes", "artistids", "links", "genres"]),
    ],
)
def test_flat_tables_hold_the_lists(spark, imported, build, flat, lists):
    tables = flat(imported)
    ids = {r.row_id: r.id for r in tables["head"].select("row_id", "id").collect()}
    docs = {r.id: r for r in build(imported).collect()}
    assert sorted(ids.values()) == sorted(docs)
    for name in lists:
        found = nested_again(tables, name)
        for row_id, id_ in ids.items():
            assert sorted(found.get(row_id, [])) == sorted(repr(v) for v in docs[id_][name]), (id_, name)


def test_flat_tracks_hold_all_tracks(spark, imported):
    tracks = release_tables(imported)["Tracks"].select(F.col("value.id").alias("t"))
    nested = release_docs(imported).select(F.explode("Tracks.id").alias("t"))
    assert sorted(r.t for r in tracks.collect()) == sorted(r.t for r in nested.collect())


def test_long_redirect_lists_do_not_repeat_tracks(spark):
    many = [(f"old{k}", 1) for k in range(2_000)]
    plain = micro.catalog(spark)
    cat = {**plain, "track_gid_redirect": spark.createDataFrame(many, plain["track_gid_redirect"].schema)}
    count = lambda c: album_docs(c).select(F.explode("Releases").alias("r")).select(F.explode("r.Tracks.id")).count()
    assert count(cat) == count(plain) > 0


# -- tables and stores ----------------------------------------------------------------------------------------------


def test_allowlist(spark, tmp_path):
    assert kept_tables(["artist", "index_listing"], ["catalog"]) == ["artist"]
    assert len(kept_tables()) == 36
    path = str(tmp_path / "c")
    import_catalog(micro.catalog(spark), path, keep_tables=["artist", "tag"])
    import_catalog(micro.catalog(spark, artist=[]), path, keep_tables=["artist"])  # already there: left alone
    cat = load_catalog(spark, path, keep_tables=["artist", "tag"])
    assert set(cat) == {"artist", "tag"} and cat["artist"].count() == 3 and not is_empty(cat["tag"])


def test_an_unfinished_import_is_done_again(spark, tmp_path):
    path, tables = str(tmp_path / "c"), micro.catalog(spark)
    tables["artist"].limit(1).write.parquet(f"{path}/artist")
    os.remove(f"{path}/artist/_SUCCESS")
    import_catalog(tables, path, keep_tables=["artist"])
    assert load_catalog(spark, path, keep_tables=["artist"])["artist"].count() == 3


def test_json_round_trip(spark):
    docs = artist_docs(micro.catalog(spark))
    lines = encode_json(docs)
    assert '"overview":null' in lines.first().json
    again = decode_json(lines, ARTIST_DOC, strict=True)
    assert sorted(map(str, again.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    odd = spark.createDataFrame([('{"id": "q", "what": 1}',), ("nonsense",)], "json string")
    assert [r.id for r in decode_json(odd, ARTIST_DOC).collect()] == ["q", None]
    with pytest.raises(Exception):
        decode_json(odd, ARTIST_DOC, strict=True).collect()


def test_store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), "id string, title string")

    def docs(*rows):
        return spark.createDataFrame(list(rows), "id string, title string")

    def ids(*rows):
        return spark.createDataFrame([(r,) for r in rows], "id string")

    def held():
        return {(r.id, r.title) for r in store.current().collect()}

    store.write_base(docs(("a", "1"), ("b", "1"), ("c", "1")))
    store.write_delta(docs(("b", "2"), ("d", "2")), ids("c"), 1)
    store.write_delta(docs(("c", "3")), ids("d"), 2)
    expected = {("a", "1"), ("b", "2"), ("c", "3")}
    assert held() == expected
    store.write_delta(docs(("c", "3")), ids("d"), 2)  # the same batch again
    assert held() == expected
    store.compact(2)
    assert held() == expected
    store.write_delta(docs(("e", "4")), ids("a"), 3)
    assert held() == {("b", "2"), ("c", "3"), ("e", "4")}


def test_years_of_five_digits(spark):
    rows = [(12345, 6, 7), (9999, 12, 31), (32768, 1, 1), (2021, 2, 30)]
    got = evaluate(spark, rows, "y int, m int, d int", S.date_text(S.full_date(F.col("y"), F.col("m"), F.col("d"))))
    assert got == [("12345-06-07",), ("9999-12-31",), (None,), (None,)]
