import random

import micro
import pytest
from pyspark.sql import functions as F

from sleevenotes.operators import lookup as L
from sleevenotes.operators import search as Q
from sleevenotes.operators.album import album_docs
from sleevenotes.operators.artist import artist_docs
from sleevenotes.plans.entity import ALBUM, ARTIST


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def documents(spark, *names):
    rows = [(n, n, [], (None, None)) for n in names]
    return spark.createDataFrame(rows, "id string, name string, more array<string>, rating struct<Count: int, Value: double>")


def found(spark, names, query, limit=10):
    docs = documents(spark, *names)
    queries = spark.createDataFrame([(1, query)], "query_id int, query string")
    hits = Q.search_batch(Q.index_of(Q.postings(docs, ("name", "more")), docs), queries, limit)
    return [r.doc_id for r in hits.orderBy("rank").collect()]


def test_ranking(spark):
    names = ["Joy", "Joy Divisiom", "Division Joy", "Joy Division", "Other"]
    assert found(spark, names, "joy division") == ["Joy Division", "Division Joy", "Joy Divisiom", "Joy"]
    assert found(spark, names, "joy division", limit=2) == ["Joy Division", "Division Joy"]
    assert found(spark, ["a b x c", "a c", "c a"], "a c") == ["a c", "c a", "a b x c"]
    assert found(spark, names, "???") == []


def test_stored_index(spark, tmp_path):
    docs = documents(spark, "Joy", "Joy Division", "Division Joy")
    Q.write_index(docs, ("name", "more"), ("rating.Value",), str(tmp_path / "i"))
    stored = Q.read_index(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(1, "joy division")], "query_id int, query string")
    hits = Q.search_batch(stored, queries).orderBy("rank").collect()
    assert [(r.doc_id, r.proximity) for r in hits] == [("Joy Division", 1), ("Division Joy", 2), ("Joy", 8)]


def test_similar_tokens_are_all_found(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(250)} | {"x" * 3000, "x" * 3001}
    words = sorted(words)
    terms = sorted(rng.sample(words, 60) + ["x" * 2999])
    budget = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms}
    short = {(t, w): distance(t, w) for t in terms for w in words if len(t) < 99 and abs(len(t) - len(w)) <= 2 and len(w) < 99}
    expected = {(t, w, d) for (t, w), d in short.items() if d <= budget[t]}
    expected |= {(t, w, abs(len(t) - len(w))) for t in terms for w in words if len(t) > 99 and len(w) > 99}
    frame = Q.similar_tokens(
        spark.createDataFrame([(t,) for t in terms], "term string").distinct(),
        spark.createDataFrame([(w,) for w in words], "token string"),
    )
    assert {tuple(r) for r in frame.select("term", "token", "typo").collect()} == expected


def word_texts(rng, n):
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "ambre", "birches"]
    return [" ".join(rng.choices(words, weights=[9, 8, 7, 5, 3, 2, 1, 1], k=rng.randint(1, 9))) for _ in range(n)]


def plain_search(docs, query, limit):
    """All measures of all documents, sorted."""
    terms = list(dict.fromkeys(query.split()))
    budget = [0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms]
    out = []
    for doc_id, fields, rating in docs:
        places = []
        for t, b in zip(terms, budget):
            places.append([(distance(t, w), rank, item, pos) for rank, texts in enumerate(fields, 1)
                           for item, text in enumerate(texts) for pos, w in enumerate(text.split()) if distance(t, w) <= b])
        found = [p for p in places if p]
        if not found:
            continue
        proximity = 0
        for left, right in zip(places, places[1:]):
            apart = [q[3] - p[3] if q[3] > p[3] else p[3] - q[3] + 1 for p in left for q in right if p[1:3] == q[1:3] and p[3] != q[3]]
            proximity += min([8, *apart])
        typo = [min(p)[0] for p in found]
        key = (-len(found), sum(typo), proximity, min(x[1] for p in found for x in p), -typo.count(0))
        out.append((key, rating is None, -(rating or 0), doc_id))
    return [(k + 1, d, *(abs(x) for x in key)) for k, (key, *_, d) in enumerate(sorted(out)[:limit])]


def test_the_cut_changes_nothing_and_drops_most(spark, tmp_path):
    rng = random.Random(11)
    docs = [(f"d{k:04d}", ([t], word_texts(rng, rng.randint(0, 2))), rng.choice([None, 1.0, 2.0]))
            for k, t in enumerate(word_texts(rng, 500))]
    frame = spark.createDataFrame(
        [(i, f[0][0], f[1], (1, r)) for i, f, r in docs],
        "id string, name string, more array<string>, rating struct<Count: int, Value: double>",
    )
    Q.write_index(frame, ("name", "more"), ("rating.Value",), str(tmp_path / "cut"))
    stored = Q.read_index(spark, str(tmp_path / "cut"))
    texts = ["amber", "amber birch", "birch amber cedar", "fjord ember delta amber", "zzz", "amber zzz birch", "amber amber", "abmer birch"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    hits = Q.search_batch(stored, queries, 7).collect()
    for k, text in enumerate(texts):
        got = sorted((r.rank, r.doc_id, r.words, r.typo, r.proximity, r.attribute, r.exactness) for r in hits if r.query_id == k)
        assert got == plain_search(docs, text, 7), text
    found = Q.measures(Q.matched_terms(stored, queries), stored.holders)
    left = Q.candidates(found, 7)
    all_, kept = ({r.query_id: r["count"] for r in f.groupBy("query_id").count().collect()} for f in (found, left))
    assert kept[3] < all_[3] / 4 and kept[2] < all_[2] and all(kept[q] >= min(7, all_[q]) for q in all_)
    terms = queries.selectExpr("query as term").distinct()
    cut = Q.similar_tokens(terms, stored.holders.select("token").distinct())
    assert set(map(tuple, Q.similar_tokens(terms, None, stored.typos, stored.pieces).collect())) == set(map(tuple, cut.collect()))


def test_nested_fields_and_parts(spark):
    cat = micro.catalog(spark)
    albums = album_docs(cat)
    index = Q.postings(albums, ALBUM.searchable)
    assert {r.token for r in index.filter("attr_rank = 3 and doc_id = 'g10'").collect()} == {"joy", "division", "new", "order"}
    artists = artist_docs(cat)
    queries = spark.createDataFrame([(1, "joy")], "query_id int, query string")
    hits = Q.search_all(Q.index_of(Q.postings(artists, ARTIST.searchable), artists), Q.index_of(index, albums), queries)
    rows = Q.items(hits, artists, albums).orderBy("position").collect()
    assert [(r.score, r.artist and r.artist.id, r.album and r.album.id) for r in rows] == [(1, "a1", None), (1, None, "g10")]


def test_lookups(spark):
    cat = micro.catalog(spark)
    albums, artists = album_docs(cat), artist_docs(cat)

    def ids(docs):
        return [r.id for r in docs.collect()]

    assert ids(L.by_id(artists, "a2")) == ["a2"] and ids(L.by_id(artists, "nope")) == []
    assert ids(L.by_ids(albums, spark.createDataFrame([("g11",), ("q",)], "id string"))) == ["g11"]
    assert ids(L.by_recordings(albums, spark.createDataFrame([("c1",), ("c9",)], "recordingid string"))) == ["g10"]
    assert ids(L.filter_by(artists, ARTIST.filterable, genres="Hip-Hop", status="ended")) == ["a1"]
    assert ids(L.filter_by(albums, ALBUM.filterable, artistids="a1", type="Album")) == ["g10"]
    assert ids(L.sort_by(artists, "rating.Value")) == ["a1", "a2", "a3"]
    with pytest.raises(ValueError):
        L.filter_by(artists, ARTIST.filterable, overview="x")
    assert "Tracks" not in str(L.without_tracks(albums).schema["Releases"].dataType)
    assert albums.select(F.explode("Releases.Tracks")).count() == 2
