"""Documents that no query can tell apart are measured once; the hits are those of measuring all."""

import random

from test_search import plain_search, word_texts

from sleevenotes.operators import search as Q

TEXTS = ["amber birch", "birch amber cedar", "zzz", "abmer birch", "ember"]


def test_alike_documents_are_measured_once(spark, monkeypatch):
    rng = random.Random(23)
    kinds = [([t], word_texts(rng, k % 3)) for k, t in enumerate(word_texts(rng, 6))]
    docs = []
    for k in range(240):
        name, more = kinds[k % len(kinds)]
        more = [*more, *more[:1]] if k % 2 else more  # a value twice, and a word that no query reads in front of it
        docs.append((f"d{k:04d}", ([f"own{k} {name[0]}"], [f"other{k}", *more]), rng.choice([None, 1.0, 2.0])))
    frame = spark.createDataFrame(
        [(i, f[0][0], f[1], (1, r)) for i, f, r in docs],
        "id string, name string, more array<string>, rating struct<Count: int, Value: double>",
    )
    measured, plain = [], Q.measures
    monkeypatch.setattr(Q, "measures", lambda m, h: measured.append(h.select("doc_id").distinct().count()) or plain(m, h))
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, query string")
    hits = Q.search_batch(Q.index_of(Q.postings(frame, ("name", "more")), frame), queries, 7).collect()
    for k, text in enumerate(TEXTS):
        got = sorted((r.rank, r.doc_id, r.words, r.typo, r.proximity, r.attribute, r.exactness) for r in hits if r.query_id == k)
        assert got == plain_search(docs, text, 7), text
    assert measured and max(measured) <= len(kinds)
