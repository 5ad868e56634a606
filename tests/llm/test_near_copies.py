"""Near copies against brute force on planted texts."""

import functools
import random

import pytest
from cases import DOCS, no_documents, odd_documents, texts
from test_learned import near_set

from sleevenotes.llm import near_copies


@functools.cache
def shingles(text):
    return near_set(text)


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(seed, groups=30, copies=4):
    """Texts of random words, each with copies in which a few words are replaced."""
    rnd, out = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 400))]
        out.append(" ".join(words))
        for c in range(copies):
            changed = list(words)
            for k in range(max(1, round(len(words) * rnd.choice([0.002, 0.01, 0.02])))):
                changed[rnd.randrange(len(words))] = f"x{g}-{c}-{k}"
            out.append(" ".join(changed))
    rnd.shuffle(out)
    return out


def test_planted_copies_go_and_others_stay(spark):
    rows = list(enumerate(planted(1)))
    kept = {r.doc_id for r in near_copies.one_of_each(texts(spark, rows)).collect()}
    similar = {i: {j for j, b in rows if i != j and jaccard(a, b) >= 0.8} for i, a in rows}
    reachable = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = similar[todo.pop()] - seen
            seen |= new
            todo += new
        reachable[i] = min(seen)
    want = set(reachable.values())
    assert want <= kept
    assert len(kept - want) <= 0.05 * (len(rows) - len(want))


def test_many_texts_around_one_passage_stay_apart(spark):
    rnd = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(150))
    rows = [(k, passage + " " + " ".join(f"o{rnd.randrange(10**6)}" for _ in range(60))) for k in range(300)]
    assert near_copies.one_of_each(texts(spark, rows)).count() == len(rows)


def test_verified_pairs_are_similar(spark):
    rows = list(enumerate(planted(3, groups=10)))
    docs = texts(spark, rows).withColumnRenamed("doc_id", "key")
    pairs = near_copies.links(docs, docs.selectExpr("key", "key as label")).collect()
    by = dict(rows)
    assert pairs and all(r.centre != r.key and jaccard(by[r.key], by[r.centre]) >= 0.8 for r in pairs)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_rows(spark, make):
    docs = make(spark)
    out = near_copies.one_of_each(docs)
    assert out.schema == DOCS
    ids = [r.doc_id for r in out.collect()]
    if ids:
        assert len(ids) == len(set(ids)) and 1 not in ids and {0, 6, 7, 9, 40} <= set(ids)
