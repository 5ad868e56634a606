"""Near-duplicates against all pairs, chat repair against all repairs, and the learned operators on held-out rows."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from cases import DOCS, LONG, no_documents, odd_documents, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sleevenotes.llm import chat_repair, cotraining, language_crf, queries, simhash

SF = "/root/testdata/sf0.001"


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in (text or "").translate(table)).split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(points, bits=3):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def random_points(n, seed):
    """Random fingerprints, some in chains and clusters of few changed bits."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 2**64, n // 2, dtype=np.uint64)
    near = points[rng.integers(0, n // 20, n - n // 2)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)) * rng.integers(0, 2, len(near), dtype=np.uint64)
    return np.unique(np.concatenate([points, near]))


def test_fingerprints(spark):
    docs = odd_documents(spark)
    out = simhash.fingerprints(docs).select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("f")).collect()
    want = sorted(f"{plain_fingerprint(r.text):016x}" for r in docs.collect())
    assert sorted(r.f for r in out) == want and "0" * 16 in want


@given(st.lists(st.integers(0, 9), max_size=12))
@settings(max_examples=50, deadline=None)
def test_majority_in_pieces(sizes):
    rng = np.random.default_rng(len(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    values = rng.integers(0, 2**64, bounds[-1], dtype=np.uint64)
    old, simhash.HASHES_AT_ONCE = simhash.HASHES_AT_ONCE, 5
    got = simhash.majority_bits(values, bounds).tolist()
    simhash.HASHES_AT_ONCE = old
    want = [sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in values[i:j]) > j - i) for i, j in zip(bounds[:-1], bounds[1:])]
    assert got == want


def test_every_near_pair_meets_in_a_leaf():
    points = random_points(3_000, 1)
    trees = [simhash.fit_tree(simhash.halves(points[::3], side), 0.02) for side in (0, 1)]
    meet = set()
    for side, tree in enumerate(trees):
        assert tree.leaf.max() > 20
        rows, leaves = tree.route(simhash.halves(points, side))
        for leaf in np.unique(leaves):
            own = np.sort(rows[leaves == leaf])
            near = np.bitwise_count(points[own][:, None] ^ points[own][None, :]) <= 3
            meet |= {(int(own[i]), int(own[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    assert meet == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))} and len(meet) > 100


@pytest.mark.parametrize("seed", [2, 3])
def test_components_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 200)
    points = random_points(2_500, seed)
    distinct = spark.createDataFrame([(int(p), k) for k, p in enumerate(points.view(np.int64))], "fingerprint long, label long")
    from sleevenotes.sources.work import shared_folder, written

    folder = shared_folder(spark)
    groups = written(simhash.linked_groups(distinct, len(points)), folder)
    assert groups.groupBy("group").count().agg(F.max("count")).first()[0] <= simhash.GROUP
    spread = {r.fingerprint: r.label for r in simhash.spread_labels(groups, distinct, folder).collect()}
    got = [spread.get(int(p), k) for k, p in enumerate(points.view(np.int64))]
    assert got == plain_components(points)


@pytest.mark.parametrize("seed", [4, 5])
def test_components_of_a_shard_that_is_split_again(seed, monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 32)
    points = random_points(2_000, seed)
    close = [simhash.shard_components(points, simhash.halves(points, side), 3) for side in (0, 1)]
    parent = list(range(len(points)))  # both halves together give all links
    for root in close:
        for k, r in enumerate(root.tolist()):
            a, b = k, r
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    for k in range(len(parent)):
        while parent[parent[k]] != parent[k]:
            parent[k] = parent[parent[k]]
    assert parent == plain_components(points)


def test_groups_keep_members_connected(monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 3)
    groups = simhash.grouped_members(np.arange(29))
    assert max(map(len, groups)) == 3
    reached, todo = {0}, True
    while todo:
        todo = [g for g in groups if reached & set(g.tolist()) and not set(g.tolist()) <= reached]
        for g in todo:
            reached |= set(g.tolist())
    assert reached == set(range(29))


def test_one_of_each(spark):
    docs = odd_documents(spark)
    out = simhash.one_of_each(docs)
    assert out.schema == DOCS
    rows = docs.collect()
    points = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is None, rows[k].doc_id or 0))
    component = plain_components(points[order])
    want = sorted((rows[order[k]].doc_id is None, rows[order[k]].doc_id or 0) for k in set(component))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == want
    assert simhash.one_of_each(no_documents(spark)).count() == 0
    found = simhash.components(docs).groupBy("fingerprint").agg(F.count_distinct("label").alias("n")).filter("n > 1")
    assert found.isEmpty()


# -- chat repair -------------------------------------------------------------------------------------------------------


def least_cost(roles):
    best = chat_repair.NEVER
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and a != b for m, a, b in zip(merged, labels, labels[1:])):
                continue
            cost = sum(map(chat_repair.relabel_cost, roles, labels)) + chat_repair.MERGE * sum(merged)
            seq = [labels[0], *(b for m, b in zip(merged, labels[1:]) if not m)]
            body = seq[1:] if seq[0] == 1 else seq
            if 1 in body:
                continue
            missing, wanted = 0, 2
            for role in body:
                if role != wanted:
                    missing, wanted = missing + 1, 5 - wanted
                wanted = 5 - wanted
            missing += wanted == 3 or not body
            missing += not body
            best = min(best, cost + chat_repair.INSERT * missing)
    return best


def test_least_cost_in_blocks():
    random.seed(1)
    for _ in range(150):
        roles = [random.choice((0, 1, 2, 3)) for _ in range(random.randint(1, 6))]
        blocks = [chat_repair.transfer(roles[i : i + 2]) for i in range(0, len(roles), 2)]
        assert chat_repair.best_states(blocks)[0] == chat_repair.best_states([chat_repair.transfer(roles)])[0] == least_cost(roles)


@pytest.mark.parametrize("block", [256, 3])
def test_repaired(spark, block, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    random.seed(2)
    roles = ["user", "assistant", "system", "tool", None, " User ", "ASSISTANT"]
    rows = [(c, t, random.choice(roles), f"text {c} {t}") for c in range(25) for t in range(random.randint(1, 12))]
    rows += [(90, None, "user", "a"), (90, None, "user", "b"), (90, 1, "user", None), (None, 0, "user", "x"), (91, 5, "user", "x"), (91, 5, "user", "x"), (92, 0, "system", "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    out = pd.DataFrame([r.asDict() for r in chat_repair.repaired(frame).collect()]).sort_values(["block", "place"])
    for conv, own in out.groupby("conv_id", dropna=False):
        conv = None if pd.isna(conv) else int(conv)
        given = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        text = "".join(own.segment)
        names = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
        body = names[1:] if names[0] == "system" else names
        assert body == ["user", "assistant"] * (len(body) // 2) and body, text
        assert text.endswith("<|end|>") and text.count("<|end|>") == len(names)
        assert sum(own.action != "insert") == len(given)
        if conv is not None and conv < 25:
            numbers = [chat_repair.role_number(r[2]) for r in given]
            assert set(own.cost) == {chat_repair.best_states([chat_repair.transfer(numbers)])[0]}
            spent = {"insert": chat_repair.INSERT, "merge": chat_repair.MERGE}
            paid = sum(spent.get(p, 0) for a in own.action for p in a.split("+"))
            place = {t: chat_repair.role_number(r) for _, t, r, _ in given}
            paid += sum(chat_repair.relabel_cost(place[int(r.turn)], chat_repair.role_number(r.role)) for r in own.itertuples() if "relabel" in r.action)
            assert {paid} == set(own.cost)
            assert [f"text {conv} {t}" in text for t in range(len(given))] == [True] * len(given)
    assert chat_repair.repaired(frame.limit(0)).count() == 0


def test_blocks_of_equal_turns_and_of_rows_without_conversation_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK", 8)
    rows = [(None, k % 3, "user", f"text {k}") for k in range(100)] + [(1, 5, "user", "equal")] * 50
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = [r for r in chat_repair.repaired(frame).collect() if r.action != "insert"]
    sizes = Counter((r.conv_id, r.block) for r in out)
    assert len(out) == 150 and max(sizes.values()) <= 8
    for conv, n in ((None, 100), (1, 50)):
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: (r.block, r.place))
        assert len(own) == n and [r.turn for r in own] == sorted(r.turn for r in own)
        assert {r.cost for r in own} == {chat_repair.best_states([chat_repair.transfer([chat_repair.USER] * n)])[0]}


# -- language ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    return language_crf.fit(docs.filter(language_crf.learned_from(F.col("doc_id"))))


def test_language_of_held_out_documents(spark, model):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").filter(~language_crf.learned_from(F.col("doc_id")))
    right = language_crf.predicted(docs, model).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_a_language_of_long_documents_only_is_learned(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    times = F.when(F.col("lang") == "de", (language_crf.SAMPLE_CHARS / F.length("text")).cast("int") + 2).otherwise(1)
    long = docs.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), times))
    hot = long.filter("lang = 'en'").orderBy("doc_id").limit(1)
    copies = hot.join(spark.range(2_000).select(F.lit(1).alias("one")), F.lit(True)).select(*docs.columns)
    learned = language_crf.learned_from(F.col("doc_id"))
    model = language_crf.fit(long.filter(learned).unionByName(copies))
    held_out = language_crf.predicted(long.filter(~learned), model).select("lang", (F.col("lang") == F.col("lang_pred")).alias("right"))
    found = {r.lang: r.share for r in held_out.groupBy("lang").agg(F.avg(F.col("right").cast("int")).alias("share")).collect()}
    assert found["de"] > 0.95 and found["en"] > 0.95


def test_language_of_words_in_switched_text(spark, model):
    rows = duckdb.sql(f"select lang, text from '{SF}/documents.parquet' where length(text) between 600 and 3000").fetchall()
    by = {lang: [w for x, t in rows if x == lang for w in t.split()][:400] for lang in ("en", "fr", "de")}
    want, parts = [], []
    for k in range(0, 360, 30):
        lang = ("en", "fr", "de")[k // 30 % 3]
        parts += by[lang][k : k + 30]
        want += [lang] * 30
    row = language_crf.predicted(texts(spark, [(1, " ".join(parts))]), model, with_words=True).first()
    bounds = np.cumsum([len([x for x in "".join(c if c.isalpha() else " " for c in w).split()]) for w in parts])
    got = [row.word_langs[b - 1] for b in bounds]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.9


def test_odd_texts_and_languages(spark, model):
    docs = odd_documents(spark)
    out = language_crf.predicted(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    rows = out.select("doc_id", "text", "lang_pred", out.columns.index("score") and F.lit(1)).collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_crf.predicted(no_documents(spark), model).count() == 0
    kept = language_crf.identified(docs, model, 0.3)
    assert kept.schema == DOCS and kept.count() == sum(r.lang_pred != "und" for r in rows)
    nothing = language_crf.fit(no_documents(spark))
    assert {tuple(r) for r in language_crf.predicted(texts(spark, [(1, "word"), (2, None)]), nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
    one = language_crf.fit(docs.filter("lang = 'fr'"))
    assert language_crf.predicted(texts(spark, [(1, "word")]), one).first().lang_pred == "fr"


# -- co-training -----------------------------------------------------------------------------------------------------------


def test_cotraining_on_documents_it_has_not_learned_from(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").limit(4_000), spark.read.parquet(f"{sf}/labels.parquet")
    model = cotraining.fit(docs, labels, sample=2_000)
    out = cotraining.scored(docs, model).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3_000)
    views = [rng.normal(size=(3_000, 12)) + y[:, None] * gap for gap in (0.6, 0.6)]
    labels = np.where(np.arange(3_000) < 60, y, -1)
    spare = (np.arange(3_000) < 60) & (np.arange(3_000) % 3 == 0)
    right = lambda m: ((m.score(*views)[0] >= 0.5) == y)[60:].mean()
    alone, cotraining.ROUNDS = cotraining.ROUNDS, 0
    before = right(cotraining.co_train(*views, labels, spare))
    cotraining.ROUNDS = alone
    assert right(cotraining.co_train(*views, labels, spare)) > before > 0.7


def test_cotraining_with_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = cotraining.scored(docs, cotraining.fit(docs, labels)).collect()
    assert len(out) == docs.count() and {(r.score, r.kept) for r in out} == {(0.5, True)}
    assert cotraining.scored(no_documents(spark), cotraining.fit(no_documents(spark), labels)).count() == 0
    bare = texts(spark, [(1, None), (2, LONG), (3, prose(1))])
    assert cotraining.scored(bare, cotraining.fit(bare, labels)).count() == 3


def test_cotraining_learns_from_few_labels_among_many_documents(spark, monkeypatch):
    docs = spark.range(3_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a tidy text of words', '#$ %% @@ !!') as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(1 - id % 2 as int) as quality")
    seen, co_train = [], cotraining.co_train
    monkeypatch.setattr(cotraining, "co_train", lambda *a: seen.append(a[2]) or co_train(*a))
    model = cotraining.fit(docs, labels, sample=100)
    assert (seen[0] == 1).sum() == (seen[0] == 0).sum() == 20 and 50 < (seen[0] < 0).sum() < 200
    assert {(r.doc_id % 2, r.kept) for r in cotraining.scored(docs, model).collect()} == {(0, True), (1, False)}


def test_cotraining_with_a_labelled_id_on_many_rows(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 2 = 0, concat('a tidy text of words ', id), '#$ %% @@ !!') as text")
    again = spark.range(500).selectExpr("0L as doc_id", "concat('a tidy text of words, ', id) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(1 - id % 2 as int) as quality")
    seen, co_train = [], cotraining.co_train
    monkeypatch.setattr(cotraining, "co_train", lambda *a: seen.append(a[2]) or co_train(*a))
    model = cotraining.fit(docs.unionAll(again), labels, sample=100)
    assert (seen[0] == 1).sum() == (seen[0] == 0).sum() == 20
    assert {(r.doc_id % 2, r.kept) for r in cotraining.scored(docs, model).collect()} == {(0, True), (1, False)}
