"""Operators within rows: quality rules, licence notices, URL rules; and contained passages. Against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from cases import DOCS, no_documents, odd_documents, prose, texts
from pyspark.sql import functions as F

from sleevenotes.llm import decontaminate, licences, quality_rules, url_rules
from sleevenotes.llm.licence_sql import LICENCE_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# -- quality rules ---------------------------------------------------------------------------------------------------


def plain_quality(rows, trusted):
    def grams(text):
        w = WORD.findall(text or "")
        for gram in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            yield zlib.crc32(gram.encode()) % quality_rules.BUCKETS

    n, t = Counter(), Counter()
    for r in rows:
        g = Counter(grams(r.text))
        n += g
        if r.doc_id in trusted:
            t += g
    share = sum(t.values()) / max(1, sum(n.values()))
    k = quality_rules.PSEUDO
    weight = {b: math.log((t[b] + k * share) / (n[b] + k) / share) if share else 0.0 for b in n}
    out = []
    for r in rows:
        text = r.text or ""
        w = WORD.findall(text)
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(triples)
        again = {i + j for i, x in enumerate(triples) if times[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        own = list(grams(text))
        score = sum(weight[b] for b in own) / len(own) if own else 0.0
        out.append(
            (r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed,
             round(score, 6), not failed and score >= quality_rules.THRESHOLD)
        )
    return out


def test_quality_is_that_of_plain_python(spark):
    docs = odd_documents(spark)
    trusted = spark.createDataFrame([(k,) for k in (0, 20, 21, 22, 23)], "doc_id long")
    q = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    out = quality_rules.judged(docs.select("doc_id", "text"), trusted).select(
        "doc_id", *q, F.round("quality.score", 6).alias("score"), "quality.kept"
    )
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(map(tuple, out.collect()), key=order)
    want = sorted(plain_quality(docs.collect(), {0, 20, 21, 22, 23}), key=order)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and g[8] == w[8] and g[7] == pytest.approx(w[7], abs=2e-6)


def test_kept_documents_keep_their_columns(spark):
    docs = odd_documents(spark)
    trusted = spark.createDataFrame([(0,), (20,)], "doc_id long")
    out = quality_rules.kept(docs, trusted)
    assert out.schema == DOCS
    assert {r.doc_id for r in out.collect()} >= {0, 1, None, 20, 27} and not {2, 3, 4, 5, 7, 9} & {r.doc_id for r in out.collect()}
    assert quality_rules.kept(no_documents(spark), trusted).count() == 0
    assert quality_rules.kept(docs, trusted.limit(0)).count() == out.count()


def test_trusted_ids_are_bounded_and_distinct(spark):
    labels = spark.createDataFrame([(k % 7, k % 2) for k in range(28)] + [(None, 1)], "doc_id long, quality int")
    ids = [r.doc_id for r in quality_rules.trusted_ids(labels, 7).collect()]
    assert sorted(ids) == list(range(7))
    many = spark.range(4_000).selectExpr("id as doc_id", "1 as quality")
    some = [r.doc_id for r in quality_rules.trusted_ids(many, 500).collect()]
    assert len(some) == len(set(some)) and 400 < len(some) < 600


def test_all_trusted_ids_count(spark):
    many = spark.range(50_000).selectExpr("id as doc_id", "1 as quality")
    assert quality_rules.trusted_ids(many).count() == 50_000
    docs = odd_documents(spark).select("doc_id", "text")
    labels = spark.createDataFrame([(k, 1) for k in (0, 1, 6, 20, 21, 22, 23, 24, 999)] * 2 + [(25, 0), (None, 1)], "doc_id int, quality int")
    whole = quality_rules.bucket_weights(docs, quality_rules.trusted_ids(labels))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert quality_rules.bucket_weights(docs, quality_rules.trusted_ids(labels)) == whole and any(whole)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_junk_inside_words_is_rejected(spark):
    rows = [(k, prose(k)) for k in range(40)]
    junk = [(100 + k, " ".join(w if len(w) < 4 else f"{w[:1]}{zlib.crc32(f'{k}{w}'.encode()):x}zq{w[-1:]}" for w in prose(k).split())) for k in range(10)]
    docs, trusted = texts(spark, rows + junk), spark.range(0, 40, 2).toDF("doc_id")
    out = {r.doc_id for r in quality_rules.kept(docs, trusted).collect()}
    assert out == set(range(40))


# -- licences ----------------------------------------------------------------------------------------------------------


def plain_notices(text):
    out = []
    for unit in (text or "").lower().split("\n"):
        a = set(licences.template_bigrams(unit))
        scores = []
        for name, t in licences.TEMPLATES.items():
            b = set(licences.template_bigrams(t))
            if a and 200 * len(a & b) >= 80 * (len(a) + len(b)):
                scores.append((-2 * len(a & b) / (len(a) + len(b)), name))
        if scores:
            out.append(min(scores)[1])
    return out


def test_notices(spark):
    lines = [*licences.TEMPLATES.values(), "released under  THE mit licence", "Released under the MIT License, friends", "Licensed under CC BY 4.0",
             "all rights", "All rights reserved", "", "x", "RELEASED under the\tMIT   License!!", prose(3)]
    rows = [(k, f"{prose(k)}\n{line}\n{PLAIN}") for k, line in enumerate(lines)] + [(99, None), (None, "\n".join(lines)), (98, "")]
    out = {r.doc_id: r for r in licences.scanned(texts(spark, rows)).collect()}
    for k, text in rows:
        want = plain_notices(text)
        assert (out[k].n_notices, out[k].licences) == (len(want), sorted(set(want))), (k, text)
    assert out[0].best_dice == 1.0 and out[99].best_dice == 0.0
    assert licences.scanned(no_documents(spark)).count() == 0
    assert licences.scanned(odd_documents(spark)).filter("n_notices > 0").count() == 0


PLAIN = "Nothing to see here."


def test_a_notice_over_several_lines(spark):
    text = "Intro\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software\nand associated documentation files.\n\nEnd"
    assert licences.scanned(texts(spark, [(1, text)])).first().licences == ["MIT-grant"]


@pytest.mark.parametrize("lines", [2, 41, 60, 400])
def test_a_notice_repeated_in_one_paragraph(spark, lines):
    text = "\n".join(["All rights reserved."] * lines)
    found = licences.scanned(texts(spark, [(1, text)])).first()
    con = duckdb.connect()
    con.execute("create table documents as select 1 as doc_id, ? as text", [text])
    sql = con.sql(LICENCE_SQL)
    want = dict(zip(sql.columns, sql.fetchall()[0]))
    assert found.n_notices == want["n_notices"] == lines + 1 and ",".join(found.licences) == want["licences"]


# -- URL rules ---------------------------------------------------------------------------------------------------------


def plain_verdict(url, rules):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(AZ), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h, p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else "allow"


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
             ("a.example.net", "/", "allow"), ("a.example.net", "/en/x", "block"), ("example.net", "/en/private/deep/", "block"), ("b.c", "/", "block"),
             ("net", "/zz", "allow")]
    hosts = ["net", "a.net", "example.net", "A.Example.NET", "x.a.example.net", "notexample.net", "example.com", "w.example.com", "org", "b.c", "ab.c",
             "z.b.c", "", "example.net.", "a..net", "example.net:80", "u@example.net", "é.net"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/en/private/deep/q", "/de/1", "/fr/1", "/zz/1", "/EN/"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#/de/")]
    urls += [None, "", "no scheme", "://", "http:/x", "a://b://c/d", "http://net\n/x", "http://net/a\nb"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules + [("net", "/", "allow"), (None, "/", "block"), ("x", None, "block")], url_rules.RULE_TYPE)
    out = url_rules.judged(pages, frame).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules), urls[r.page_id]
    assert url_rules.judged(pages.limit(0), frame).count() == 0
    assert url_rules.judged(pages, frame.limit(0)).filter("rule is null and verdict = 'allow'").count() == len(urls) + 1


# -- contained passages ------------------------------------------------------------------------------------------------


def plain_contained(rows, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = split(text), set(), set()
        for g, ids in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= ids
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def digest(found):
    n_hit = decontaminate.hit_words(F.col("spans"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit, F.size("items"), F.sha2(names, 256), n_hit > 0)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 7])
def test_contained(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = [(1, passage), (10, passage), (2, "Short one."), (3, "word"), (4, None), (5, "... !"), (6, "a a a a a a a a a a a a"), (None, "nameless item"),
             (7, "one two three four five six"), (7, "one two three four five six"), (8, "ÉCOLE du soir à neuf heures et demie pour tous les gens")]
    rows = [(1, f"x {passage} y"), (2, passage.upper().replace(" ", ", ")), (3, " ".join(passage.split()[:9])), (4, "a " * 30), (5, "short ONE short one"),
            (6, None), (7, ""), (8, "a word"), (9, "say nameless item"), (10, "one two three four five six one two three four five six"),
            (11, "École du soir à neuf heures et demie pour tous"), (12, "ÉCOLE du soir à neuf heures et demie pour tous"),
            (13, " ".join(passage.split()[1:] + passage.split()[:-1])), (1, f"x {passage} y"), (1, "other text"), (None, passage), (14, "z " * 500 + passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = digest(decontaminate.contained(texts(spark, rows), bench)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out), key=order) == sorted(plain_contained(rows, items), key=order)
    kept = decontaminate.clean(texts(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted(
        (d, t or "") for (d, t), w in zip(rows, plain_contained(rows, items)) if not w[5]
    )


def test_contained_with_empty_tables(spark):
    docs, bench = odd_documents(spark), spark.createDataFrame([(1, prose(0))], "item_id long, text string")
    assert decontaminate.contained(docs, bench.limit(0)).filter("size(items) = 0 and spans is null").count() == docs.count()
    assert decontaminate.contained(no_documents(spark), bench).count() == 0
    out = decontaminate.clean(docs, bench)
    assert out.schema == DOCS and out.count() == docs.count() - docs.filter(F.col("text").startswith("The river bends")).count()
