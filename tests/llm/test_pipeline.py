"""The registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import os
import sys

import duckdb
import numpy as np
import pytest
from cases import DOCS, no_documents, odd_documents
from test_learned import near_set, plain_components, plain_fingerprint
from test_rows import plain_contained, plain_quality
from test_tokens import check_places, crc, plain

import __spark_entry__ as registered
import corpus_pipeline
from sleevenotes.llm import queries

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


def test_all_are_registered():
    names = registered.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(registered.oracle_sql()) & set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    relation = duck.sql(queries.ORACLE_SQL[name])
    kinds = {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    assert kinds == {c: str(t) for c, t in zip(relation.columns, relation.types)}
    order = [relation.columns.index(c) for c in df.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=key)


def test_packing_and_files_of_whole_tables(spark):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = queries.op1_best_fit_packing(spark, SF).collect()
    for r in pieces:
        assert r.ids_crc32 == crc(docs[r.doc_id][r.start : r.start + r.length])
    assert sum(r.length for r in pieces) == sum(map(len, docs.values()))
    assert check_places(pieces, 1024) <= -(-sum(map(len, docs.values())) // 1024) + 1
    at = 0
    for r in sorted(queries.op5_token_files(spark, SF).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(docs[r.doc_id]), crc(docs[r.doc_id]))
        at += r.n_tokens


def plain_near_duplicates(rows):
    rows = sorted(rows, key=lambda r: r.doc_id)
    root = plain_components(np.array([plain_fingerprint(r.text) for r in rows], np.uint64))
    return {rows[k].doc_id: rows[r].doc_id for k, r in enumerate(root)}


def plain_near_copies(rows):
    """Smallest id of each group whose members are linked by a similarity of 0.8 or more."""
    rows = sorted(rows, key=lambda r: r.doc_id)
    sets, root = [near_set(r.text) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 180 * len(a & b) >= 80 * (len(a) + len(b)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {rows[k].doc_id: rows[r].doc_id for k, r in enumerate(root)}


def test_near_duplicates_of_whole_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: r.component_id for r in queries.op6_simhash_near_dedup(spark, SF).collect()}
    assert out == plain_near_duplicates(rows)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        left = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}
            want = {r[0] for r in plain_quality(list(before.values()), trusted) if r[8]}
        elif name == "language_id":
            want = {d for d, r in before.items() if any(c.isalpha() for c in r.text)}
        elif name == "simhash_near_dedup":
            gone, near = set(before) - left, plain_near_copies(before.values())
            must = {d for d, first in near.items() if d != first}
            assert gone <= must and len(gone) >= 0.9 * len(must) > 0
            want = left
        else:
            want = {r[0] for r in plain_contained([(d, r.text) for d, r in before.items()], bench) if not r[5]}
        assert left == want, name
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == left and check_places(pieces, 1024)
    assert sum(r.length for r in pieces) == sum(len(plain(before[d].text)) for d in left)
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_take_odd_rows(spark, tmp_path, make):
    docs = make(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "best_fit_packing" or docs.schema == DOCS


def test_nothing_outside_imports_the_package():
    code = "import sys; sys.path.insert(0, %r); import sleevenotes.plans.entity, sleevenotes.streaming.feed; print('sleevenotes.llm' in sys.modules)"
    import subprocess

    out = subprocess.run([sys.executable, "-c", code % os.path.dirname(registered.__file__)], capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "False"
