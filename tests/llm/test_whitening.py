"""Whitening against numpy's own eigenvectors, and the odd rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sleevenotes.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string, n int, x string, task long"


def plain(rows, k):
    """(kept ids, x, n, S, values, vectors, trace) of (id, vector) rows that all take part."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in rows])
    listed = np.unique(x, axis=0)
    centred = listed - listed.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / len(listed))
    return x, len(listed), listed.sum(0), e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def check(rows, out, k=4):
    x, n, sums, values, vectors, trace = plain(rows, k)
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(out) == len(rows) * min(k, x.shape[1]) and {r.n for r in out} == {n}
    z = (x - sums / n) @ vectors / np.sqrt(values)
    for c in range(min(k, x.shape[1])):
        own = np.array([got[i][c + 1].whitened for i, _ in rows])
        sign = np.sign(own @ z[:, c])
        assert np.allclose(own * sign, z[:, c], atol=1e-8)
        assert out[0].identity_error <= 1e-10
        assert got[rows[0][0]][c + 1].explained == pytest.approx(values[c] / trace, rel=1e-10)
    for (i, _), row in zip(rows, x, strict=True):
        assert got[i][1].deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))


def test_query_is_that_of_plain_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, queries.op12_embedding_whitening(spark, SF).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(np.float32(c)) for c in rng.normal(size=6) * [9, 5, 3, 2, 1, 1]]) for k in range(40)]
    more = [(100, good[0][1]), (101, good[0][1])]
    bad = [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [1.0] * 5 + [math.nan]), (204, [math.inf] + [0.0] * 5), (205, [1.0] * 3)]
    rows = [(*r, "c", 1, "x", 2) for r in good + more + bad]
    df = spark.createDataFrame(rows, SCHEMA).repartition(100)
    out = whitening.whitened(df).collect()
    assert out[0].n == 40 and not {r.vec_id for r in out} & set(range(200, 300))
    check(good + more, out)
    twice = whitening.whitened(df.unionAll(df)).collect()  # every id twice: the fit list is the same
    assert len(twice) == 2 * len(out) and twice[0].n == 40
    keyed = whitening.whitened(df.selectExpr("concat('k', vec_id) as `a key`", "embedding as vec"), "a key", "vec", 2)
    assert keyed.columns[0] == "a key" and {r["a key"] for r in keyed.collect()} == {f"k{r.vec_id}" for r in out}


def test_vectors_without_variance_and_without_rows(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, -0.5]), (None, [0.5, -0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(k, 1, 0, None, None) for k in (1, 2, 1, 2)]
    line = whitening.whitened(spark.createDataFrame([(k, [float(k), 0.0]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].explained == 1.0
    none = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "vec_id"


def test_large_numbers_are_exact_or_null(spark):
    rows = [(k, [1e5 * k, 3.0 + k * k % 5]) for k in range(7)]
    x, n, sums, *_ = plain(rows, 2)
    want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    far = [(k, [c[0] * 100, c[1]]) for k, c in rows]  # some beyond 64 bits
    x, n, sums, *_ = plain(far, 2)
    wide = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, map(int, sums))) for row in x]
    for given_, exact in ((rows, want), (far, wide), ([*far, (7, [1e300, 0.0])], None)):
        out = whitening.whitened(spark.createDataFrame(given_, "vec_id long, embedding array<double>")).collect()
        got = {r.vec_id: r.deviation for r in out}
        assert exact is None or [got[k] for k in range(7)] == [e if e < 2**63 else None for e in exact]
        assert any(v is None for v in got.values()) == (given_ is not rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10**6), st.sampled_from(["random", "rank", "equal", "steep"]))
def test_components_of_symmetric_matrices(m, seed, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(m, m)))
    e = {"random": rng.normal(size=m), "rank": np.r_[rng.random((m + 1) // 2), np.zeros(m // 2)],
         "equal": np.repeat([2.0, 1.0], [m // 2, m - m // 2]), "steep": 10.0 ** -np.arange(m)}[kind]
    v = q @ np.diag(e) @ q.T
    values, u = whitening.spectral_components(v)
    norm = max(1e-300, np.linalg.norm(v))
    assert np.allclose(values, np.sort(e)[::-1], atol=1e-12 * norm)
    assert np.abs(u.T @ u - np.eye(m)).max() < 1e-12 and np.abs(v @ u - u * values).max() < 1e-11 * norm
