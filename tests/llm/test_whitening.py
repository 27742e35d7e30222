import math
import random

import numpy as np
import pytest

from catalogspark.llm import whitening as wh


def dense(rows):
    """What the contract asks for, by one dense eigenvalue problem: n, x, deviations, eigenvalues, whitened, shares."""
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    v = (z / n).T @ (z / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum(int(c) ** 2 for c in r) for r in z], e, (z / n) @ u / np.sqrt(np.abs(e)), e / np.trace(v)


def check(got, rows, ids, k):
    n, deviation, e, whitened, share = dense(rows)
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for at, i in enumerate(ids):
        for c in range(1, k + 1):
            r = by[i][c]
            assert (r.n, r.deviation) == (n, deviation[at])
            assert r.explained == pytest.approx(share[c - 1], rel=1e-12) and r.identity_error < 1e-9
            if abs(whitened[at, c - 1]) > 1e-3:
                sign = signs.setdefault(c, math.copysign(1, r.whitened * whitened[at, c - 1]))
                assert r.whitened == pytest.approx(sign * whitened[at, c - 1], abs=1e-8)


def test_given_vectors_against_a_dense_eigenvalue_problem(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    check(wh.whiten(df).collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 32)


def test_clustered_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    for d, k, e in ((300, 8, rng.random(300) * 50 + 1), (200, 6, np.concatenate([[100, 90, 80, 70, 60, 50], rng.random(194) * 10])), (120, 10, np.concatenate([[9, 9, 9, 8, 8], rng.random(115) * 7])), (40, 32, np.concatenate([rng.random(7) + 1, np.zeros(33)])), (1, 32, np.ones(1))):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        passes = []

        def product(c, v=v, passes=passes):
            passes.append(c.shape[1])
            return v @ c

        values, u = wh.jacobi_davidson(product, d, k)
        true = np.sort(e)[::-1][:k]
        assert np.abs(values - true).max() < 1e-13 * true[0]
        assert np.linalg.norm(v @ u - u * values, axis=0).max() < 16 * d * wh.EPS * true[0]
        assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-13
        assert max(passes) <= k + wh.GUARD  # never as many columns as dimensions


def test_inner_steps_solve_the_correction_equations():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    assert np.abs(wh.minres(lambda z: a @ z, b, 60, 1e-13) - np.linalg.solve(a, b)).max() < 1e-8
    assert not wh.minres(lambda z: a @ z, np.zeros((30, 2)), 5, 0.1).any()


def test_without_inner_steps_more_passes_are_needed(monkeypatch):
    rng = np.random.default_rng(3)
    e = np.sort(rng.random(200) * 50)[::-1]
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    v = (q * e) @ q.T

    def rounds(steps):
        monkeypatch.setattr(wh, "INNER", steps)
        seen = []
        wh.jacobi_davidson(lambda c: (seen.append(1), v @ c)[1], 200, 6)
        return len(seen) / (steps + 1)  # outer rounds

    assert rounds(8) < 0.5 * rounds(1)


def test_odd_rows(spark):
    rnd = random.Random(5)
    good = [[rnd.gauss(0, 1 + j) for j in range(5)] for _ in range(40)]
    good[7] = good[3]
    rows = [(i, v) for i, v in enumerate(good)] + [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [math.inf, 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1.0] * 6), (None, good[0]), (3, good[1])]
    df = spark.createDataFrame([(*r, "a", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, x string, component int, v double").repartition(3)
    got = wh.whiten(df).collect()
    kept = [*good, good[0], good[1]]
    n, deviation, e, whitened, share = dense(kept)
    assert len(got) == len(kept) * 5 and {r.n for r in got} == {n}
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(40)) and sum(r.vec_id is None for r in got) == 5
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    arrays = wh.whitened_vectors(df).collect()
    assert len(arrays) == n and np.abs(np.cov(np.array([r.vector for r in arrays]).T, bias=True) - np.eye(5)).max() < 1e-10


def test_tables_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        assert wh.whiten(spark.createDataFrame(rows, schema)).collect() == []
    rank_one = wh.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in rank_one} == {1} and rank_one[0].explained == pytest.approx(1)


def test_entries_beyond_64_bits_stop_the_job(spark):
    with pytest.raises(Exception, match="64"):
        wh.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()
