"""Whitening against numpy's eigenvectors, and its factorisations by themselves."""

import math

import numpy as np
import pytest

from claimgeo.llm import whitening

from ..conftest import SF001

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, k=4):
    """Per ``(id, x)`` of the rows kept: n, deviation, whitened values (up to the sign), explained shares."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}), dtype=float)
    n, s = len(fit), [sum(col) for col in zip(*sorted({x for _, x in kept}))]
    v = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        out[i, x] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - fit.mean(0)) @ u / np.sqrt(e), e / v.trace())
    return out


def check(df, rows, k=4):
    want = plain(rows, k)
    have = {}
    for r in df.collect():
        have.setdefault(r.vec_id, []).append(r)
    assert set(have) == {i for i, _ in want}
    signs = None
    for (i, _), (n, dev, w, share) in sorted(want.items(), key=str):
        mine = sorted(have[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in mine} == {(n, dev)}
        got = np.array([r.whitened for r in mine])
        if signs is None and np.abs(w).min() > 1e-3:
            signs = np.sign(got * w)
        if signs is not None:
            assert np.allclose(got, signs * w, rtol=1e-6, atol=1e-6)
        assert np.allclose([r.explained for r in mine], share, rtol=1e-9)
        assert len({r.identity_error for r in mine}) == 1 and mine[0].identity_error < 1e-9
    assert signs is not None


def test_query_table_against_numpy(spark):
    t = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    df = whitening.whiten(t)
    assert df.columns == COLUMNS and df.count() == 4 * len(rows)
    check(df, rows)


def test_nulls_repeats_other_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (i % 5 + 1)]) for i in range(80)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]                     # a third of the rows is one vector
    bad = [(300, None), (301, rows[0][1][:5] + [None]), (302, rows[0][1][:5] + [math.nan]),
           (303, [math.inf] + rows[0][1][:5]), (304, []), (305, [1.0, 2.0]), (306, [1e30] * 6), (307, [None] * 6)]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5).selectExpr(
        "*", "1 AS id", "2 AS x", "3 AS d", "'v' AS name", "4 AS at", "5 AS component", "6 AS `a.b`")
    df = whitening.whiten(t)
    assert df.columns == COLUMNS
    check(df, rows)


def test_null_ids_keep_their_rows(spark):
    t = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 2.5]), (1, [0.0, 0.5]), (1, [0.0, 0.5])], "vec_id long, embedding array<float>")
    out = whitening.whiten(t).collect()
    assert sum(r.vec_id is None for r in out) == 4 and sum(r.vec_id == 1 for r in out) == 4
    assert {r.n for r in out} == {3}


def test_no_rows_no_spread_and_few_directions(spark):
    ddl = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whitening.whiten(spark.createDataFrame(rows, ddl))
        assert out.columns == COLUMNS and out.count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], ddl)
    out = whitening.whiten(line).collect()
    assert {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)


def test_sums_beyond_a_long_and_exact_deviations(spark):
    big = float(2 ** 54)
    t = spark.createDataFrame([(1, [big, 0.0]), (2, [0.0, 1.0]), (3, [-big, 3.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(t).filter("vec_id <> 2").collect()} == {None}
    rows = [(1, [3e6, 1.0]), (2, [0.0, 1.25]), (3, [1.0, 2.0])]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, k=2)


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (7, 7), (7, 3), (33, 33), (64, 10)])
def test_factors_and_rotations(d, rank):
    rng = np.random.default_rng(d + rank)
    half = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
    a = half @ half.T
    l, order = whitening.pivoted_cholesky(a)
    assert np.allclose(l @ l.T, a[np.ix_(order, order)], atol=1e-9 * np.abs(a).max())
    assert np.allclose(np.triu(l[:l.shape[1]], 1), 0)
    g = whitening.one_sided_jacobi(l)
    gram = g.T @ g
    assert np.allclose(g @ g.T, l @ l.T, atol=1e-9 * np.abs(a).max())
    assert np.abs(gram - np.diag(gram.diagonal())).max() < 1e-10 * gram.max()
    e, u = whitening.components(a)
    assert np.allclose(e[:rank], np.linalg.eigvalsh(a)[::-1][:len(e[:rank])], rtol=1e-7, atol=1e-12 * e[0])
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-8)


def test_packing_is_canonical():
    for x in ([], [0], [-128, 127], [128], [-(2 ** 31), 2 ** 31 - 1], [2 ** 62, -1]):
        raw = whitening.pack(np.array(x, dtype=np.int64))
        assert whitening.unpack(raw).tolist() == x
