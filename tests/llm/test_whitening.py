"""Whitening against a plain eigen-decomposition, and the solver against hard triangles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from textsentry.llm import queries, singular, whitening


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kind", ["random", "ties", "near", "deficient", "graded", "diagonal", "zero", "one"])
def test_solver_equals_a_plain_decomposition(kind, seed):
    rng = np.random.default_rng(seed)
    turn = lambda k: np.linalg.qr(rng.standard_normal((k, k)))[0]
    made = {
        "random": lambda: rng.standard_normal((40, 40)),
        "ties": lambda: turn(12) @ np.diag([3.0] * 5 + [1.0] * 7) @ turn(12),
        "near": lambda: turn(12) @ np.diag(3 - 1e-13 * np.arange(12)) @ turn(12),
        "deficient": lambda: np.vstack([rng.standard_normal((3, 9)), np.zeros((6, 9))]),
        "graded": lambda: rng.standard_normal((20, 20)) @ np.diag(10.0 ** -np.arange(20)),
        "diagonal": lambda: np.diag([5.0, 5, 0, 7, 1, 5]),
        "zero": lambda: np.zeros((3, 3)),
        "one": lambda: rng.standard_normal((1, 1)),
    }
    a = made[kind]()
    values, v = singular.leading_directions(a, 4)
    want = np.linalg.svd(a, compute_uv=False)
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-10
    assert np.abs(a.T @ (a @ v) - v * values[: v.shape[1]] ** 2).max() <= 1e-12 * top * top


def test_small_values_keep_their_digits():
    """dqds on a bidiagonal whose values span 60 decimal orders: each is right to many digits."""
    d, e = 10.0 ** -np.arange(0, 60, 3.0), 10.0 ** -np.arange(2, 59, 3.0)
    got = singular.singular_values(d, e)
    assert math.isclose(np.prod(got[:10]) * np.prod(got[10:] / d[10:]) / np.prod(d[:10]), 1.0, rel_tol=1e-12)
    assert got[-1] > 0


def brute(vectors, k=4):
    sound = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in sound}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s).astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x.items():
        dev = np.array(v, dtype=object) * n - s
        for j in range(min(k, len(e))):
            out[i, j + 1] = (n, int((dev * dev).sum()), float((dev.astype(float) / n) @ u[:, j] / np.sqrt(e[j])), float(e[j] / e.sum()))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows, kind="float", parts=5: spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(parts)


def check(df, rows):
    got = df.collect()
    want = brute(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, dev, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev)
        assert math.isclose(r.explained, explained, rel_tol=1e-9) and r.identity_error < 1e-9
        if abs(w) > 1e-6:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert math.isclose(abs(r.whitened), abs(w), rel_tol=1e-7, abs_tol=1e-9)


def test_whole_result_equals_brute_force(vectors):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(9) * np.arange(1, 10)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector holds two fifths of the rows
    rows += [(2000, None), (2001, [None] + [1.0] * 8), (2002, [float("nan")] * 9), (2003, [float("inf")] + [0.0] * 8), (2004, [-0.0] * 9)]
    check(whitening.whiten(vectors(rows), "vec_id", "embedding"), rows)
    clash = vectors(rows).withColumns({c: F.lit("clash") for c in ("_id", "_x", "_v", "n", "component")})
    check(whitening.whiten(clash, "vec_id", "embedding"), rows)


def test_many_triangles_are_joined_in_a_tree(vectors):
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (300, 6))
    fit = vectors([(i, v) for i, v in enumerate(x.tolist())], "long", 40).select(F.col("embedding").alias("_x"))
    sums = [int(v) for v in x.sum(axis=0)]
    r = whitening.triangle(fit, 300, sums, fan_in=3)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12)


def test_whole_numbers_beyond_a_long_stay_exact(vectors):
    rows = [(i, [2.0**40 * i, float(i * i)]) for i in range(1, 8)] + [(9, [2.0**50, -1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(rows, "double"), "vec_id", "embedding").collect()}
    want = {i: d for (i, _), (_, d, _, _) in brute(rows).items()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in got.values()


def test_awkward_tables(vectors):
    assert whitening.whiten(vectors([]), "vec_id", "embedding").collect() == []
    one = whitening.whiten(vectors([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]), "vec_id", "embedding").collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, None, None)}
    mixed = whitening.whiten(vectors([(1, [1.0]), (2, [3.0]), (3, [1.0, 2.0]), (4, []), (None, [8.0])]), "vec_id", "embedding").collect()
    assert sorted((r.vec_id or 0, r.component) for r in mixed) == [(0, 1), (1, 1), (2, 1)]
    flat = whitening.whiten(vectors([(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0])]), "vec_id", "embedding").collect()
    assert [(r.component, r.whitened is None) for r in sorted(flat)] == [(1, False), (2, True), (3, True)] * 2


def test_the_query(spark, tmp_path, vectors):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(200)]
    vectors(rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op12_whiten(spark, str(tmp_path))
    check(df, rows)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
