import math
import random

import numpy as np
import pytest

import __spark_entry__ as driver
from rewardloom.llm import whitening

KINDS = "vec_id long, embedding array<float>, label int, component string, n string, deviation string, whitened string, i string, values string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0, *["clash"] * 6) for i, v in vectors], KINDS).repartition(parts)


def brute(vectors, components=32):
    """From the singular values of all centred vectors at once."""
    lengths = [len(v) for _, v in vectors if good(v)]
    size = max(set(lengths), key=lambda s: (lengths.count(s), s))
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if good(v) and len(v) == size]
    n, sums = len(kept), [sum(column) for column in zip(*[x for _, x in kept], strict=True)]
    exact = [[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept]
    _, s, right = np.linalg.svd(np.array(exact, float) / n, full_matrices=False)
    held = int((s > 1e-12 * s[0]).sum())
    held = min(held, components)
    w = np.array(exact, float) / n @ right[:held].T / (s[:held] / math.sqrt(n))
    deviation = [sum(a * a for a in x) for x in exact]
    return [i for i, _ in kept], n, [x if x < 2**63 else None for x in deviation], w, s[:held] ** 2 / (s**2).sum()


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) and abs(c) < 2**40 for c in v)


def compare(spark, vectors, near=1e-7, error=1e-9):
    rows = whitening.whitened(table(spark, vectors), "embedding", "vec_id").collect()
    ids, n, deviation, w, explained = brute(vectors)
    assert len(rows) == w.size
    got = np.zeros(w.shape)
    at = {i: k for k, i in enumerate(ids)}
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]])
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
        assert r.identity_error <= error
    signs = np.sign((got * w).sum(axis=0))
    assert np.abs(got - signs * w).max() <= near * max(1, np.abs(w).max())


def made(n, size, seed=1, scale=None):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, size)) * (np.linspace(1, 4, size) if scale is None else scale)
    return [(i, row.astype(np.float32).tolist()) for i, row in enumerate(a @ np.linalg.qr(rng.normal(size=(size, size)))[0])]


def test_all_components_of_ordinary_vectors(spark):
    compare(spark, made(700, 40))


def test_dropped_rows_and_other_lengths(spark):
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [math.nan] + [0.0] * 11), (904, [0.0] * 11 + [-math.inf]), (905, [1.0, 2.0]), (906, [1e30] + [0.0] * 11)]
    compare(spark, made(100, 12) + odd)


def test_a_hot_vector_and_constant_and_dependent_dimensions(spark):
    rng = random.Random(3)
    rows = [[float(rng.randint(-50, 50)) for _ in range(6)] for _ in range(200)]
    rows = [[*r, 7.0, r[0] + r[1], -2 * r[2], 0.0] for r in rows]
    rows[100:] = [rows[0]] * 100
    compare(spark, list(enumerate(rows)))


def test_spreads_of_eight_orders_keep_their_small_components(spark):
    # Multiples of 64ths, so that nothing is lost by counting; a covariance decomposed at once would lose the small ones.
    rng = np.random.default_rng(9)
    a = rng.integers(-8, 9, size=(400, 8)) * np.array([2.0**k for k in (20, 17, 14, 11, 8, 5, 2, -3)])
    rows = [(i, row.tolist()) for i, row in enumerate(a)]
    compare(spark, rows)
    whole = rng.integers(-3, 4, size=(300, 1)) * np.full(5, 2.0**18) + rng.integers(-9, 10, size=(300, 5)) / 64
    compare(spark, [(i, row.tolist()) for i, row in enumerate(whole)], near=1e-5, error=1e-6)


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        df = whitening.whitened(table(spark, vectors, 1), "embedding", "vec_id")
        assert df.count() == 0
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_deviations_are_exact_or_null():
    whole, rest = np.array([[2**30, -(2**30)], [1, 2]]), np.array([3, 4])
    n = 2**20
    assert whitening.deviations(whole, rest, n) == [None, (n - 3) ** 2 + (2 * n - 4) ** 2]
    assert whitening.deviations(whole[1:], rest, n) == [(n - 3) ** 2 + (2 * n - 4) ** 2]


def test_a_triangular_solve_undoes_its_factors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 9))
    factors = [np.triu(rng.normal(size=(9, 9))) + 5 * np.eye(9) for _ in range(3)]
    assert np.allclose(whitening.solved(x @ factors[2] @ factors[1] @ factors[0], factors), x)


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = driver.queries()["op13_whitening"](spark, sf).collect()
    ids, n, deviation, w, explained = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    at = {i: k for k, i in enumerate(ids)}
    got = np.zeros(w.shape)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]])
        assert r.identity_error <= 1e-10 and r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
    assert len(rows) == w.size and np.abs(got - np.sign((got * w).sum(axis=0)) * w).max() < 1e-8
