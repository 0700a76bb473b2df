"""Whitened embeddings against exact sums and a plain eigenvector run."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from daymark.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, n string, component string, z int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(rows):
    """[(vec_id, n, deviation, coordinates)] with coordinates up to sign, and the explained shares; rows of one length."""
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if fine(v)]
    fit = sorted({x for _, x in xs})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    cov = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n)) for j in range(dims)] for i in range(dims)])
    e, w = np.linalg.eigh(cov)
    order = np.argsort(-e)[:16]
    out = []
    for i, x in xs:
        off = [n * x[d] - sums[d] for d in range(dims)]
        out.append((i, n, sum(o * o for o in off), np.abs(np.array(off) / n @ w[:, order] / np.sqrt(e[order]))))
    return out, e[order] / np.trace(cov)


def rows_of(seed, n=500, dims=20):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (n, dims)) @ rng.normal(0, 1, (dims, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(n + i, rows[7][1]) for i in range(200)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (9000, None), (9001, [None] * dims), (9002, [float("nan")] * dims), (9003, [float("-inf")] + [0.0] * (dims - 1))]
    random.Random(seed).shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", "clash", 3) for i, v in rows], COLUMNS).repartition(5)
    return whitening.whiten(df).collect()


@pytest.mark.parametrize("seed,dims,block", [(1, 20, 1 << 16), (2, 5, 64)])
def test_equal_to_plain(spark, monkeypatch, seed, dims, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = rows_of(seed, dims=dims)
    want, explained = plain(rows)
    got = run(spark, rows)
    k = min(16, dims)
    assert len(got) == k * len(want) and {r["component"] for r in got} == set(range(1, k + 1))
    mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in got)
    other = sorted((i is None, i or 0, c + 1, n, d, abs(w[c])) for i, n, d, w in want for c in range(k))
    assert [m[:5] for m in mine] == [o[:5] for o in other]
    assert np.allclose([m[5] for m in mine], [o[5] for o in other], rtol=1e-6, atol=1e-8)
    assert all(abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("low,high", [(-3, 4), (0, 1), (-(2**40), 2**40), (5, 6)])
def test_bit_slices_give_exact_products(low, high):
    rng = random.Random(high)
    for rows, dims in ((1, 3), (63, 4), (64, 2), (200, 5)):
        z = np.array([[rng.randrange(low, high) for _ in range(dims)] for _ in range(rows)], np.int64)
        sums, cross = whitening.cross_products(z)
        exact = z.astype(object)
        assert sums.tolist() == exact.sum(axis=0).tolist() and cross.tolist() == (exact.T @ exact).tolist()


def test_degenerate_vectors(spark):
    assert run(spark, []) == []
    one = run(spark, [(1, [0.5, 0.25])] * 3)
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 for r in one)
    flat = run(spark, [(i, [float(i % 3), 1.0]) for i in range(6)])
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1} and len(flat) == 12


def test_lengths_are_fitted_apart(spark):
    rng = random.Random(4)
    short = [(i, [rng.gauss(0, 1) for _ in range(2)]) for i in range(40)]
    long = [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    got = run(spark, [*short, *long, (500, [])])
    assert {r["n"] for r in got if r["vec_id"] < 100} == {len({tuple(math.floor(64 * float(np.float32(c))) for c in v) for _, v in short})}
    assert len(got) == 2 * 40 + 3 * 50 and max(r["identity_error"] for r in got) < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [2.0**26, 0.0]), (1, [-(2.0**26), 1.0]), (2, [0.0, 0.5])]
    got = {r["vec_id"]: r["deviation"] for r in run(spark, rows)}
    want, _ = plain(rows)
    assert got == {i: (d if d < 2**63 else None) for i, _, d, _ in want} and None in got.values()
