"""Exact search against brute force: ties, repeated rows, bad vectors, several shards and blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from daymark.llm import topk


def plain(rows, k, chosen):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            fine[i] = min(fine.get(i, w), w)
    out = []
    for q in fine:
        if chosen(q):
            scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def table(seed, n=300, size=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(size)]) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(80)]  # one vector many times
    rows += [(1000, None), (1001, [None] * size), (1002, [float("nan")] * size), (1003, [float("inf")] + [0.0] * (size - 1)), (1004, [1.0, 2.0]), (1050, []), (None, [1.0] * size), (5, list(rows[5][1]))]
    return rows


@pytest.mark.parametrize("shard,block,lists", [(4096, 2048, 4), (50, 4, 3), (9, 2, 1)])
def test_equal_to_brute_force(spark, monkeypatch, shard, block, lists):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LISTS", lists)
    rows = table(shard)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    import numpy as np

    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == plain(as_float, 5, lambda i: i % 20 == 0)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 256 * 512), (0, 2, 2, -256 * 768)]
    assert topk.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [2.0**21 + 1, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 2.0])], "vec_id long, embedding array<double>")
    rows = [(0, [2.0**21 + 1, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 2.0])]
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") == 0).collect()) == plain(rows, 5, lambda i: i == 0)
