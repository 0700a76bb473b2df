"""Selection by counting against plain sorting, with one second or one prefix that holds most rows."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from daymark.operators import sampling as sm
from daymark.operators import selection as se


def events(spark, n, hot, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(hours=5) if rng.random() < hot else start + dt.timedelta(seconds=rng.randrange(10**6), microseconds=rng.randrange(10))
        rows.append((at, str(rng.randrange(10 * n)), rng.choice("ab"), i))
    return rows, spark.createDataFrame(rows, "timestamp timestamp_ntz, event_id string, dataset string, extra int").repartition(6)


@pytest.mark.parametrize("hot,narrow", [(0.0, 50), (0.6, 50), (0.6, 100_000), (1.0, 5)])
def test_head_equals_sorting(spark, hot, narrow):
    rows, df = events(spark, 600, hot)
    key = lambda r: (r[0], r[1].encode(), r[2])
    for n in (0, 1, 7, 300, 599, 600, 900):
        got = [tuple(r) for r in sm.head_sample(df, n, narrow).collect()]
        assert sorted(map(key, got)) == sorted(map(key, rows))[:n]


def test_head_orders_only_the_edge(spark):
    _, df = events(spark, 600, 0.6)
    plan = sm.head_sample(df, 400, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and plan.count("TakeOrderedAndProject") <= 1
    assert sm.head_sample(df.limit(0), 5).count() == 0


def test_capped_groups_equal_ranking(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), f"u{i}", int(rng.random() < (0.3 if i % 2 else 0.01))) for i in range(900)] + [("small", "x", 1), ("small", "y", 0)]
    df = spark.createDataFrame(rows, "dataset string, id string, label int").repartition(5)
    got = {tuple(r) for r in sm.cap_keeping_positives(df, F.col("id"), cap=260, seed=4).collect()}
    want = set()
    for d in ("a", "b", "small"):
        own = [r for r in rows if r[0] == d]
        order = lambda y: sorted((r for r in own if r[2] == y), key=lambda r: hashlib.md5(f"4:{r[1]}".encode()).hexdigest())
        n_pos = min(len(order(1)), 200)
        want |= set(own) if len(own) <= 260 else set(order(1)[:n_pos]) | set(order(0)[: 260 - n_pos])
    assert got == want


def test_groups_that_are_kept_whole_or_dropped(spark):
    df = spark.createDataFrame([(g, f"k{i}") for g in "abc" for i in range(50)], "g string, k string")
    allowed = spark.createDataFrame([("a", 0), ("b", 50), ("c", 13)], "g string, allowed long")
    out = se.first_of_groups(df, ["g"], F.md5("k"), F.col("k"), allowed, digits=1)
    kept = sorted(hashlib.md5(f"k{i}".encode()).hexdigest() for i in range(50))[:13]
    got = out.collect()
    assert sum(r["g"] == "a" for r in got) == 0 and sum(r["g"] == "b" for r in got) == 50
    assert sorted(hashlib.md5(r["k"].encode()).hexdigest() for r in got if r["g"] == "c") == kept
