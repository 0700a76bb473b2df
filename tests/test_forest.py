"""The forest: partitioning, bootstrap and class weights, splits against all cuts, and quality beside Spark's own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from daymark.operators import detectors as de
from daymark.operators import forest as fo
from daymark.operators.metrics import pr_roc

COLS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for d in ("a", "b"):
        for i in range(1500):
            x = rng.normal(size=6)
            y = int(rng.random() < (0.9 if x[0] * x[1] > 0.7 and x[2] > 0 else 0.01))
            data.append((d, f"{d}{i % 300}", dt.date(2024, 1, 1 + i // 300), y, *map(float, x)))
    df = spark.createDataFrame(data, "dataset string, user string, day date, label int, " + ", ".join(f"{c} double" for c in COLS))
    return df.cache()


def scores(df, fitted):
    return {(r["user"], r["day"]): r["score"] for r in fitted.score(df).select("user", "day", "score").collect()}


def splits(fitted):
    return [t.splits for t in fitted.details["trees"]]


def test_the_same_forest_for_any_partitioning(rows, monkeypatch):
    train, target = rows.filter("dataset = 'a'"), rows.filter("dataset = 'b'")
    found = []
    for parts, per_task, block, small in ((1, 5_000, 8192, 100_000), (7, 200, 64, 0), (3, 500, 100, 300)):
        monkeypatch.setattr(fo, "SMALL", small)
        monkeypatch.setattr(de.ForestDetector, "per_task", per_task)
        monkeypatch.setattr(fo, "BLOCK", block)
        found.append(de.ForestDetector(trees=8, depth=5, columns=COLS, seed=3).fit(train.repartition(parts)))
    for other in found[1:]:
        assert splits(found[0]) == splits(other) and scores(target, found[0]) == scores(target, other)
    assert splits(de.ForestDetector(trees=8, depth=5, columns=COLS, seed=4).fit(train)) != splits(found[0])


def test_bootstrap_weights_are_poisson_and_differ_by_tree():
    keys = np.arange(40_000).astype(np.uint64) * np.uint64(977)
    one, two = (fo.bootstrap(keys, 0, t) for t in (0, 1))
    assert abs(one.mean() - 1) < 0.02 and abs(one.var() - 1) < 0.04 and abs((one == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.02


def test_splits_equal_all_cuts():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (5, 3, 4, 2)) * (rng.random((5, 3, 4, 2)) < 0.7)
    counts[:, 1:] = 0  # features of a node see the same rows: only one is compared
    weights, drawn = np.array([0.6, 3.0]), np.arange(15).reshape(5, 3)
    gini = lambda w: 2 * w[0] * w[1] / w.sum() if w.sum() else 0.0
    for node, got in enumerate(zip(*fo.best_splits(counts, weights, drawn, 1))):
        got = None if got[0] < 0 else got
        best = None
        for b in range(3):
            low, high = counts[node, 0, : b + 1].sum(axis=0), counts[node, 0, b + 1 :].sum(axis=0)
            if low.sum() and high.sum():
                gain = gini((low + high) * weights) - gini(low * weights) - gini(high * weights)
                if gain > 1e-12 and (best is None or gain > best[1] + 1e-12):
                    best = (b, gain, low * weights, high * weights)
        assert (got is None) == (best is None)
        if got:
            assert got[:2] == (node * 3, best[0]) and got[2] == pytest.approx(best[1])
            assert got[3] == pytest.approx(best[2][1] / best[2].sum()) and got[4] == pytest.approx(best[3][1] / best[3].sum())


def test_a_tree_without_limits_separates_its_bootstrap(spark, rows):
    one = rows.filter("dataset = 'a'").limit(60)
    fitted = de.ForestDetector(trees=60, depth=12, columns=COLS, bins=64).fit(one)
    got = fitted.score(one).select("label", "score").collect()
    assert min(r["score"] for r in got if r["label"]) > max(r["score"] for r in got if not r["label"]) or all(r["label"] == 0 for r in got)


def test_quality_beside_the_built_in_forest(rows):
    train, target = rows.filter("dataset = 'a'"), rows.filter("dataset = 'b'")
    fitted = de.ForestDetector(trees=60, depth=8, columns=COLS).fit(train)
    neg, pos = de.class_counts(train)
    plain = RandomForestClassifier(numTrees=60, maxDepth=8, maxBins=32, weightCol="weight", seed=1, featureSubsetStrategy="sqrt").fit(
        de.assemble(de.balanced_weights(train, neg, pos), COLS))
    other = plain.transform(de.assemble(target, COLS)).withColumn("score", vector_to_array("probability")[1])
    ours = pr_roc(fitted.score(target), ["dataset"]).first()
    theirs = pr_roc(other.select("dataset", "user", "day", "score", "label"), ["dataset"]).first()
    assert ours["pr_auc"] > 0.95 * theirs["pr_auc"] and ours["roc_auc"] > theirs["roc_auc"] - 0.02
    importance = fitted.details["importances"]
    assert sum(importance.values()) == pytest.approx(1) and min(importance[c] for c in COLS[:3]) > max(importance[c] for c in COLS[3:])


def test_nulls_and_weights_from_outside(rows):
    train = rows.filter("dataset = 'a'").withColumn("x5", F.lit(None).cast("double"))
    fitted = de.ForestDetector(trees=5, depth=3, columns=COLS).fit(train.withColumn("extra_weight", F.lit(0.5)))
    assert splits(fitted) == splits(de.ForestDetector(trees=5, depth=3, columns=COLS).fit(train.withColumn("extra_weight", F.lit(1.0))))
    assert fitted.score(train).filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_parts_and_sent_rows_do_not_grow_with_the_table(rows, monkeypatch):
    parts = []
    real = fo.blocks
    monkeypatch.setattr(fo, "blocks", lambda df, cols, edges, n: (parts.append(n), real(df, cols, edges, n))[1])
    monkeypatch.setattr(de.ForestDetector, "per_task", 10)  # 150 parts of so few rows
    de.ForestDetector(trees=2, depth=2, columns=COLS).fit(rows.filter("dataset = 'a'"))
    assert parts == [4 * rows.sparkSession.sparkContext.defaultParallelism]
    monkeypatch.setattr(fo, "SMALL", 1000)
    assert fo.small_rows(1000) == 1000 and fo.small_rows(100_000) == 10
    nodes = [(9.0, 4 + i) for i in range(200)] + [(11.0, 3)]
    apart, sent = fo.sent_apart(nodes, fo.small_rows(100_000), 0.0)
    assert len(apart) == 111 and 3 not in apart and sent == 999
    assert fo.sent_apart(nodes, fo.small_rows(100_000), sent) == (set(), sent)
