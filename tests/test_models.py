"""Detectors, protocols and domain distances on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.operators import detectors as de
from daymark.operators import results as rs
from daymark.operators import shift as sh
from daymark.operators.metrics import pr_roc
from daymark.plans import protocols as pr
from daymark.session import work_path

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two domains; positives lie far out in the first feature."""
    rng = np.random.default_rng(0)
    data = []
    for d in ("a", "b"):
        for u in range(40):
            for day in range(6):
                y = int(u % 8 == 0 and day == 3)
                x = rng.normal(size=3) + np.array([6.0 * y, 0, 0])
                data.append((d, f"{d}{u}", dt.date(2024, 1, 1 + day), y, *map(float, x)))
    df = spark.createDataFrame(data, "dataset string, user string, day date, label int, x0 double, x1 double, x2 double")
    return df.cache()


def auc(fitted, df):
    return pr_roc(fitted.score(df), ["dataset"]).first()["roc_auc"]


@pytest.mark.parametrize(
    "detector",
    [de.ForestDetector(trees=20, depth=4, columns=COLS), de.LogisticDetector(columns=COLS), de.PerceptronDetector(hidden=(8,), columns=COLS, max_iter=40),
     de.IsolationDetector(trees=50, columns=COLS), de.OneClassDetector(columns=COLS, width=128), de.NeighbourDetector(columns=COLS, k=4)],
    ids=lambda d: type(d).__name__,
)
def test_detector_transfers(rows, detector):
    fitted = detector.fit(rows.filter("dataset = 'a'"))
    target = rows.filter("dataset = 'b'")
    assert fitted.score(target).count() == target.count()
    assert auc(fitted, target) > 0.9


def test_reconstruction_and_context_score_every_row(rows):
    for d in (de.ReconstructionDetector(components=2, columns=COLS), de.ContextDetector(columns=COLS)):
        out = d.fit(rows.filter("dataset = 'a'")).score(rows)
        assert out.filter("score IS NULL OR isnan(score)").count() == 0 and out.count() == rows.count()


def test_one_class_training_gives_a_constant(rows):
    fitted = de.LogisticDetector(columns=COLS).fit(rows.filter("label = 0"))
    assert {r["score"] for r in fitted.score(rows).select("score").distinct().collect()} == {0.0}


def test_linear_score_equals_the_model(rows):
    fitted = de.LogisticDetector(columns=COLS).fit(rows)
    w, b, s = fitted.details["weights"], fitted.details["intercept"], fitted.details["scaler"]
    for r in fitted.score(rows).limit(20).collect():
        z = b + sum(w[c] * max(-8, min(8, (r[c] - s.mean[c]) / s.std[c])) for c in COLS)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_adaptation_reads_no_target_labels(rows):
    target = rows.filter("dataset = 'b'").withColumn("label", F.lit(None).cast("int"))
    fitted = de.adapted(de.LogisticDetector(columns=COLS), rows.filter("dataset = 'a'"), target, COLS)
    assert auc(fitted, rows.filter("dataset = 'b'")) > 0.9


def test_grid_resumes_without_repeating(spark, rows):
    path = work_path(spark, "grid-test")
    grid = rs.job_grid(spark, ["lr"], ["a", "b"], [0], ("user_disjoint",))
    makers = {"lr": pr.factory("logistic_regression", columns=COLS, max_iter=10)}
    pr.run_grid(spark, rows, grid.filter("source = 'a'"), makers, path)
    out = pr.run_grid(spark, rows, grid, makers, path)
    assert out.count() == 4 and out.select(*rs.CELL).distinct().count() == 4
    assert rs.missing_cells(grid, out).count() == 0


class Killed:
    """A detector whose job dies where the training rows are of one domain."""

    def __init__(self, domain):
        self.domain = domain

    def fit(self, train):
        if train.filter(F.col("dataset") == self.domain).count():
            raise RuntimeError("killed")
        return de.LogisticDetector(columns=COLS, max_iter=10).fit(train)


def test_a_killed_job_is_resumed_and_the_others_stay(spark, rows):
    path = work_path(spark, "grid-killed")
    grid = rs.job_grid(spark, ["lr"], ["a", "b"], [0, 1])
    with pytest.raises(RuntimeError, match="6 of 12 jobs failed"):
        pr.run_grid(spark, rows, grid, {"lr": lambda seed: Killed("b")}, path)
    kept = {tuple(r) for r in spark.read.parquet(path).select(*rs.CELL).collect()}
    assert len(kept) == 6 and {c[1] for c in kept} == {"a"}
    before = spark.read.parquet(path).filter("source = 'a'").inputFiles()
    out = pr.run_grid(spark, rows, grid, {"lr": pr.factory("logistic_regression", columns=COLS, max_iter=10)}, path)
    assert out.count() == 12 == out.select(*rs.CELL).distinct().count() and "job" not in out.columns
    assert set(before) <= set(out.inputFiles())  # finished folders are not written again


def test_parallel_and_serial_runs_give_the_same_rows(spark, rows):
    from daymark.operators.scores import DeviationDetector

    found = []
    for workers in (1, 4):
        grid = rs.job_grid(spark, ["d"], ["a", "b"], [0, 1, 2])
        out = pr.run_grid(spark, rows, grid, {"d": lambda seed: DeviationDetector(COLS)}, work_path(spark, "grid-workers"), workers)
        found.append(sorted(tuple(r) for r in out.select(*rs.CELL, "n", "n_pos", "pr_auc", "roc_auc").collect()))
    assert found[0] == found[1] and len(found[0]) == 18


def test_the_grid_layout_prunes_domains_and_needs_no_shuffle_by_user(spark, rows):
    from daymark.plans.grid import laid_out

    table = laid_out(rows, buckets=4)
    own = table.filter("dataset = 'a'").groupBy("user").agg(F.count("*"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(dataset" in plan and own.count() == 40


def test_transfer_protocol_tags(rows):
    out = pr.transfer_predictions(rows, ["a", "b"], "lr", pr.factory("logistic_regression", columns=COLS, max_iter=10), protocols=("user_disjoint",))
    tags = {(r["source"], r["target"], r["protocol"]) for r in out.select("source", "target", "protocol").distinct().collect()}
    assert tags == {("a", "a", "user_disjoint"), ("a", "b", "full_source"), ("b", "b", "user_disjoint"), ("b", "a", "full_source")}


# ---- distances ------------------------------------------------------------------------------------


def test_rbf_matches_brute_force(rows):
    samples = sh.pair_samples(rows, ["a", "b"], seeds=(0,))
    got = sh.rbf_mmd(samples, COLS, width=8192).first()
    pdf = samples.orderBy("side", "rank").toPandas()
    x = pdf[COLS].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    side = pdf["side"].to_numpy()
    k = lambda u, v: np.exp(-got["gamma"] * ((u[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)).mean()
    a, b = x[side == 0], x[side == 1]
    assert got["n_mmd"] == len(a) == len(b)
    assert got["mmd_rbf"] == pytest.approx(k(a, a) + k(b, b) - 2 * k(a, b), abs=1e-3)  # random features stand for the kernel
    moved = rows.withColumn("x1", F.when(F.col("dataset") == "b", F.col("x1") + 8).otherwise(F.col("x1")))
    assert sh.rbf_mmd(sh.pair_samples(moved, ["a", "b"]), COLS).first()["mmd_rbf"] > 50 * got["mmd_rbf"]


def test_domain_classifier_separates_shifted_domains(rows):
    moved = rows.withColumn("x1", F.when(F.col("dataset") == "b", F.col("x1") + 8).otherwise(F.col("x1")))
    far = sh.domain_classifier(sh.pair_samples(moved, ["a", "b"]), COLS, models=("lr",)).first()
    near = sh.domain_classifier(sh.pair_samples(rows, ["a", "b"]), COLS, models=("lr",)).first()
    assert far["auc"] > 0.99 and far["da"] > 1.8
    assert 0.3 < near["auc"] < 0.7 and near["da"] < 0.5
