"""Jobs that take all their rows and keep to their limits."""

import datetime as dt
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.operators import explain as ex
from daymark.operators import results as rs
from daymark.operators import sequences as sq
from daymark.operators import shift as sh
from daymark.operators.detectors import LogisticDetector, gathered
from daymark.plans import protocols as pr
from daymark.schema import COUNT_COLUMNS
from daymark.session import co_partitioned, fixed, shared_dir, work_path
from daymark.streaming import deviation as dv


def test_domain_classifier_is_fitted_on_all_rows(spark):
    """The first 50,000 rows of a side say nothing; what tells the sides apart comes later."""
    rank = F.floor(F.col("id") / 2) + 1
    side = (F.col("id") % 2).cast("int")
    sample = spark.range(120_000).select(
        F.lit("a").alias("a"), F.lit("b").alias("b"), F.lit(0).alias("seed"), F.col("id").alias("user"), F.col("id").alias("day"),
        side.alias("side"), rank.alias("rank"), F.when(rank > 50_000, side * 2.0 - 1.0).otherwise(0.0).alias("x"))
    found = sh.domain_classifier(sample, ["x"], models=("lr",)).first()
    assert abs(found["err"] - 0.5 * 50_000 / 60_000) < 1e-9 and abs(found["auc"] - (1 - 0.5 * (5 / 6) ** 2)) < 1e-9


def test_fold_models_are_those_of_the_logistic_detector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)) * [1.0, 50.0, 0.0]
    label = (x[:, 0] + x[:, 1] / 50 + rng.normal(size=600) > 0.5).astype(int)
    places = [0, 0]
    rows = []
    for i, (v, y) in enumerate(zip(x.tolist(), label.tolist())):
        places[y] += 1
        rows.append((y, places[y], [None if i % 50 == 0 else v[0], v[1], v[2]], i))
    df = spark.createDataFrame(rows, "g int, rank long, x array<double>, user long")
    got = sh.linear_folds(df.drop("user"), {0: [(7, 0, None)], 1: [(7, 1, None)]}, ["cnt_a", "cnt_b", "cnt_c"], 3).toPandas()
    assert len(got) == 600 and set(got["cell"]) == {7}
    wide = df.select(F.col("g").alias("label"), ((F.col("rank") - 1) % 3).alias("fold"), *[F.get("x", F.lit(i)).alias(f"cnt_{c}") for i, c in enumerate("abc")])
    want = []
    for k in range(3):
        fitted = LogisticDetector(columns=["cnt_a", "cnt_b", "cnt_c"]).fit(wide.filter(F.col("fold") != k))
        want.append(fitted.score(wide.filter(F.col("fold") == k)).select("label", "score").toPandas())
    for y in (0, 1):
        ours = np.sort(got.loc[got["label"] == y, "score"])
        theirs = np.sort(np.concatenate([w.loc[w["label"] == y, "score"] for w in want]))
        assert len(ours) == len(theirs) and np.abs(ours - theirs).max() < 0.02


def test_pairs_share_the_rows_of_a_domain(spark):
    """Cells cut the larger side, a side alone is scored 0, and equal rows get equal scores."""
    rows = [(g, r, [float(g) + (r % 3) * 0.5]) for g in (0, 1) for r in range(1, 31)]
    df = spark.createDataFrame(rows, "g int, rank long, x array<double>")
    members = {0: [(0, 0, 20), (1, 0, None)], 1: [(0, 1, 20)]}
    got = sh.linear_folds(df, members, ["cnt_a"], 5).collect()
    assert sorted((r["cell"], r["label"]) for r in got) == [(0, 0)] * 20 + [(0, 1)] * 20 + [(1, 0)] * 30
    assert {r["score"] for r in got if r["cell"] == 1} == {0.0}


def table(spark, n=400, domains=("a", "b", "c")):
    rng = np.random.default_rng(3)
    rows = [(d, f"{d}{i % 40}", dt.date(2024, 1, 1) + dt.timedelta(i // 40), int(rng.random() < 0.3), i) for d in domains for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, user string, day date, label int, i int")
    return df.select("*", (F.col("label") + F.rand(5)).alias("cnt_a"), F.rand(6).alias("cnt_b")).drop("i")


def test_jobs_that_differ_in_an_unused_seed_are_fitted_once(spark):
    """Seeds 0 and 1 share the fits of the protocols that do not split users; a detector that holds its seed shares none."""
    fits = []

    class Counted:
        def fit(self, train):
            fits.append(1)
            return LogisticDetector(columns=["cnt_a", "cnt_b"], max_iter=5).fit(train)

    class Seeded(Counted):
        def __init__(self, seed):
            self.seed = seed

    rows = fixed(table(spark, domains=("a", "b")))
    grid = rs.job_grid(spark, ["lr"], ["a", "b"], [0, 1])
    out = pr.run_grid(spark, rows, grid, {"lr": lambda seed: Counted()}, work_path(spark, "grid-shared"))
    assert len(fits) == 2 * (1 + 1 + 2) and out.select(*rs.CELL).distinct().count() == 12 == out.count()
    wide = {tuple(r[:5]): (r["pr_auc"], r["n"]) for r in out.select(*rs.CELL, "pr_auc", "n").collect()}
    assert all(v == wide[(*k[:4], 1 - k[4])] for k, v in wide.items() if k[3] != "user_disjoint")
    fits.clear()
    pr.run_grid(spark, rows, grid, {"lr": Seeded}, work_path(spark, "grid-seeded"))
    assert len(fits) == 12


def test_ablation_leaves_no_scored_rows_behind(spark):
    """The folder grows by the tables of the cells, and not by the scored rows of every fit."""
    rows = fixed(table(spark))
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = pr.ablation(rows, ["a", "b", "c"], {"one": ["cnt_a"], "both": ["cnt_a", "cnt_b"]})
    assert out.count() == 12 and out.filter("model = 'both' and delta_to_full = 0").count() == 6
    assert {x.split("-")[1] for x in set(os.listdir(root)) - before if x.startswith("daymark")} <= {"ablation", "table"}
    assert sum(x.startswith("daymark-table") for x in set(os.listdir(root)) - before) == 1


def test_many_rows_are_fitted_without_a_shuffle(spark):
    plan = lambda n: gathered(spark.range(0, 100, 1, 64), n, most=250_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan(1000) and "Exchange" not in plan(1_000_000) and "Coalesce" in plan(1_000_000)


def test_memory_features_move_narrow_rows_once(spark):
    """No host profile goes through a shuffle, and the last join moves neither side."""
    features = spark.createDataFrame([], "dataset string, user string, day date, " + ", ".join(f"{c} long" for c in COUNT_COLUMNS))
    events = spark.createDataFrame([], "dataset string, user string, day date, dst_host string, action string")
    with co_partitioned(spark):
        plan = sq.memory_features(events, features)._jdf.queryExecution().executedPlan().toString()
    by_day = [line for line in plan.split("\n") if "Exchange hashpartitioning(dataset" in line and "day#" in line]
    assert len(by_day) == 1 and "host#" in by_day[0] and "BroadcastHashJoin" in plan  # the distinct pairs of user-day and host


def test_transfer_fits_run_side_by_side(spark):
    """Two fits are under way together, and the cells are those of fits in series."""
    barrier = threading.Barrier(2, timeout=60)

    class Waits:
        def fit(self, train):
            barrier.wait()
            return LogisticDetector(columns=["cnt_a", "cnt_b"], max_iter=5).fit(train)

    rows = fixed(table(spark, domains=("a", "b")))
    out = pr.transfer_predictions(rows, ["a", "b"], "lr", lambda seed: Waits(), protocols=("temporal",), workers=2)
    assert {tuple(r) for r in out.select("source", "target", "protocol").distinct().collect()} == {
        ("a", "b", "full_source"), ("b", "a", "full_source"), ("a", "a", "temporal"), ("b", "b", "temporal")}


def test_importance_in_turns_is_that_of_one_turn(spark, monkeypatch):
    """Few scores a turn: the same importances, and no working tables of earlier turns."""
    rows = fixed(table(spark, 60, ("a", "b")))
    score = lambda x: F.get(x, F.lit(0)) + 0.3 * F.get(x, F.lit(1))
    get = lambda: {(r["dataset"], r["feature"]): round(r["importance"], 12) for r in ex.permutation_importance(rows, ["cnt_a", "cnt_b"], score).collect()}
    whole = get()
    root = shared_dir(spark).removeprefix("file:")
    for at_once, turns in ((130, 10), (300, 5), (500, 3)):
        monkeypatch.setattr(ex, "TURN", at_once)
        before = set(os.listdir(root))
        assert get() == whole and len(whole) == 4
        made = [x for x in set(os.listdir(root)) - before if x.startswith("daymark")]
        assert sum(x.startswith("daymark-importance") for x in made) == turns and len(made) <= turns + 3


def test_integrity_moves_a_user_day_once(spark, monkeypatch):
    """Equal to counting every cell, also for nulls, many cells and repeated user-days; without repeats nothing is counted cell by cell."""
    def plain(rows):
        per = {}
        for *cell, user, day, score, label in rows:
            per.setdefault(tuple(cell), {}).setdefault((user, day), []).append((score, label))
        bad = lambda s: s is None or s != s or abs(s) == float("inf")
        out = {}
        for cell, days in per.items():
            labels = [max((x for _, x in v if x is not None), default=None) for v in days.values()]
            n_bad = sum(bad(s) for v in days.values() for s, _ in v)
            repeated = sum(len(v) > 1 for v in days.values())
            known = [x for x in labels if x is not None]
            out[cell] = (sum(map(len, days.values())), sum(known) if known else None, n_bad, repeated, not n_bad and not repeated)
        return out

    names = "model string, source string, target string, protocol string, seed int, user string, day int, score double, label int"
    rows = [(m, "s", t, "p", s, f"u{u}" if u else None, u % 3, float("inf") if u == 5 else u / 7, u % 2 if u != 4 else None)
            for m in ("a", "b", None) for t in ("x", None) for s in range(20) for u in range(6)]
    rows += [r for r in rows if r[4] == 3 and r[0] != "b"] + [(*r[:-1], 1) for r in rows if r[4] == 4 and r[0] is None]
    got = {tuple(r)[:5]: tuple(r)[5:] for r in rs.integrity(spark.createDataFrame(rows, names)).collect()}
    assert got == plain(rows) and len(got) == 120
    plans = []
    single = spark.createDataFrame(sorted(set(rows), key=repr)[:0] + [r for r in rows if r[0] == "b" and r[4] < 3], names)
    found = rs.integrity(single)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert "user" not in plans[0] and found.filter("n_repeated > 0").isEmpty()


def test_days_of_many_users_in_batches(spark):
    """Bucketed state in bytes: users of unequal length, a null user and new users in a later batch; a late day stops the stream."""
    import pandas as pd

    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    rng = np.random.default_rng(2)
    days = pd.DataFrame([("d", u, dt.date(2024, 1, 1) + dt.timedelta(k), *rng.normal(size=2)) for i, u in enumerate(["a", None, "b", "c", "dd"]) for k in range(i, 3 + 4 * i)],
                        columns=["dataset", "user", "day", "x", "y"]).sample(frac=1, random_state=0)
    late = days["day"] > dt.date(2024, 1, 5)
    p = dv.EarlierDays(["x", "y"])
    p.state = State()
    found = pd.concat([next(p.handleInputRows(("d", 0), iter([part]), None)) for part in (days[~late], days[late])])
    assert all(isinstance(v, bytes) for v in p.state.value[1:])
    for u, g in days.groupby("user", dropna=False):
        g = g.sort_values("day")
        mine = found[found["user"].isna()] if pd.isna(u) else found[found["user"] == u]
        assert mine["day"].tolist() == g["day"].tolist()
        for c in ("x", "y"):
            v = g[c].to_numpy()
            want = [0.0, *[(v[k] - v[:k].mean()) / (v[:k].std() + 1e-6) for k in range(1, len(v))]]
            assert np.allclose(mine[f"dev_{c}"], want, atol=1e-6, rtol=1e-6)
    with pytest.raises(ValueError, match="arrived after"):
        next(p.handleInputRows(("d", 0), iter([days[~late]]), None))
