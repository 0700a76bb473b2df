"""Hand-checkable cases and brute-force comparisons of the operators."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.operators import compose as cp
from daymark.operators import explain as ex
from daymark.operators import features as ft
from daymark.operators import labels as lb
from daymark.operators import metrics as mt
from daymark.operators import ordered as od
from daymark.operators import results as rs
from daymark.operators import sampling as sm
from daymark.operators import sequences as sq
from daymark.operators import splits as sp


def events(spark, rows):
    """rows: (user, timestamp text, action, host)."""
    data = [("d", str(i), u, t, a, h) for i, (u, t, a, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "dataset string, event_id string, user string, t string, action string, dst_host string")
    return df.select("dataset", "event_id", "user", F.to_timestamp_ntz("t").alias("timestamp"), "action", "dst_host").withColumn(
        "day", F.to_date("timestamp")
    )


# ---- features -------------------------------------------------------------------------------------


def test_deviation_spike_and_cold_start(spark):
    rows = [("u", f"2024-01-0{d + 1} 10:00:{i:02d}", "http", "h") for d, n in enumerate([3, 3, 3, 17]) for i in range(n)]
    out = ft.user_day_features(events(spark, rows)).orderBy("day").collect()
    assert out[0]["dev_cnt_http"] == 0.0
    assert out[-1]["dev_cnt_http"] == pytest.approx(14 / 1e-6)
    assert out[-1]["cnt_http"] == 17 and out[-1]["n_distinct_hosts"] == 1


def test_one_day_user_has_zero_deviation_and_std(spark):
    out = ft.user_day_features(events(spark, [("u", "2024-01-01 03:00:00", "logon", "h")])).first()
    assert all(out[c] == 0.0 for c in sc.DEV_COLUMNS)
    assert out["hour_std"] == 0.0 and out["frac_offhours"] == 1.0


def test_feature_columns_are_fixed(spark):
    f = ft.user_day_features(events(spark, [("u", "2024-01-01 03:00:00", "logon", "h")]))
    assert ft.active_columns(f) == sc.FEATURE_COLUMNS and len(sc.FEATURE_COLUMNS) == 42
    assert ft.active_columns(f.drop(*sc.DEV_COLUMNS)) == sc.BASE_COLUMNS
    with pytest.raises(ValueError, match="hour_std"):
        ft.align_features(f.drop("hour_std"))


def test_validate_names_offenders(spark):
    e = spark.createDataFrame([("x",)], "action string")
    for c in sc.EVENT_COLUMNS:
        if c != "action":
            e = e.withColumn(c, F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="teleport"):
        sc.validate(e.withColumn("action", F.lit("teleport")))
    with pytest.raises(ValueError, match="object"):
        sc.validate(e.drop("object"))


def test_domain_metadata(spark):
    meta = {r["dataset"]: r for r in sc.domain_metadata(spark).collect()}
    assert meta["lanl"]["is_real"] and meta["twos"]["insider_types"] == ["masquerader", "traitor"]


# ---- running totals -------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_running_totals_with_one_hot_group(spark, partitions):
    """Two thirds of the rows in one group; the result does not depend on the partitioning."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"), "id", (F.col("id") % 7).alias("v"))
        got = od.running(df, ["g"], [F.col("id")], {"v": F.col("v"), "row": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g in ("hot", "cold"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])
        assert [r["run_v"] for r in mine] == np.cumsum([r["v"] for r in mine]).tolist()
        assert [r["run_row"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r["all_row"] for r in mine} == {len(mine)}


# ---- labels and intervals -------------------------------------------------------------------------


def test_interval_ends_included_and_no_doubles(spark):
    e = events(spark, [("u", t, "http", "h") for t in ("2024-01-01 10:00:00", "2024-01-01 11:30:00", "2024-01-01 12:00:00", "2024-01-01 12:00:01")])
    spans = spark.createDataFrame(
        [("h", "2024-01-01 10:00:00", "2024-01-01 11:00:00"), ("h", "2024-01-01 10:30:00", "2024-01-01 12:00:00"),
         ("h", "2024-01-01 10:00:00", "2024-01-01 12:00:00"), ("g", "2024-01-01 00:00:00", "2024-01-02 00:00:00")],
        "host string, s string, e string",
    ).select("host", F.to_timestamp_ntz("s").alias("start"), F.to_timestamp_ntz("e").alias("end"))
    flagged = lb.flag_intervals(e, spans, "dst_host").orderBy("timestamp").collect()
    assert [r["in_interval"] for r in flagged] == [True, True, True, False]


def test_dominant_user_tie_goes_to_smallest(spark):
    e = events(spark, [("b", "2024-01-01 10:00:00", "logon", "h"), ("a", "2024-01-01 11:00:00", "logon", "h")])
    assert lb.dominant_users(e, "dst_host").first()["dominant_user"] == "a"


# ---- splits and samples ---------------------------------------------------------------------------


def test_chronological_split_is_ordered_and_whole(spark):
    e = events(spark, [("u", f"2024-01-01 10:{m:02d}:{m:02d}", "http", "h") for m in range(50)])
    out = sp.chronological_events(e).groupBy("part").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n"))
    parts = {r["part"]: r for r in out.collect()}
    assert parts["train"]["hi"] <= parts["test"]["lo"]
    assert parts["train"]["n"] == 35 and parts["test"]["n"] == 15


def test_equal_timestamps_fall_back_to_row_cut(spark):
    e = events(spark, [("u", "2024-01-01 10:00:00", "http", "h")] * 10)
    counts = {r["part"]: r["count"] for r in sp.chronological_events(e).groupBy("part").count().collect()}
    assert counts == {"train": 7, "test": 3}


def test_time_quantile_equals_numpy(spark):
    rng = np.random.default_rng(0)
    us = np.sort(rng.integers(1_700_000_000_000_000, 1_700_000_900_000_000, 501))
    e = spark.createDataFrame([("d", int(x)) for x in us], "dataset string, us long")
    e = e.select("dataset", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000)").alias("timestamp"))
    assert sp.time_quantile(e, 0.7).first()["cut_us"] == int(np.floor(np.quantile(us, 0.7)))


def _users(spark, n_pos, n_neg):
    rows = [("d", f"p{i}", 1) for i in range(n_pos)] + [("d", f"n{i}", 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "dataset string, user string, label int").withColumn("day", F.lit(dt.date(2024, 1, 1)))


def test_user_split_is_disjoint_and_stratified(spark):
    out = sp.user_disjoint(_users(spark, 5, 45), seeds=(3,))
    assert out.count() == 50
    got = {(r["part"], r["label"]): r["count"] for r in out.groupBy("part", "label").count().collect()}
    assert got == {("train", 1): 4, ("test", 1): 1, ("train", 0): 31, ("test", 0): 14}  # round half even: 3.5 -> 4, 31.49 -> 31


def test_user_split_never_leaves_test_empty(spark):
    one = sp.user_disjoint(_users(spark, 0, 1)).collect()
    assert [r["part"] for r in one] == ["test"]
    two = sp.user_disjoint(_users(spark, 1, 1)).collect()
    assert sorted(r["part"] for r in two) == ["test", "train"]


def test_validation_keeps_single_users_in_train(spark):
    out = {r["user"]: r["part"] for r in sp.validation_users(_users(spark, 1, 10)).collect()}
    assert out["p0"] == "train" and sum(v == "val" for v in out.values()) == 2


def test_sample_ignores_partitioning(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("event_id"))
    a = {r[0] for r in df.repartition(7).filter(sm.keep(0.05)).collect()}
    b = {r[0] for r in df.coalesce(1).filter(sm.keep(0.05)).collect()}
    assert a == b and 180 < len(a) < 320


def test_audit_catches_a_label_aware_sampler(spark):
    cols = ["timestamp", "src_host", "object"]
    e = spark.range(4000).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("event_id"), F.concat(F.lit("u"), F.col("id") % 10).alias("user"))
    for c in cols:
        e = e.withColumn(c, F.col("event_id"))
    e = e.withColumns({"dst_host": F.lit("h"), "action": F.lit("http"), "label": F.lit(0), "on_roster": F.col("user") == "u3"})
    web = F.col("action") == "http"
    fair, loose = e.filter(sm.keep(0.05)), e.filter(F.col("on_roster") | sm.keep(0.05))
    assert sm.sampling_audit(fair, loose, web, 0.05).first()["passed"]
    assert not sm.sampling_audit(loose, loose, web, 0.05).first()["passed"]


def test_lodo_needs_two_domains(spark):
    with pytest.raises(ValueError):
        cp.lodo_folds(_users(spark, 1, 1), ["d"])


def test_prediction_parity_raises(spark):
    a = _users(spark, 2, 3)
    cp.require_prediction_parity(a, a)
    with pytest.raises(ValueError):
        cp.require_prediction_parity(a, a.filter("user <> 'p0'"))


# ---- metrics --------------------------------------------------------------------------------------


def scored(spark, scores, labels, group="g"):
    rows = [(group, float(s), int(y), f"u{i:05d}", dt.date(2024, 1, 1)) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "g string, score double, label int, user string, day date")


def brute(scores, labels):
    s, y = np.asarray(scores, float), np.asarray(labels)
    ap = last = 0.0
    for t in np.unique(s)[::-1]:
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap, last = ap + (recall - last) * precision, recall
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    dr = lambda f: float((pos >= np.quantile(neg, 1 - f)).mean())
    order = sorted(range(len(s)), key=lambda i: (-s[i], i))[: max(1, min(int(y.sum()), len(s)))]
    return {"pr_auc": ap, "roc_auc": auc, "dr_at_1pct_fpr": dr(0.01), "dr_at_5pct_fpr": dr(0.05), "precision_at_k": float(np.mean(y[order]))}


@pytest.mark.parametrize("ties", [1, 3, 50])
def test_metrics_against_brute_force(spark, ties):
    rng = np.random.default_rng(ties)
    s = np.round(rng.normal(size=600) * 10 / ties)
    y = (rng.random(600) < 0.15).astype(int)
    got = mt.metric_bundle(scored(spark, s, y), ["g"]).first()
    for k, v in brute(s, y).items():
        assert got[k] == pytest.approx(v), k


def test_small_metric_cases(spark):
    got = mt.metric_bundle(scored(spark, [7, 6, 5, 4, 3, 2, 1], [1, 0, 1, 0, 0, 1, 0]), ["g"]).first()
    assert got["precision_at_k"] == pytest.approx(2 / 3) and got["pr_auc"] == pytest.approx((1 + 2 / 3 + 1 / 2) / 3)
    flat = mt.metric_bundle(scored(spark, [2, 2, 2, 2, 2], [0, 1, 0, 0, 1]), ["g"]).first()
    assert flat["pr_auc"] == 0.4 and flat["roc_auc"] == 0.5 and flat["lift"] == 1.0 and flat["base_rate"] == 0.4
    none = mt.metric_bundle(scored(spark, [1, 2], [0, 0]), ["g"]).first()
    assert none["pr_auc"] is None and none["roc_auc"] is None and none["dr_at_1pct_fpr"] is None and none["precision_at_k"] == 0.0


def test_bootstrap_covers_the_plain_bootstrap(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.2).astype(int)
    s = np.round(rng.normal(size=400) + y, 1)
    got = mt.bootstrap_interval(scored(spark, s, y), ["g"], n_boot=400).first()
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    reps = []
    for _ in range(400):
        i = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        reps.append(brute(s[i], y[i])["pr_auc"])
    lo, hi = np.quantile(reps, [0.025, 0.975])
    assert got["point"] == pytest.approx(brute(s, y)["pr_auc"])
    assert abs(got["lo"] - lo) < 0.03 and abs(got["hi"] - hi) < 0.03 and got["n_replicates"] == 400


# ---- result tables --------------------------------------------------------------------------------


def test_wilcoxon_exact_and_tied(spark):
    d = [0.5, -0.1, 0.3, 0.25, 0.9, -0.05, 0.4]
    pairs = spark.createDataFrame([(x, 0.0) for x in d], "first double, second double")
    got = rs.wilcoxon(pairs).first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = ranks[np.array(d) > 0].sum()
    p = np.mean([sum(r for r, k in zip(ranks, keep) if k) >= w for keep in itertools.product([0, 1], repeat=len(d))])
    assert got["w"] == w and got["p_value"] == pytest.approx(p) and got["exact"]
    tied = rs.wilcoxon(spark.createDataFrame([(0.1, 0.0), (0.1, 0.0), (0.0, 0.1), (0.2, 0.0), (0.0, 0.0)], "first double, second double")).first()
    assert tied["n_pairs"] == 4 and not tied["exact"] and 0 < tied["p_value"] < 1


def test_leakage_stop(spark):
    row = [("m", "a", "b", "full_source", 0, 0.9995)]
    with pytest.raises(ValueError):
        rs.fail_on_leakage(spark.createDataFrame(row, "model string, source string, target string, protocol string, seed int, pr_auc double"))


# ---- sequences and importance ---------------------------------------------------------------------


def test_transitions_follow_time_order(spark):
    e = events(spark, [("u", "2024-01-01 10:00:05", "http", "h"), ("u", "2024-01-01 10:00:01", "logon", "h"), ("u", "2024-01-01 12:00:00", "http", "h"),
                       ("u", "2024-01-02 09:00:00", "auth", "h")])
    got = {(str(r["day"]), r["prev"], r["action"]): r["n"] for r in sq.transitions(e).collect()}
    assert got == {("2024-01-01", "<start>", "logon"): 1, ("2024-01-01", "logon", "http"): 1, ("2024-01-01", "http", "http"): 1, ("2024-01-02", "<start>", "auth"): 1}


def test_permutation_importance_finds_the_used_column(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.3).astype(int)
    rows = [("d", f"u{i}", dt.date(2024, 1, 1), int(y[i]), float(y[i] + rng.normal() * 0.1), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "dataset string, user string, day date, label int, used double, noise double")
    got = {r["feature"]: r["importance"] for r in ex.permutation_importance(df, ["used", "noise"], lambda x: F.get(x, F.lit(0))).collect()}
    assert got["noise"] == pytest.approx(0.0) and got["used"] > 0.4


def test_signed_rank_test_is_exact_beyond_twenty_pairs(spark):
    from daymark.operators.results import wilcoxon

    n = 25
    values = [((-1) ** (i % 3 == 0)) * (i + 1) / 7 for i in range(n)]
    row = wilcoxon(spark.createDataFrame([(v, 0.0) for v in values], "first double, second double")).first()
    w = sum(i + 1 for i, v in enumerate(values) if v > 0)
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
    assert row["exact"] and row["w"] == w and abs(row["p_value"] - sum(ways[w:]) / 2**n) < 1e-12


def test_decayed_profile_over_many_years(spark):
    import datetime
    import math

    from daymark.operators.sequences import decayed_profile

    start = datetime.date(1990, 1, 1)
    ages = [0, 3, 650, 720, 721, 5200, 5201, 9000]
    rows = spark.createDataFrame([("u", start + datetime.timedelta(days=a), float(a + 1)) for a in ages], "user string, day date, c double")
    got = {(r["day"] - start).days: r["mem_c"] for r in decayed_profile(rows, ["user"], ["c"]).collect()}
    for a in ages:
        assert math.isclose(got[a], sum((b + 1) * math.exp(-(a - b) / 7) for b in ages if b < a), rel_tol=1e-9, abs_tol=1e-30)


def test_misspelt_options_are_errors():
    import pytest

    from daymark.plans.protocols import factory

    assert factory("random_forest", trees=3)(5).seed == 5
    assert factory("logistic_regression", reg=0.1)(5).reg == 0.1
    with pytest.raises(TypeError):
        factory("random_forest", treees=3)(5)
