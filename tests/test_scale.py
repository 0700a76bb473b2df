"""Steps that were made to move or hold fewer rows: the results are those of the plain versions."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from daymark.operators import explain as ex
from daymark.operators import shift as sh
from daymark.operators.detectors import LogisticDetector, Nodes, Scaler, spread
from daymark.operators.metrics import pr_roc
from daymark.operators.results import CELL
from daymark.plans import score_grid as sg
from daymark.queries import streams as st
from daymark.schema import BASE_COLUMNS
from daymark.streaming import deviation as dv


def test_pairs_rank_a_domain_once(spark):
    """Ranks are those of the whole domain in hash order, and no domain keeps more rows than its largest partner has."""
    day = dt.date(2024, 1, 1)
    sizes = {"a": 3, "b": 5, "c": 40}
    rows = [(d, f"{d}{i % 33}", day, float(i)) for d, n in sizes.items() for i in range(n)]  # c has repeated users
    df = spark.createDataFrame(rows, "dataset string, user string, day date, x double")
    ranks, found = sh.domain_ranks(df, ["a", "b", "c"], (0, 7))
    assert found == sizes
    assert {(r["dataset"], r["seed"]): r["n"] for r in ranks.groupBy("dataset", "seed").agg(F.count("*").alias("n")).collect()} == {
        (d, s): n for d, n in (("a", 3), ("b", 5), ("c", 5)) for s in (0, 7)}
    got = {}
    for r in sh.pair_samples(df, ["a", "b", "c"], (0, 7)).collect():
        assert r["n_balanced"] == min(sizes[r["a"]], sizes[r["b"]]) and (r["n_a_full"], r["n_b_full"]) == (sizes[r["a"]], sizes[r["b"]])
        assert r["side"] == int(r["dataset"] == r["b"])
        got.setdefault((r["a"], r["b"], r["seed"], r["dataset"]), []).append((r["rank"], r["user"]))
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        for seed in (0, 7):
            for d in (a, b):
                users = sorted((hashlib.md5(f"{seed}:{u}:{day}".encode()).hexdigest(), u) for x, u, *_ in rows if x == d)
                assert sorted(got[a, b, seed, d]) == [(i + 1, u) for i, (_, u) in enumerate(users[: min(sizes[a], sizes[b])])]


def test_nearest_nodes_are_those_of_a_full_scan():
    """Every row's distances, with equal points, points at equal distances, own names and fewer points than groups."""
    rng = np.random.default_rng(3)
    for n, k in ((5, 8), (40, 3), (3000, 8)):
        points = rng.integers(0, 3, (n, 4)).astype(float)
        names = sorted(f"u{i % (n - 1)}" for i in range(n))
        x = rng.integers(0, 3, (150, 4)) + rng.choice([0.0, 0.25], (150, 4))
        own = [names[i % n] if i % 2 else f"t{i}" for i in range(150)]
        got = Nodes(names, points).nearest(x, own, k)
        for row, name, places in zip(x, own, got):
            dist = ((points - row) ** 2).sum(axis=1)
            dist[np.array(names) == name] = np.inf
            assert len(set(places.tolist())) == min(k, n)
            assert np.allclose(np.sort(dist[places]), np.sort(dist)[: min(k, n)])


def test_folded_grid_equals_the_grid_of_single_rows(spark):
    """Rows with equal features are counted once, also for rows without a user and repeated rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        user = None if i % 40 == 7 else f"u{i % 24}"
        rows.append((f"d{i % 3}", user, dt.date(2024, 1, 1 + i % 17), int(rng.random() < 0.3), *[float(v) for v in rng.integers(0, 3, len(BASE_COLUMNS))]))
    rows += rows[:30]
    df = spark.createDataFrame(rows, "dataset string, user string, day date, label int, " + ", ".join(f"{c} double" for c in BASE_COLUMNS))
    domains = ["d0", "d1", "d2"]
    found = {tuple(r[c] for c in CELL): r for r in sg.grid_results(df, domains, [0, 4]).collect()}
    plain = {tuple(r[c] for c in CELL): r for r in pr_roc(sg.grid_predictions(df, domains, [0, 4]), CELL).collect()}
    assert set(found) == set(plain) and len(found) == 48
    for cell, r in plain.items():
        for c in ("n", "n_pos", "pr_auc", "roc_auc", "lift"):
            assert (found[cell][c] is None and r[c] is None) or abs(found[cell][c] - r[c]) < 1e-9, (cell, c)
    kinds = sg.folded(df, ["dataset", "label", *BASE_COLUMNS], F.count(F.lit(1)))
    assert kinds.agg(F.sum("times")).first()[0] == len(rows) and kinds.count() < len(rows)


def test_arrivals_keep_days_together(spark):
    """Whole days in order, about the wanted size each; every event arrives once, and events without a time do not arrive."""
    rows = [(dt.datetime(2024, 1, 1 + d, h % 24), f"e{d}-{h}") for d, n in enumerate((5, 1, 7, 2, 2, 2)) for h in range(n)]
    df = spark.createDataFrame([*rows, (None, "none")], "timestamp timestamp_ntz, event_id string")
    got = {r["event_id"]: (r["arrival"], r["timestamp"].date()) for r in st._arrivals(df, 4).collect()}
    assert set(got) == {e for _, e in rows}
    by_day = {day: {a for a, d in got.values() if d == day} for _, day in got.values()}
    assert all(len(a) == 1 for a in by_day.values())
    order = [min(by_day[d]) for d in sorted(by_day)]
    assert order == sorted(order) and len(set(order)) == 4


def test_deviation_state_is_kept_per_bucket():
    """Two batches of a bucket of users equal one batch, with a user that comes later and one without a name."""
    class State:
        value = None
        reads = 0
        exists = lambda self: self.value is not None

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.value = value

    days = pd.DataFrame([("d", u, dt.date(2024, 1, n), float(n * n % 7)) for n in range(1, 9) for u in ("a", None, "b", "c") if u != "c" or n > 5],
                        columns=["dataset", "user", "day", "x"])

    def run(parts):
        processor = dv.EarlierDays(["x"])
        processor.state = State()
        out = pd.concat([next(processor.handleInputRows(("d", 0), iter([p]), None)) for p in parts])
        return {(r.user if isinstance(r.user, str) else None, r.day): r.dev_x for r in out.itertuples()}, processor.state

    late = days["day"] > dt.date(2024, 1, 4)
    whole, _ = run([days])
    found, state = run([days[~late], days[late]])
    assert state.reads == 1 and sorted(map(str, state.value[0])) == ["None", "a", "b", "c"]
    assert set(found) == set(whole) and all(abs(found[k] - whole[k]) < 1e-12 for k in whole)


def test_rows_of_permutations_are_not_sent_to_the_driver(spark, monkeypatch):
    """Neither side of the join of rows and donors is broadcast, whatever its size."""
    plans = []
    real = ex.pr_roc
    monkeypatch.setattr(ex, "pr_roc", lambda scored, by: (plans.append(scored._jdf.queryExecution().executedPlan().toString()), real(scored, by))[1])
    rows = [("d", f"u{i}", dt.date(2024, 1, 1), i % 2, float(i), float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "dataset string, user string, day date, label int, p double, q double")
    found = {r["feature"]: r["importance"] for r in ex.permutation_importance(df, ["p", "q"], lambda x: F.get(x, F.lit(0))).collect()}
    assert set(found) == {"p", "q"} and found["q"] == 0
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_scaled_vectors_are_those_of_the_columns(spark):
    """Also for nulls, NaN, infinities and values beyond the bound; deviation columns are clipped only."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2.0, 0.5), (2, None, 3.0), (None, nan, -20.0), (4, inf, None), (5, -inf, nan), (600, 1e9, 9.0), (7, -1e9, -0.0)]
    df = spark.createDataFrame(rows, "p int, q double, dev_p double")
    scaler = Scaler(["p", "q", "dev_p"], {"p": 3.0, "q": 0.25}, {"p": 1.7, "q": 0.3})
    for some in (df, df.limit(0)):
        got = some.select("*", scaler.vectors(), *[scaler.column(c).alias(f"_{c}") for c in scaler.columns]).collect()
        assert len(got) == some.count()
        for r in got:
            assert r["features"].toArray().tolist() == [r["_p"], r["_q"], r["_dev_p"]]


def test_logistic_fit_moves_its_rows_once(spark):
    """The estimator reads its input several times; the rows are scaled and shuffled for the first only, and let go afterwards."""
    seen = spark.sparkContext.accumulator(0)
    rows = [("d", f"u{i}", dt.date(2024, 1, 1), i % 2, float(i % 7), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "dataset string, user string, day date, label int, p double, q double")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = spark.sparkContext._jsc.getPersistentRDDs().size()
    watched = df.mapInArrow(counted, df.schema)
    LogisticDetector(columns=["p", "q"]).fit(watched)
    assert seen.value == 3 * len(rows)  # the class counts, the scale and the fit
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == base


def test_partitions_of_a_fit_grow_before_there_are_more(spark):
    parts = lambda n, most=250_000: spread(spark.range(10), n, most=most).rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    assert parts(1) == 1 and parts(60_000) == 3
    assert parts(11_000_000) == max(44, 4 * cores) and parts(1_100_000_000) == 4400 and parts(11_000_000, None) == 550
