"""Queries on ranking metrics, intervals and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.operators import intervals as iv
from daymark.operators import metrics as mt
from daymark.operators import results as rs
from daymark.operators.splits import chronological_user_days
from daymark.plans.score_grid import grid_predictions
from daymark.queries.common import DOMAINS, SEEDS, result_table, rounded, user_days
from daymark.queries.population import _parts_sql
from daymark.queries.registry import cte, query, sql
from daymark.session import fixed
from daymark.sources import tables as tb

# ---- metrics on plain scores ----------------------------------------------------------------------


def metric_ctes(name: str, scored: str, by: str, order: str, *needs: str) -> None:
    """Blocks ``<name>_curve`` and ``<name>_bundle`` over a block of (by, score, label, order) rows."""
    cte(
        f"{name}_counts",
        f"""SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS np, sum(neg) OVER g AS nn FROM
        (SELECT {by}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {scored} GROUP BY ALL)
        WINDOW w AS (PARTITION BY {by} ORDER BY score DESC), g AS (PARTITION BY {by})""",
        *needs,
    )
    cte(
        f"{name}_curve",
        f"""SELECT {by}, sum(CASE WHEN np > 0 AND nn > 0 THEN pos / np * (tp / (tp + fp)) END) AS pr_auc,
        sum(CASE WHEN np > 0 AND nn > 0 THEN pos / np * ((nn - fp + neg / 2) / nn) END) AS roc_auc,
        CAST(max(np) AS BIGINT) AS n_pos, CAST(max(np) + max(nn) AS BIGINT) AS n FROM {name}_counts GROUP BY {by}""",
        f"{name}_counts",
    )
    cte(
        f"{name}_bundle",
        f"""SELECT c.*, CASE WHEN c.n_pos > 0 AND c.n > c.n_pos THEN d.dr1 END AS dr_at_1pct_fpr,
          CASE WHEN c.n_pos > 0 AND c.n > c.n_pos THEN d.dr5 END AS dr_at_5pct_fpr, k.precision_at_k,
          c.n_pos / c.n AS base_rate, CASE WHEN c.n_pos > 0 THEN pr_auc / (c.n_pos / c.n) END AS lift
        FROM {name}_curve c
        JOIN (SELECT {by}, avg(CASE WHEN score >= t1 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS dr1,
            avg(CASE WHEN score >= t5 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS dr5 FROM {scored} JOIN
            (SELECT {by}, quantile_cont(score, 0.99) FILTER (label = 0) AS t1, quantile_cont(score, 0.95) FILTER (label = 0)
             AS t5 FROM {scored} GROUP BY {by}) USING ({by}) GROUP BY {by}) d USING ({by})
        JOIN (SELECT {by}, avg(label) AS precision_at_k FROM (SELECT {by}, label,
            row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {order}) AS r,
            sum(label) OVER (PARTITION BY {by}) AS p, count(*) OVER (PARTITION BY {by}) AS m FROM {scored})
            WHERE r <= greatest(1, least(p, m)) GROUP BY {by}) k USING ({by})""",
        f"{name}_curve",
    )


cte("ud_scored", 'SELECT dataset, "user", day, label, n_events AS score FROM ud', "ud")
metric_ctes("udm", "ud_scored", "dataset", '"user", day', "ud_scored")
cte("ev_scored", "SELECT dataset, event_id, label, round(value, 1) AS score FROM labelled", "labelled")
metric_ctes("evm", "ev_scored", "dataset", "event_id, label", "ev_scored")

_BUNDLE = ["pr_auc", "roc_auc", "dr_at_1pct_fpr", "dr_at_5pct_fpr", "precision_at_k", "base_rate", "lift"]


def _bundle_sql(block: str) -> str:
    return "SELECT dataset, n, n_pos, " + ", ".join(f"round({c}, 8) AS {c}" for c in _BUNDLE) + f" FROM {block}"


@query("user_day_metrics", sql(_bundle_sql("udm_bundle"), "udm_bundle"))
def user_day_metrics(spark, sf_dir):
    scored = user_days(spark, sf_dir, staged=True).withColumn("score", F.col("n_events"))
    return rounded(mt.metric_bundle(scored, ["dataset"]), _BUNDLE, 8)


@query("event_metrics", sql(_bundle_sql("evm_bundle"), "evm_bundle"))
def event_metrics(spark, sf_dir):
    from daymark.queries.common import labelled_events

    scored = labelled_events(spark, sf_dir).withColumn("score", F.round("value", 1))
    return rounded(mt.metric_bundle(scored, ["dataset"], ["event_id", "label"]), _BUNDLE, 8)


@query(
    "precision_at_fixed_k",
    sql("""SELECT dataset, CAST(max(least(50, m)) AS BIGINT) AS k, round(avg(label), 8) AS precision_at_k FROM (SELECT dataset,
        label, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, "user", day) AS r,
        count(*) OVER (PARTITION BY dataset) AS m FROM ud_scored) WHERE r <= 50 GROUP BY 1""", "ud_scored"),
)
def precision_at_fixed_k(spark, sf_dir):
    scored = user_days(spark, sf_dir, staged=True).withColumn("score", F.col("n_events"))
    r = mt.ranked_scores(scored, ["dataset"])
    out = mt.precision_at_k(scored, r, ["dataset"], ["user", "day"], k=50)
    return rounded(out.withColumn("k", F.col("k").cast("long")), ["precision_at_k"], 8)


@query("stratified_bootstrap")
def stratified_bootstrap(spark, sf_dir):
    scored = user_days(spark, sf_dir, staged=True).withColumn("score", F.col("n_events").cast("double"))
    return mt.bootstrap_interval(scored, ["dataset"], n_boot=1000)


# ---- the experiment grid --------------------------------------------------------------------------

_SEEDS = "[0, 1, 2, 3, 4]"
_BASE = ", ".join(sc.BASE_COLUMNS)
cte("parts5", _parts_sql(0.7, "train", "test", _SEEDS, "round_even(n * 0.7::DOUBLE, 0)"), "ud")
cte(
    "own_rows",
    f"""
    SELECT u.dataset, u."user", u.day, u.label, {_BASE}, seed, 'user_disjoint' AS trained, part
      FROM ud u JOIN parts5 p ON p.dataset = u.dataset AND p."user" = u."user"
    UNION ALL SELECT dataset, "user", day, label, {_BASE}, seed, 'temporal', part FROM day_split, (SELECT unnest({_SEEDS}) AS seed)
    """,
    "ud", "parts5", "day_split",
)
cte(
    "grid_stats",
    "SELECT dataset AS source, trained, seed, " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in sc.BASE_COLUMNS
    ) + " FROM own_rows WHERE part = 'train' GROUP BY ALL",
    "own_rows",
)


def z_sql(columns) -> str:
    return " + ".join(f"greatest(least(({c} - m_{c}) / s_{c}, 8), -8)" for c in columns)


cte(
    "grid_z",
    f"""
    SELECT source, target, protocol, seed, "user", day, label, round({z_sql(sc.COUNT_COLUMNS)}, 6) AS counts_score,
      round({z_sql(sc.BASE_COLUMNS)}, 6) AS all_score
    FROM (SELECT dataset AS target, dataset AS source, trained AS protocol, trained, seed, "user", day, label, {_BASE}
        FROM own_rows WHERE part = 'test'
      UNION ALL SELECT u.dataset, d.source, 'full_source', 'user_disjoint', seed, "user", day, label, {_BASE}
        FROM ud u, (SELECT DISTINCT dataset AS source FROM ud) d, (SELECT unnest({_SEEDS}) AS seed)
        WHERE d.source <> u.dataset) t
    JOIN grid_stats USING (source, trained, seed)
    """,
    "own_rows", "grid_stats", "ud",
)
cte(
    "grid_scored",
    """
    SELECT 'counts' AS model, source, target, protocol, seed, "user", day, label, counts_score AS score FROM grid_z
    UNION ALL SELECT 'all', source, target, protocol, seed, "user", day, label, all_score FROM grid_z
    """,
    "grid_z",
)
metric_ctes("grid", "grid_scored", "model, source, target, protocol, seed", '"user", day', "grid_scored")
cte(
    "results",
    "SELECT *, n_pos / n AS base_rate, CASE WHEN n_pos > 0 THEN pr_auc / (n_pos / n) END AS lift FROM grid_curve",
    "grid_curve",
)
_CELL = "model, source, target, protocol, seed"
_RES = ["pr_auc", "roc_auc", "base_rate", "lift"]


@query(
    "transfer_grid",
    sql(f"SELECT {_CELL}, n, n_pos, " + ", ".join(f"round({c}, 7) AS {c}" for c in _RES) + " FROM results", "results"),
)
def transfer_grid(spark, sf_dir):
    return rounded(result_table(spark, sf_dir), _RES, 7).select(*rs.CELL, "n", "n_pos", *_RES)




def boot_sql(source: str, value: str, seed: int, prefix: str, cell: str = "model, source, target, protocol") -> str:
    """Seed bootstrap of ``value`` per cell: the same hash draws, as joins."""
    return f"""
    SELECT {cell}, round(any_value(m), 6) AS {prefix}_mean, round(quantile_cont(b, 0.025), 6) AS {prefix}_lo,
      round(quantile_cont(b, 0.975), 6) AS {prefix}_hi, any_value(n) AS n_seeds
    FROM (SELECT {cell}, avg(x) AS m, count(x) AS n, list(x ORDER BY seed) FILTER (x IS NOT NULL) AS v
        FROM (SELECT *, {value} AS x FROM {source}) GROUP BY {cell}) c
    LEFT JOIN LATERAL (SELECT avg(v[1 + CAST(floor(u * c.n) AS BIGINT)]) AS b FROM
        (SELECT rep, slot, CAST(('0x' || substr(md5('{seed}:' || rep || ':' || slot), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE
         AS u FROM range(5000) r(rep), range(5) s(slot)) WHERE slot < c.n GROUP BY rep) ON true
    GROUP BY {cell}"""


_PROTO = ["model", "source", "target", "protocol"]


@query("seed_bootstrap_intervals", sql(boot_sql("results", "pr_auc", 0, "pr_auc"), "results"))
def seed_bootstrap_intervals(spark, sf_dir):
    out = iv.seed_bootstrap(result_table(spark, sf_dir), _PROTO, "pr_auc", "pr_auc")
    return rounded(out, ["pr_auc_mean", "pr_auc_lo", "pr_auc_hi"], 6)


cte(
    "paired",
    """
    SELECT source, target, protocol, seed, max(pr_auc) FILTER (model = 'all') - max(pr_auc) FILTER (model = 'counts') AS delta
    FROM results GROUP BY ALL
    """,
    "results",
)
_WORDS = """SELECT *, CASE WHEN delta_lo > 0 AND delta_hi > 0 THEN 'A' WHEN delta_hi < 0 AND delta_lo < 0 THEN 'C' ELSE 'B' END
      AS interval_class,
    CASE WHEN delta_lo > 0 AND delta_hi > 0 THEN 'SUPPORTED' WHEN delta_hi < 0 AND delta_lo < 0 THEN 'RF_SUPPORTED'
      ELSE 'NOT_SUPPORTED' END AS interval_status,
    coalesce(delta_mean > 0 AND delta_lo > 0, false) AS holds,
    CASE WHEN delta_mean IS NULL THEN 'No' WHEN delta_mean > 0 AND delta_lo > 0 THEN 'Yes' WHEN delta_mean <= 0 THEN 'RF'
      ELSE 'No' END AS hold_label FROM ("""
_DELTA = sql(boot_sql("paired", "delta", 0, "delta", "source, target, protocol"), "paired")
_SIDE = ["source", "target", "protocol"]


@query("paired_model_delta", _WORDS + _DELTA + ")")
def paired_model_delta(spark, sf_dir):
    out = iv.paired_delta(result_table(spark, sf_dir), _SIDE, "all", "counts")
    return rounded(out, ["delta_mean", "delta_lo", "delta_hi"], 6)


@query(
    "verdict_counts",
    "SELECT protocol, hold_label, count(*) AS n_cells, count(*) FILTER (holds) AS n_holds FROM (" + _WORDS + _DELTA
    + ")) GROUP BY ALL",
)
def verdict_counts(spark, sf_dir):
    out = iv.paired_delta(result_table(spark, sf_dir), _SIDE, "all", "counts")
    return out.groupBy("protocol", "hold_label").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("holds").alias("n_holds")
    )


@query(
    "seed_paired_models",
    sql("""SELECT source, target, protocol, seed, round(max(pr_auc) FILTER (model = 'all'), 7) AS pr_auc_first,
        round(max(pr_auc) FILTER (model = 'counts'), 7) AS pr_auc_second FROM results GROUP BY ALL""", "results"),
)
def seed_paired_models(spark, sf_dir):
    out = iv.pair_models(result_table(spark, sf_dir), _SIDE, "all", "counts", ["pr_auc"])
    return rounded(out, ["pr_auc_first", "pr_auc_second"], 7)


@query(
    "seed_summary",
    "SELECT p.*, l.lift_mean, l.lift_lo, l.lift_hi, b.base_rate, b.pr_auc_seeds FROM (" + sql(
        boot_sql("results", "pr_auc", 0, "pr_auc"), "results") + ") p JOIN (" + sql(
        boot_sql("results", "lift", 1, "lift"), "results") + ") l USING (model, source, target, protocol) JOIN (" + sql(
        """SELECT model, source, target, protocol, round(avg(base_rate), 7) AS base_rate,
        string_agg(coalesce(format('{:.4f}', pr_auc), 'nan'), ';' ORDER BY seed) AS pr_auc_seeds
        FROM results GROUP BY ALL""", "results") + ") b USING (model, source, target, protocol)",
)
def seed_summary(spark, sf_dir):
    out = rs.seed_summary(result_table(spark, sf_dir), _PROTO, digits=4)
    six = [f"{v}_{e}" for v in ("pr_auc", "lift") for e in ("mean", "lo", "hi")]
    return rounded(rounded(out, six, 6), ["base_rate"], 7)


_CM = ["pr_auc_mean", "pr_auc_sd", "lift_mean", "base_rate", "n", "n_pos"]


@query(
    "cell_means",
    sql("""SELECT model, source, target, protocol, round(avg(pr_auc), 6) AS pr_auc_mean, round(stddev_samp(pr_auc), 6) AS
        pr_auc_sd, round(avg(lift), 6) AS lift_mean, round(avg(base_rate), 6) AS base_rate, round(avg(n), 6) AS n,
        round(avg(n_pos), 6) AS n_pos, count(DISTINCT seed) AS n_seeds, target IN ('ev0', 'ev1', 'retail') AS evaluable_target
        FROM results GROUP BY ALL""", "results"),
)
def cell_means(spark, sf_dir):
    return rounded(rs.cell_means(result_table(spark, sf_dir), evaluable=["ev0", "ev1", "retail"]), _CM, 6)


_GAP = ["diag_mean", "off_mean", "gap"]


@query(
    "gap_plain",
    sql("SELECT model, v AS metric, round(avg(x) FILTER (source = target), 6) AS diag_mean, round(avg(x) FILTER (source <> target), 6) "
        "AS off_mean, round(avg(x) FILTER (source = target) - avg(x) FILTER (source <> target), 6) AS gap FROM "
        "(SELECT *, 'pr_auc' AS v, pr_auc AS x FROM results UNION ALL SELECT *, 'lift', lift FROM results) GROUP BY ALL", "results"),
)
def gap_plain(spark, sf_dir):
    r = result_table(spark, sf_dir)
    both = [rs.plain_gap(r, v).withColumn("metric", F.lit(v)) for v in ("pr_auc", "lift")]
    return rounded(both[0].unionByName(both[1]), _GAP, 6)


def _gap_sql(protocol: str, where: str = "true") -> str:
    return f"""SELECT model, count(x) FILTER (source = target) AS n_diag, count(x) FILTER (source <> target) AS n_pairs,
    round(avg(x) FILTER (source = target), 6) AS diag_mean, round(avg(x) FILTER (source <> target), 6) AS off_mean,
    round(avg(x) FILTER (source = target) - avg(x) FILTER (source <> target), 6) AS gap
    FROM (SELECT model, source, target, avg(pr_auc) AS x FROM results WHERE (source <> target OR protocol = '{protocol}')
      AND {where} GROUP BY ALL) GROUP BY 1"""


@query("gap_user_disjoint", sql(_gap_sql("user_disjoint"), "results"))
def gap_user_disjoint(spark, sf_dir):
    return rounded(rs.protocol_gap(result_table(spark, sf_dir)), _GAP, 6)


_EVALUABLE = ["ev0", "ev1", "retail"]


@query(
    "gap_evaluable_targets",
    sql("SELECT *, 'user_disjoint' AS protocol FROM (" + _gap_sql("user_disjoint", "target IN ('ev0', 'ev1', 'retail')")
        + ") UNION ALL SELECT *, 'temporal' FROM (" + _gap_sql("temporal", "target IN ('ev0', 'ev1', 'retail')") + ")", "results"),
)
def gap_evaluable_targets(spark, sf_dir):
    r = result_table(spark, sf_dir)
    both = [rs.protocol_gap(r, p, _EVALUABLE).withColumn("protocol", F.lit(p)) for p in ("user_disjoint", "temporal")]
    return rounded(both[0].unionByName(both[1]), _GAP, 6)


@query(
    "matrix_view",
    sql("SELECT model, protocol, source, " + ", ".join(
        f"round(avg(pr_auc) FILTER (target = '{d}'), 6) AS {d}" for d in DOMAINS) + " FROM results GROUP BY ALL", "results"),
)
def matrix_view(spark, sf_dir):
    return rounded(rs.matrix_view(result_table(spark, sf_dir), DOMAINS), DOMAINS, 6)


@query(
    "matched_cells",
    sql("""SELECT source, target, round(avg(pr_auc) FILTER (model = 'all'), 6) AS "first", round(avg(pr_auc) FILTER (model = 'counts'),
        6) AS "second", target IN ('ev0', 'ev1', 'retail') AS evaluable_target FROM results WHERE source <> target GROUP BY ALL""",
        "results"),
)
def matched_cells(spark, sf_dir):
    return rounded(rs.matched_cells(result_table(spark, sf_dir), "all", "counts", _EVALUABLE), ["first", "second"], 6)


@query(
    "missing_cells",
    sql("""SELECT m.model, s.d AS source, t.d AS target, p.protocol, CAST(k.seed AS INTEGER) AS seed
        FROM (SELECT unnest(['all', 'counts', 'tree']) AS model) m, (SELECT DISTINCT dataset AS d FROM ud) s,
        (SELECT DISTINCT dataset AS d FROM ud) t, (SELECT unnest(['user_disjoint', 'temporal', 'full_source']) AS protocol) p,
        (SELECT unnest([0, 1, 2, 3, 4, 5]) AS seed) k
        WHERE (s.d = t.d) = (p.protocol <> 'full_source') AND NOT EXISTS (SELECT 1 FROM results r WHERE r.model = m.model
        AND r.source = s.d AND r.target = t.d AND r.protocol = p.protocol AND r.seed = k.seed)""", "ud", "results"),
)
def missing_cells(spark, sf_dir):
    grid = rs.job_grid(spark, ["all", "counts", "tree"], DOMAINS, range(6))
    return rs.missing_cells(grid, result_table(spark, sf_dir))


@query(
    "keep_best_rows",
    sql("""SELECT model, source, target, protocol, seed, round(pr_auc, 7) AS pr_auc, run FROM (SELECT *, row_number() OVER (
        PARTITION BY model, source, target, protocol, seed ORDER BY (roc_auc IS NOT NULL) DESC, run DESC) AS r FROM
        (SELECT *, CAST(1 AS INTEGER) AS run FROM results UNION ALL
         SELECT * REPLACE (pr_auc / 2 AS pr_auc, CASE WHEN seed % 2 = 0 THEN NULL ELSE roc_auc END AS roc_auc), 2 FROM results))
        WHERE r = 1""", "results"),
)
def keep_best_rows(spark, sf_dir):
    """A rerun halves every value and loses the ROC value of even seeds."""
    r = result_table(spark, sf_dir)
    rerun = r.withColumn("pr_auc", F.col("pr_auc") / 2).withColumn(
        "roc_auc", F.when(F.col("seed") % 2 == 0, F.lit(None)).otherwise(F.col("roc_auc"))
    )
    both = r.withColumn("run", F.lit(1)).unionByName(rerun.withColumn("run", F.lit(2)))
    return rounded(rs.keep_best(both), ["pr_auc"], 7).select(*rs.CELL, "pr_auc", "run")


@query(
    "appended_result_rows",
    sql("""SELECT model, source, target, protocol, seed, round(pr_auc, 7) AS pr_auc, NULL::DOUBLE AS epoch_seconds FROM results
        UNION ALL SELECT 'extra', dataset, dataset, 'user_disjoint', 0, NULL, CAST(count(*) AS DOUBLE) FROM ud GROUP BY dataset""",
        "results", "ud"),
)
def appended_result_rows(spark, sf_dir):
    from daymark.sources.cache import append_rows

    old = rounded(result_table(spark, sf_dir), ["pr_auc"], 7).select(*rs.CELL, "pr_auc")
    new = user_days(spark, sf_dir).groupBy(F.col("dataset").alias("source")).agg(
        F.count(F.lit(1)).cast("double").alias("epoch_seconds")
    ).select(F.lit("extra").alias("model"), "source", F.col("source").alias("target"),
             F.lit("user_disjoint").alias("protocol"), F.lit(0).alias("seed"), "epoch_seconds")
    return append_rows(old, new)


@query(
    "long_form_results",
    sql("""SELECT source, target, model, CAST(seed AS INTEGER) AS seed, round(pr_auc, 7) AS pr_auc, round(roc_auc, 7) AS roc_auc,
        round(base_rate, 7) AS prevalence, round(lift, 6) AS lift, protocol AS diagonal_protocol,
        CASE WHEN source = target THEN 'diagonal' ELSE 'off_diagonal' END AS cell_kind, NULL::DOUBLE AS wall_s,
        NULL::DOUBLE AS peak_rss_gb, n_pos, NULL::BIGINT AS n_pos_source, NULL::BIGINT AS n_pos_target, NULL::INTEGER AS epochs
        FROM results""", "results"),
)
def long_form_results(spark, sf_dir):
    out = rs.long_form(result_table(spark, sf_dir))
    return rounded(rounded(out, ["pr_auc", "roc_auc", "prevalence"], 7), ["lift"], 6)


@query(
    "leakage_flags",
    sql("""SELECT model, source, target, protocol, seed, coalesce(source = target AND pr_auc >= 0.95, false) AS inspect_diagonal,
        coalesce(source = target AND pr_auc >= 0.9999, false) AS stop_saturated,
        coalesce(source <> target AND pr_auc >= 0.999, false) AS stop_off_diagonal FROM results""", "results"),
)
def leakage_flags(spark, sf_dir):
    return rs.leakage_flags(result_table(spark, sf_dir)).select(
        *rs.CELL, "inspect_diagonal", "stop_saturated", "stop_off_diagonal"
    )


@query(
    "drift_check",
    sql("""SELECT model, source, target, protocol, n_seeds, round(m, 6) AS pr_auc_mean, round(m - e, 6) AS difference,
        CASE WHEN n_seeds < 5 THEN 'too_few_seeds' WHEN abs(m - e) <= 0.08 THEN 'ok' ELSE 'drift' END AS status
        FROM (SELECT model, source, target, protocol, avg(pr_auc) AS m, count(pr_auc) AS n_seeds FROM results GROUP BY ALL)
        JOIN (SELECT source, target, protocol, avg(pr_auc) AS e FROM results WHERE model = 'counts' GROUP BY ALL)
        USING (source, target, protocol) WHERE model = 'all'""", "results"),
)
def drift_check(spark, sf_dir):
    """The full feature set judged against the counts-only means."""
    r = result_table(spark, sf_dir)
    expected = r.filter("model = 'counts'").groupBy(*_SIDE).agg(F.avg("pr_auc").alias("expected"))
    out = rs.drift_check(r.filter("model = 'all'"), expected.withColumn("model", F.lit("all")))
    return rounded(out.drop("expected"), ["pr_auc_mean", "difference"], 6)


cte(
    "signed",
    """
    SELECT d FROM (SELECT avg(pr_auc) FILTER (model = 'all') - avg(pr_auc) FILTER (model = 'counts') AS d FROM results
      WHERE source <> target GROUP BY source, target) WHERE d <> 0
    """,
    "results",
)


@query(
    "wilcoxon_over_cells",
    sql("""SELECT any_value(n) AS n_pairs, round(any_value(w), 4) AS w, round(avg(CASE WHEN total >= w - 1e-9 THEN 1.0 ELSE 0.0 END), 8)
        AS p_value, true AS exact FROM (SELECT code, any_value(n) AS n, any_value(w) AS w,
          coalesce(sum(r) FILTER ((code >> i) & 1 = 1), 0) AS total
        FROM (SELECT *, rank() OVER (ORDER BY abs(d)) AS r, row_number() OVER (ORDER BY abs(d)) - 1 AS i, count(*) OVER () AS n
          FROM signed), (SELECT coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w FROM (SELECT d, rank() OVER (ORDER BY abs(d)) AS r
          FROM signed)), (SELECT unnest(range(1 << (SELECT count(*) FROM signed))) AS code) GROUP BY code)""", "signed"),
)
def wilcoxon_over_cells(spark, sf_dir):
    pairs = rs.matched_cells(result_table(spark, sf_dir), "all", "counts", _EVALUABLE)
    return rounded(rounded(rs.wilcoxon(pairs), ["w"], 4), ["p_value"], 8)


@query(
    "integrity_check",
    sql("""SELECT model, source, target, protocol, seed, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos,
        CAST(count(*) FILTER (score IS NULL OR isnan(score) OR isinf(score)) AS BIGINT) AS n_not_finite,
        CAST(count(*) - count(DISTINCT ("user", day)) AS BIGINT) AS n_repeated, true AS passed FROM grid_scored GROUP BY ALL""",
        "grid_scored"),
)
def integrity_check(spark, sf_dir):
    return rs.integrity(grid_predictions(user_days(spark, sf_dir, staged=True), DOMAINS, SEEDS))


@query(
    "named_tokens",
    sql("""SELECT 'T:' || model || '-' || source || '-' || target || '-' || protocol || '-pr' AS token,
        format('{:.3f}', m) AS value FROM (SELECT model, source, target, protocol, avg(pr_auc) AS m, avg(lift) AS l FROM results
        GROUP BY ALL) WHERE m IS NOT NULL UNION ALL
        SELECT 'T:' || model || '-' || source || '-' || target || '-' || protocol || '-lift', format('{:.2f}', l)
        FROM (SELECT model, source, target, protocol, avg(pr_auc) AS m, avg(lift) AS l FROM results GROUP BY ALL)
        WHERE l IS NOT NULL UNION ALL SELECT 'T:tree-ev0-ev1-full_source-pr', NULL""", "results"),
)
def named_tokens(spark, sf_dir):
    means = rs.cell_means(result_table(spark, sf_dir))
    wanted = ["T:tree-ev0-ev1-full_source-pr", "T:all-ev0-ev1-full_source-pr"]
    found, absent = rs.tokens(means, wanted)
    return found.unionByName(absent.withColumn("value", F.lit(None).cast("string")))


cte(
    "distances",
    "SELECT least(x.d, y.d) AS a, greatest(x.d, y.d) AS b, "
    + " + ".join(f"(x.m_{c} - y.m_{c}) * (x.m_{c} - y.m_{c}) / v.s_{c}" for c in sc.BASE_COLUMNS)
    + " AS distance FROM (SELECT dataset AS d, " + ", ".join(f"avg({c}) AS m_{c}" for c in sc.BASE_COLUMNS)
    + " FROM ud GROUP BY 1) x JOIN (SELECT dataset AS d, " + ", ".join(f"avg({c}) AS m_{c}" for c in sc.BASE_COLUMNS)
    + " FROM ud GROUP BY 1) y ON x.d < y.d, (SELECT "
    + ", ".join(f"CASE WHEN var_pop({c}) > 1e-24 THEN var_pop({c}) ELSE 1 END AS s_{c}" for c in sc.BASE_COLUMNS) + " FROM ud) v",
    "ud",
)


def _distances(f):
    """Distance of two domains' mean vectors on pooled scale, over all base features."""
    cols = sc.BASE_COLUMNS
    means = f.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in cols])
    scale = f.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    one, other = means.toDF("a", *[f"a_{c}" for c in cols]), means.toDF("b", *[f"b_{c}" for c in cols])
    gap = [F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) / F.lit(scale[c] if (scale[c] or 0) > 1e-24 else 1.0) for c in cols]
    return one.join(other, F.col("a") < F.col("b")).select("a", "b", sum(gap[1:], gap[0]).alias("distance"))


@query(
    "distance_against_lift",
    sql("""SELECT model, source, target, round(l, 6) AS lift, round(distance, 6) AS distance FROM (SELECT model, source, target,
        avg(lift) AS l FROM results WHERE source <> target GROUP BY ALL) r JOIN distances d ON d.a = least(source, target)
        AND d.b = greatest(source, target)""", "results", "distances"),
)
def distance_against_lift(spark, sf_dir):
    out = rs.distance_with_lift(result_table(spark, sf_dir), _distances(user_days(spark, sf_dir, staged=True)))
    return rounded(out, ["lift", "distance"], 6)


@query(
    "distance_lift_correlation",
    sql("""SELECT model, count(*) AS n_cells, round(corr(distance, l), 6) AS r FROM (SELECT model, source, target,
        avg(lift) AS l FROM results WHERE source <> target GROUP BY ALL) r JOIN distances d ON d.a = least(source, target)
        AND d.b = greatest(source, target) GROUP BY 1""", "results", "distances"),
)
def distance_lift_correlation(spark, sf_dir):
    pairs = rs.distance_with_lift(result_table(spark, sf_dir), _distances(user_days(spark, sf_dir, staged=True)))
    out = rs.pearson(pairs, "distance", "lift", ["source", "target"], by=["model"])
    return rounded(out.drop("p_value"), ["r"], 6)


@query("distance_lift_permutation_p")
def distance_lift_permutation_p(spark, sf_dir):
    pairs = rs.distance_with_lift(result_table(spark, sf_dir), _distances(user_days(spark, sf_dir, staged=True)))
    return rs.pearson(pairs, "distance", "lift", ["source", "target"], by=["model"])


@query(
    "spearman_over_cells",
    sql("""SELECT protocol, count(*) AS n, round(corr(ra, rc), 6) AS rho FROM (SELECT protocol,
        rank() OVER (PARTITION BY protocol ORDER BY a) + (count(*) OVER (PARTITION BY protocol, a) - 1) / 2 AS ra,
        rank() OVER (PARTITION BY protocol ORDER BY c) + (count(*) OVER (PARTITION BY protocol, c) - 1) / 2 AS rc
        FROM (SELECT protocol, seed, source, target, max(round(pr_auc, 7)) FILTER (model = 'all') AS a,
          max(round(pr_auc, 7)) FILTER (model = 'counts') AS c FROM results GROUP BY ALL) WHERE a IS NOT NULL AND c IS NOT NULL)
        GROUP BY 1""", "results"),
)
def spearman_over_cells(spark, sf_dir):
    pairs = iv.pair_models(rounded(result_table(spark, sf_dir), ["pr_auc"], 7), _SIDE, "all", "counts", ["pr_auc"])
    pairs = pairs.filter("pr_auc_first IS NOT NULL AND pr_auc_second IS NOT NULL")
    return rounded(rs.spearman(pairs, "pr_auc_first", "pr_auc_second", ["protocol"]), ["rho"], 6)


cte(
    "feature_means",
    " UNION ALL ".join(f"SELECT dataset, '{c}' AS feature, round(avg({c}), 9) AS value FROM ud GROUP BY 1" for c in sc.BASE_COLUMNS),
    "ud",
)


@query(
    "rank_agreement",
    sql("""SELECT a, b, feature, rank_a, rank_b, round(1 - abs(rank_a - rank_b) / 20, 6) AS rank_similarity FROM (
        SELECT x.dataset AS a, y.dataset AS b, feature, x.r AS rank_a, y.r AS rank_b FROM (SELECT *,
          rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS r FROM feature_means) x
        JOIN (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS r
          FROM feature_means) y USING (feature) WHERE x.dataset < y.dataset)""", "feature_means"),
)
def rank_agreement(spark, sf_dir):
    """Features ranked by their mean, for every pair of domains."""
    from itertools import combinations

    from daymark.operators.explain import rank_similarity, unpivot

    f = user_days(spark, sf_dir)
    means = f.groupBy("dataset").agg(*[F.round(F.avg(c), 9).alias(c) for c in sc.BASE_COLUMNS])
    long = fixed(unpivot(means, ["dataset"], sc.BASE_COLUMNS))  # one row a domain and feature
    out = None
    for a, b in combinations(DOMAINS, 2):
        value = lambda d: F.max(F.when(F.col("dataset") == d, F.col("value")))
        one = rank_similarity(long.groupBy("feature").agg(value(a).alias("a"), value(b).alias("b")), "a", "b")
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "feature", "rank_a", "rank_b", "rank_similarity")
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["rank_similarity"], 6)
