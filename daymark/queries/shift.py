"""Queries on the distance between domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.operators import shift as sh
from daymark.queries.common import DOMAINS, rounded, stage, user_days
from daymark.queries.registry import cte, query, sql

_COLS = sc.BASE_COLUMNS
cte(
    "pair_rows",
    f"""
    SELECT * FROM (SELECT *, min(side_n) OVER (PARTITION BY a, b, seed) AS n_balanced FROM (SELECT p.a, p.b, k.seed, u.*,
        CASE WHEN u.dataset = p.b THEN 1 ELSE 0 END AS side,
        row_number() OVER (PARTITION BY p.a, p.b, k.seed, u.dataset ORDER BY md5(k.seed || ':' || u."user" || ':' || u.day), u."user", u.day)
          AS r, count(*) OVER (PARTITION BY p.a, p.b, k.seed, u.dataset) AS side_n
      FROM ud u JOIN (SELECT x.d AS a, y.d AS b FROM (SELECT DISTINCT dataset AS d FROM ud) x, (SELECT DISTINCT dataset AS d FROM ud) y
        WHERE x.d < y.d) p ON u.dataset IN (p.a, p.b), (SELECT unnest([0, 1, 2]) AS seed) k)) WHERE r <= n_balanced
    """,
    "ud",
)
cte(
    "linear_gap",
    "SELECT a, b, seed, count(*) FILTER (side = 0) AS n_used, max(side_n) FILTER (side = 0) AS n_a_full, "
    "max(side_n) FILTER (side = 1) AS n_b_full, " + " + ".join(
        f"pow((avg({c}) FILTER (side = 0) - avg({c}) FILTER (side = 1)) / CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) "
        "ELSE 1 END, 2)" for c in _COLS
    ) + " AS mmd_linear FROM pair_rows GROUP BY ALL",
    "pair_rows",
)


@query(
    "linear_domain_gap",
    sql("SELECT a, b, CAST(seed AS INTEGER) AS seed, n_used, n_a_full, n_b_full, round(mmd_linear, 6) AS mmd_linear FROM linear_gap", "linear_gap"),
)
def linear_domain_gap(spark, sf_dir):
    samples = sh.pair_samples(user_days(spark, sf_dir, staged=True), DOMAINS, seeds=(0, 1, 2))
    return rounded(sh.linear_mmd(samples, _COLS), ["mmd_linear"], 6)


@query(
    "domain_gap_summary",
    sql("SELECT a, b, round(avg(mmd_linear), 6) AS mmd_linear_mean, round(stddev_pop(mmd_linear), 6) AS mmd_linear_std, "
        "count(*) AS n_seeds FROM linear_gap GROUP BY ALL", "linear_gap"),
)
def domain_gap_summary(spark, sf_dir):
    samples = sh.pair_samples(user_days(spark, sf_dir, staged=True), DOMAINS, seeds=(0, 1, 2))
    out = sh.gap_summary(sh.linear_mmd(samples, _COLS), ["mmd_linear"])
    return rounded(out, ["mmd_linear_mean", "mmd_linear_std"], 6)


@query("rbf_domain_gap")
def rbf_domain_gap(spark, sf_dir):
    samples = sh.pair_samples(user_days(spark, sf_dir, staged=True), DOMAINS, seeds=(0, 1, 2))
    return sh.rbf_mmd(samples, _COLS)


_GAPS = " + ".join(f"pow((u.{c} - v.{c}) / s_{c}, 2)" for c in _COLS)
_SIDES = ", ".join(f"CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in _COLS)


@query(
    "rbf_bandwidth",
    sql(f"""SELECT a, b, CAST(seed AS INTEGER) AS seed, round(1 / (2 * d * d), 9) AS gamma FROM (SELECT a, b, seed,
        quantile_disc(d, 0.5) AS d FROM (SELECT a, b, seed, sqrt({_GAPS}) AS d FROM pair_rows u JOIN pair_rows v USING (a, b, seed)
        JOIN (SELECT a, b, seed, {_SIDES} FROM pair_rows GROUP BY ALL) USING (a, b, seed)
        WHERE (u.r - 1) // 2 = (v.r - 1) // 2 AND (u.side = v.side AND u.r < v.r OR u.side < v.side AND u.r = v.r)) WHERE d > 0 GROUP BY ALL)""", "pair_rows"),
)
def rbf_bandwidth(spark, sf_dir):
    """The bandwidth of every pair and seed, from all its rows."""
    samples = sh.pair_samples(user_days(spark, sf_dir, staged=True), DOMAINS, seeds=(0, 1, 2))
    return rounded(sh.bandwidths(samples, _COLS), ["gamma"], 9)


@query("domain_classifier_pairs")
def domain_classifier_pairs(spark, sf_dir):
    """All six pairs of domains under three seeds, told apart by the linear classifier, with both discrepancies."""
    return sh.pairwise_gap(user_days(spark, sf_dir, deviation=True, staged=True), DOMAINS, seeds=(0, 1, 2), models=("lr",))


@query("domain_classifier_gap")
def domain_classifier_gap(spark, sf_dir):
    """All events against all retail rows."""
    f = user_days(spark, sf_dir, deviation=True)
    f = stage(f.withColumn("dataset", F.when(F.col("dataset") == "retail", "retail").otherwise("events")), "two-domains")
    return sh.pairwise_gap(f, ["events", "retail"], seeds=(0,))
