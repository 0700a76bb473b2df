"""Queries on joins, sampling, splits and dataset composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.operators import compose as cp
from daymark.operators import features as ft
from daymark.operators import labels as lb
from daymark.operators import sampling as sm
from daymark.operators import splits as sp
from daymark.queries.common import labelled_events, rounded, user_days
from daymark.queries.registry import cte, draw_sql, query, sql
from daymark.sources import tables as tb



def _web():
    return F.col("action") == "http"


DRAW7 = draw_sql("'7'", "event_id")

# ---- joins ----------------------------------------------------------------------------------------


@query(
    "label_attach",
    sql('SELECT dataset, "user", day, insider_type, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos '
        "FROM labelled GROUP BY ALL", "labelled"),
)
def label_attach(spark, sf_dir):
    return labelled_events(spark, sf_dir).groupBy("dataset", "user", "day", "insider_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos")
    )


@query(
    "roster_flag",
    sql('SELECT dataset, (dataset, "user") IN (SELECT (dataset, "user") FROM roster) AS on_roster, count(*) AS n, '
        'count(DISTINCT "user") AS n_users FROM raw GROUP BY ALL', "raw", "roster"),
)
def roster_flag(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return lb.flag_roster(raw, tb.roster(raw)).groupBy("dataset", "on_roster").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("n_users")
    )


cte(
    "in_span",
    """
    SELECT r.*, EXISTS (SELECT 1 FROM spans s WHERE s.host = r.src_host AND r."timestamp" BETWEEN s."start" AND s."end")
      AS in_interval FROM raw r
    """,
    "raw", "spans",
)


@query(
    "interval_label_join",
    sql('SELECT dataset, event_id, src_host, "timestamp" FROM in_span WHERE in_interval', "in_span"),
)
def interval_label_join(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return lb.in_interval(raw, tb.intervals(raw)).select("dataset", "event_id", "src_host", "timestamp")


cte(
    "dominant",
    """
    SELECT host, day, "user" AS dominant_user, n AS n_logons FROM (SELECT *, row_number() OVER (PARTITION BY host, day
      ORDER BY n DESC, "user") AS r FROM (SELECT src_host AS host, day, "user", count(*) AS n FROM raw
      WHERE action = 'logon' GROUP BY ALL)) WHERE r = 1
    """,
    "raw",
)


@query("host_day_dominant_user", sql("SELECT * FROM dominant", "dominant"))
def host_day_dominant_user(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return lb.dominant_users(raw.filter("action = 'logon'"))


@query(
    "principal_attribution",
    sql(
        """SELECT src_host, day, attribution, "user", count(*) AS n FROM (SELECT r.src_host, r.day,
        CASE WHEN r.action NOT IN ('auth', 'http') THEN 'direct' WHEN d.host IS NOT NULL THEN 'dom' ELSE 'pseudo' END
          AS attribution,
        CASE WHEN r.action NOT IN ('auth', 'http') THEN r."user" ELSE coalesce(d.dominant_user, 'host:' || r.src_host) END
          AS "user"
        FROM raw r LEFT JOIN dominant d ON d.host = r.src_host AND d.day = r.day) GROUP BY ALL""",
        "raw", "dominant",
    ),
)
def principal_attribution(spark, sf_dir):
    """Events of two actions come without a principal and get the host-day's user."""
    raw = tb.raw_events(spark, sf_dir)
    dominant = lb.dominant_users(raw.filter("action = 'logon'"))
    blank = raw.withColumn("user", F.when(F.col("action").isin("auth", "http"), "").otherwise(F.col("user")))
    return lb.attribute_users(blank, dominant).groupBy("src_host", "day", "attribution", "user").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "record_id_labels",
    sql(
        """SELECT dataset, action, count(*) AS n, CAST(sum(CASE WHEN event_id IN (SELECT event_id FROM raw WHERE is_positive)
        THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM raw GROUP BY ALL""",
        "raw",
    ),
)
def record_id_labels(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    ids = raw.filter("is_positive").select("event_id")
    return lb.record_labels(raw, ids).groupBy("dataset", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos")
    )


# ---- sampling -------------------------------------------------------------------------------------

cte("strict_sample", f"SELECT * FROM labelled WHERE action <> 'http' OR {DRAW7} < 0.05", "labelled")
cte(
    "flagged",
    'SELECT *, (dataset, "user") IN (SELECT (dataset, "user") FROM roster) AS on_roster FROM labelled',
    "labelled", "roster",
)
cte("loose_sample", f"SELECT * FROM flagged WHERE action <> 'http' OR on_roster OR {DRAW7} < 0.05", "flagged")


@query("uniform_sample", sql('SELECT dataset, event_id, "user", day, action FROM strict_sample', "strict_sample"))
def uniform_sample(spark, sf_dir):
    return sm.uniform_sample(tb.raw_events(spark, sf_dir), _web(), 0.05).select(
        "dataset", "event_id", "user", "day", "action"
    )


@query("roster_aware_sample", sql('SELECT dataset, event_id, "user", day, action FROM loose_sample', "loose_sample"))
def roster_aware_sample(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return sm.roster_sample(raw, tb.roster(raw), _web(), 0.05).select("dataset", "event_id", "user", "day", "action")


@query(
    "interval_aware_sample",
    sql(f"SELECT dataset, event_id, in_interval FROM in_span WHERE in_interval OR {DRAW7} < 0.02", "in_span"),
)
def interval_aware_sample(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return sm.interval_sample(raw, tb.intervals(raw), 0.02).select("dataset", "event_id", "in_interval")


@query(
    "head_sample",
    sql('SELECT dataset, event_id, "timestamp" FROM raw ORDER BY "timestamp", event_id, dataset LIMIT 5000', "raw"),
)
def head_sample(spark, sf_dir):
    return sm.head_sample(tb.raw_events(spark, sf_dir), 5000).select("dataset", "event_id", "timestamp")


_AUDIT_ROW = '"timestamp", "user", src_host, dst_host, action, object, label'


@query(
    "sampling_audit",
    sql(
        f"""SELECT dataset, strict_rows, loose_rows, other_only_in_strict, other_only_in_loose, roster_rows_strict,
          roster_rows_loose, roster_only_in_strict, round(k / n, 9) AS roster_keep_rate,
          round((k / n - 0.05) / sqrt(0.05 * 0.95 / n), 6) AS roster_keep_z,
          other_only_in_strict = 0 AND other_only_in_loose = 0 AND roster_only_in_strict = 0
            AND coalesce(abs((k / n - 0.05) / sqrt(0.05 * 0.95 / n)) < 5, false) AS passed
        FROM (SELECT *, CAST(roster_rows_strict AS DOUBLE) AS k, nullif(CAST(roster_rows_loose AS DOUBLE), 0) AS n FROM
          (SELECT dataset, CAST(sum(s) AS BIGINT) AS strict_rows, CAST(sum(l) AS BIGINT) AS loose_rows,
            CAST(coalesce(sum(greatest(s - l, 0)) FILTER (NOT t), 0) AS BIGINT) AS other_only_in_strict,
            CAST(coalesce(sum(greatest(l - s, 0)) FILTER (NOT t), 0) AS BIGINT) AS other_only_in_loose,
            CAST(coalesce(sum(s) FILTER (t), 0) AS BIGINT) AS roster_rows_strict,
            CAST(coalesce(sum(l) FILTER (t), 0) AS BIGINT) AS roster_rows_loose,
            CAST(coalesce(sum(greatest(s - l, 0)) FILTER (t), 0) AS BIGINT) AS roster_only_in_strict
          FROM (SELECT dataset, t, {_AUDIT_ROW}, sum(s) AS s, sum(l) AS l FROM
            (SELECT *, on_roster AND action = 'http' AS t,
              CASE WHEN action <> 'http' OR {DRAW7} < 0.05 THEN 1 ELSE 0 END AS s,
              CASE WHEN action <> 'http' OR on_roster OR {DRAW7} < 0.05 THEN 1 ELSE 0 END AS l FROM flagged)
            GROUP BY ALL) GROUP BY 1))""",
        "flagged",
    ),
)
def sampling_audit(spark, sf_dir):
    events = labelled_events(spark, sf_dir)
    flagged = lb.flag_roster(events, tb.roster(tb.raw_events(spark, sf_dir)))
    strict = sm.uniform_sample(flagged, _web(), 0.05)
    loose = flagged.filter(~_web() | F.col("on_roster") | sm.keep(0.05))
    out = sm.sampling_audit(strict, loose, _web(), 0.05)
    return rounded(rounded(out, ["roster_keep_rate"], 9), ["roster_keep_z"], 6)


@query(
    "sampling_rates_by_group",
    sql(
        f"""SELECT dataset, on_roster, scanned, kept, n_users, round(kept / scanned, 9) AS keep_rate,
          round((kept / scanned - 0.05) / sqrt(0.05 * 0.95 / scanned), 6) AS z,
          abs((kept / scanned - 0.05) / sqrt(0.05 * 0.95 / scanned)) < 5 AS passed FROM
        (SELECT dataset, on_roster, count(*) AS scanned, count(*) FILTER ({DRAW7} < 0.05) AS kept,
          count(DISTINCT "user") AS n_users FROM flagged WHERE action = 'http' GROUP BY ALL)""",
        "flagged",
    ),
)
def sampling_rates_by_group(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    out = sm.keep_rates(lb.flag_roster(raw, tb.roster(raw)), _web(), 0.05)
    return rounded(rounded(out, ["keep_rate"], 9), ["z"], 6)


@query(
    "multiset_difference",
    sql(
        """SELECT dataset, CAST(sum(greatest(net, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(-net, 0)) AS BIGINT) AS only_b,
        CAST(sum(n) AS BIGINT) AS n_both_sides FROM (SELECT dataset, "user", action, day, sum(side) AS net, count(*) AS n FROM
          (SELECT dataset, "user", action, day, 1 AS side FROM strict_sample UNION ALL
           SELECT dataset, "user", action, day, -1 FROM labelled WHERE hour("timestamp") < 12) GROUP BY ALL) GROUP BY 1""",
        "strict_sample", "labelled",
    ),
)
def multiset_difference(spark, sf_dir):
    events = labelled_events(spark, sf_dir)
    morning = events.filter(F.hour("timestamp") < 12)
    return sm.multiset_difference(sm.uniform_sample(events, _web(), 0.05), morning, ["user", "action", "day"])


_UD_ID = "\"user\" || '@' || day"


@query(
    "balanced_pair_sample",
    sql(
        f"""SELECT dataset, "user", day, rank, group_size FROM (SELECT dataset, "user", day,
          row_number() OVER (PARTITION BY dataset ORDER BY md5('0:' || {_UD_ID}), {_UD_ID}) AS rank,
          count(*) OVER (PARTITION BY dataset) AS group_size FROM ud)
        WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ud GROUP BY dataset))""",
        "ud",
    ),
)
def balanced_pair_sample(spark, sf_dir):
    f = user_days(spark, sf_dir).withColumn("id", F.concat_ws("@", "user", "day"))
    return sm.balanced_sample(f, F.col("id"), seed=0).select("dataset", "user", "day", "rank", "group_size")


@query(
    "positive_preserving_cap",
    sql(
        f"""SELECT dataset, "user", day, label FROM (SELECT *,
          row_number() OVER (PARTITION BY dataset, label ORDER BY md5('0:' || {_UD_ID}), {_UD_ID}) AS r,
          count(*) OVER (PARTITION BY dataset) AS n, sum(label) OVER (PARTITION BY dataset) AS p FROM ud)
        WHERE n <= 1300 OR r <= CASE WHEN label = 1 THEN least(p, 200) ELSE 1300 - least(p, 200) END""",
        "ud",
    ),
)
def positive_preserving_cap(spark, sf_dir):
    f = user_days(spark, sf_dir, staged=True).withColumn("id", F.concat_ws("@", "user", "day"))
    return sm.cap_keeping_positives(f, F.col("id"), cap=1300, seed=0).select("dataset", "user", "day", "label")


@query(
    "negative_only_training",
    sql(
        """SELECT u.dataset, u."user", u.day, u.label = 0 AS negative_row, p.any_pos = 0 OR p.n_quiet < 8 AS negative_user FROM ud u
        JOIN (SELECT *, count(*) FILTER (any_pos = 0) OVER (PARTITION BY dataset) AS n_quiet FROM
          (SELECT dataset, "user", max(label) AS any_pos FROM ud GROUP BY ALL)) p USING (dataset, "user")
        WHERE u.label = 0""",
        "ud",
    ),
)
def negative_only_training(spark, sf_dir):
    f = user_days(spark, sf_dir, staged=True).select(*sc.USER_DAY_KEY, "label")
    quiet = sm.negative_users(f).select(*sc.USER_DAY_KEY, F.lit(True).alias("quiet"))
    return (
        sm.negative_rows(f)
        .join(quiet, sc.USER_DAY_KEY, "left")
        .select(*sc.USER_DAY_KEY, (F.col("label") == 0).alias("negative_row"),
                F.coalesce("quiet", F.lit(False)).alias("negative_user"))
    )


# ---- splits ---------------------------------------------------------------------------------------

cte(
    "event_split",
    """
    SELECT *, CASE WHEN epoch_us("timestamp") > cut THEN 'test' ELSE 'train' END AS part FROM labelled JOIN
      (SELECT dataset, floor(quantile_cont(epoch_us("timestamp"), 0.7)) AS cut FROM raw GROUP BY 1) USING (dataset)
    """,
    "labelled", "raw",
)
cte(
    "day_split",
    """
    SELECT *, CASE WHEN epoch(day) / 86400 > cut THEN 'test' ELSE 'train' END AS part FROM ud JOIN
      (SELECT dataset, quantile_cont(epoch(day) / 86400, 0.7) AS cut FROM ud GROUP BY 1) USING (dataset)
    """,
    "ud",
)


@query(
    "chronological_event_split",
    sql("SELECT dataset, event_id, part, CAST(cut AS BIGINT) AS cut_us FROM event_split", "event_split"),
)
def chronological_event_split(spark, sf_dir):
    out = sp.chronological_events(tb.raw_events(spark, sf_dir))
    return out.select("dataset", "event_id", "part", F.col("cut_us").cast("long").alias("cut_us"))


@query(
    "chronological_user_day_split",
    sql('SELECT dataset, "user", day, label, part, round(cut, 6) AS cut_day FROM day_split', "day_split"),
)
def chronological_user_day_split(spark, sf_dir):
    out = sp.chronological_user_days(user_days(spark, sf_dir, staged=True))
    return rounded(out.select(*sc.USER_DAY_KEY, "label", "part", "cut_day"), ["cut_day"], 6)


@query(
    "alternative_cuts",
    sql(
        """SELECT m.dataset, round(m.c, 6) AS median_positive_day, round(a.c, 6) AS active_window_cut, a.first_day, a.last_day
        FROM (SELECT dataset, quantile_cont(epoch(day) / 86400, 0.5) AS c FROM (SELECT DISTINCT dataset, day FROM ud
          WHERE label = 1) GROUP BY 1) m
        JOIN (SELECT dataset, quantile_cont(epoch(day) / 86400, 0.7) AS c, any_value(f) AS first_day, any_value(t) AS last_day
          FROM ud JOIN (SELECT dataset, min(day) AS f, max(day) AS t FROM ud WHERE label = 1 GROUP BY 1) USING (dataset)
          WHERE day BETWEEN f AND t GROUP BY 1) a USING (dataset)""",
        "ud",
    ),
)
def alternative_cuts(spark, sf_dir):
    f = user_days(spark, sf_dir, staged=True)
    median = sp.median_positive_day(f).withColumnRenamed("cut_day", "median_positive_day")
    active = sp.active_window_quantile(f).withColumnRenamed("cut_day", "active_window_cut")
    return rounded(median.join(active, "dataset"), ["median_positive_day", "active_window_cut"], 6)


@query(
    "validation_tail",
    sql(
        """SELECT dataset, "user", day, CASE WHEN r > n - least(greatest(round_even(n * 0.15::DOUBLE, 0), 1), n - 1)
        THEN 'val' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY day, "user") AS r,
        count(*) OVER (PARTITION BY dataset) AS n FROM ud)""",
        "ud",
    ),
)
def validation_tail(spark, sf_dir):
    return sp.validation_tail(user_days(spark, sf_dir)).select(*sc.USER_DAY_KEY, "part")


def _parts_sql(fraction: float, first: str, second: str, seeds: str, single: str) -> str:
    return f"""
    SELECT dataset, "user", seed, positive_user, CASE WHEN r <= CASE WHEN n >= 2 THEN
        least(greatest(round_even(n * {fraction}::DOUBLE, 0), 1), n - 1) ELSE {single} END THEN '{first}' ELSE '{second}' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset, seed, positive_user ORDER BY md5(seed || ':' || "user"), "user") AS r,
        count(*) OVER (PARTITION BY dataset, seed, positive_user) AS n
      FROM (SELECT dataset, "user", max(label) AS positive_user FROM ud GROUP BY ALL), (SELECT unnest({seeds}) AS seed))
    """


cte("user_parts", _parts_sql(0.7, "train", "test", "[0, 1, 2]", "round_even(n * 0.7::DOUBLE, 0)"), "ud")
cte("val_parts", _parts_sql(0.15, "val", "train", "[0]", "0"), "ud")


@query(
    "user_disjoint_split",
    sql('SELECT u.dataset, u."user", u.day, u.label, p.seed, p.part FROM ud u JOIN user_parts p USING (dataset, "user")',
        "ud", "user_parts"),
)
def user_disjoint_split(spark, sf_dir):
    out = sp.user_disjoint(user_days(spark, sf_dir, staged=True), seeds=(0, 1, 2))
    return out.select(*sc.USER_DAY_KEY, "label", "seed", "part")


@query(
    "validation_users",
    sql('SELECT u.dataset, u."user", u.day, p.part FROM ud u JOIN val_parts p USING (dataset, "user")', "ud", "val_parts"),
)
def validation_users(spark, sf_dir):
    return sp.validation_users(user_days(spark, sf_dir, staged=True)).select(*sc.USER_DAY_KEY, "part")


_REPORT = ", ".join(
    f"""count(*) FILTER (part = '{p}') AS n_{p}, CAST(coalesce(sum(label) FILTER (part = '{p}'), 0) AS BIGINT) AS pos_{p},
    min({{t}}) FILTER (part = '{p}') AS first_{p}, max({{t}}) FILTER (part = '{p}') AS last_{p},
    count(DISTINCT "user") FILTER (part = '{p}') AS users_{p}"""
    for p in ("train", "test")
)
_BOTH = """(SELECT count(*) FROM (SELECT "user" FROM {s} x WHERE x.dataset = e.dataset {m} GROUP BY 1
    HAVING count(DISTINCT part) = 2)) AS users_both"""


@query(
    "chronological_split_report",
    sql(f"""SELECT dataset, {_REPORT.format(t='"timestamp"')}, {_BOTH.format(s='event_split', m='')}
        FROM event_split e GROUP BY dataset""", "event_split"),
)
def chronological_split_report(spark, sf_dir):
    return sp.split_report(sp.chronological_events(labelled_events(spark, sf_dir)))


@query(
    "user_disjoint_split_report",
    "SELECT dataset, seed, " + _REPORT.format(t="day") + ", CAST(0 AS BIGINT) AS users_both FROM (" +
    sql('SELECT u.dataset, u."user", u.day, u.label, p.seed, p.part FROM ud u JOIN user_parts p USING (dataset, "user")',
        "ud", "user_parts") + ") GROUP BY dataset, seed",
)
def user_disjoint_split_report(spark, sf_dir):
    rows = sp.user_disjoint(user_days(spark, sf_dir, staged=True), seeds=(0, 1, 2))
    return sp.split_report(rows, time="day", by=("dataset", "seed"))


@query(
    "full_stream_restriction",
    sql("""SELECT dataset, "user", day, label, n_events, round(dev_n_events, 3) AS dev_n_events FROM dev
        WHERE (dataset, "user", day) IN (SELECT (dataset, "user", day) FROM event_split WHERE part = 'test')""",
        "dev", "event_split"),
)
def full_stream_restriction(spark, sf_dir):
    """Features built on the whole stream, kept for the days that the test events touch."""
    raw = tb.raw_events(spark, sf_dir)
    test = sp.chronological_events(raw).filter("part = 'test'")
    full = ft.add_deviation(ft.user_day_features(raw, tb.label_keys(raw), deviation=False), ["n_events"])
    out = ft.restrict_to(full, test).select(*sc.USER_DAY_KEY, "label", "n_events", "dev_n_events")
    return rounded(out, ["dev_n_events"], 3)


# ---- composition and parity -----------------------------------------------------------------------


@query(
    "tagged_concatenation",
    sql("""SELECT dataset, dataset || '::' || "user" AS "user", dataset || '::' || src_host AS src_host,
        dataset || '::' || dst_host AS dst_host, count(*) AS n FROM raw GROUP BY ALL""", "raw"),
)
def tagged_concatenation(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    domains = {d: raw.filter(F.col("dataset") == d) for d in ("ev0", "ev1", "ev2", "retail")}
    return cp.tag_and_concat(domains).groupBy("dataset", "user", "src_host", "dst_host").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "leave_one_domain_out_folds",
    sql("""SELECT h.held_out, r.dataset, CASE WHEN r.dataset = h.held_out THEN 'test' ELSE 'train' END AS part,
        count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM ud r, (SELECT DISTINCT dataset AS held_out FROM ud) h
        GROUP BY ALL""", "ud"),
)
def leave_one_domain_out_folds(spark, sf_dir):
    folds = cp.lodo_folds(user_days(spark, sf_dir), ["ev0", "ev1", "ev2", "retail"])
    return folds.groupBy("held_out", "dataset", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos")
    )


_PARITY_COLS = sc.BASE_COLUMNS + ["label"]
_SUMS = [*sc.COUNT_COLUMNS, "n_events", "off", "s", "ss"]
cte(
    "merged",
    "SELECT m.*, h.n_distinct_hosts, off / n_events AS frac_offhours, s / n_events AS hour_mean, "
    "CASE WHEN n_events > 1 THEN sqrt(greatest((ss - s * s / n_events) / (n_events - 1), 0)) ELSE 0 END AS hour_std, "
    "CASE WHEN k.day IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT dataset, \"user\", day, "
    + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in _SUMS)
    + " FROM (SELECT dataset, \"user\", day, hour(\"timestamp\") % 5 AS batch, "
    + ", ".join(f"count(*) FILTER (action = '{a}') AS cnt_{a}" for a in sc.ACTIONS)
    + ", count(*) AS n_events, count(*) FILTER (hour(\"timestamp\") < 7 OR hour(\"timestamp\") > 19) AS off, "
    "sum(hour(\"timestamp\")) AS s, sum(hour(\"timestamp\") * hour(\"timestamp\")) AS ss FROM raw GROUP BY ALL) GROUP BY ALL) m "
    "JOIN (SELECT dataset, \"user\", day, count(DISTINCT dst_host) AS n_distinct_hosts FROM raw GROUP BY ALL) h "
    "USING (dataset, \"user\", day) LEFT JOIN keys k USING (dataset, \"user\", day)",
    "raw", "keys",
)


def _parity_sql(columns, other: str) -> str:
    exact = {*sc.INTEGER_COLUMNS, "label"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (b.day IS NULL) AS only_a, count(*) FILTER (a.day IS NULL) AS only_b, "
        f"round(max(abs(a.{c} - b.{c}))::DOUBLE, 6) AS max_abs_diff, max(abs(a.{c} - b.{c})) <= "
        f"{0 if c in exact else 1e-6} AS within "
        f"FROM ud a FULL JOIN {other} b ON a.dataset = b.dataset AND a.\"user\" = b.\"user\" AND a.day = b.day"
        for c in columns
    )


@query("feature_parity", sql(_parity_sql(_PARITY_COLS, "merged"), "ud", "merged"))
def feature_parity(spark, sf_dir):
    """Direct aggregation against merged partials: same rows, no difference."""
    raw = tb.raw_events(spark, sf_dir)
    keys = tb.label_keys(raw)
    direct = ft.label_user_days(ft.base_features(raw), keys)
    merged = ft.label_user_days(ft.merge_partials(ft.partial_aggregates(raw), ft.host_pairs(raw)), keys)
    return rounded(cp.feature_parity(direct, merged, _PARITY_COLS), ["max_abs_diff"], 6)


cte(
    "thinned",
    f"""
    SELECT b.*, CASE WHEN k.day IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT dataset, "user", day,
      count(*) AS n_events, count(DISTINCT dst_host) AS n_distinct_hosts, avg(hour("timestamp")) AS hour_mean
      FROM strict_sample GROUP BY ALL) b LEFT JOIN keys k USING (dataset, "user", day)
    """,
    "strict_sample", "keys",
)
_THIN = ["n_events", "n_distinct_hosts", "hour_mean", "label"]


@query(
    "sampled_feature_difference",
    sql(_parity_sql(_THIN, "thinned"), "ud", "thinned"),
)
def sampled_feature_difference(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    keys = tb.label_keys(raw)
    full = ft.user_day_features(raw, keys, deviation=False)
    thin = ft.user_day_features(sm.uniform_sample(raw, _web(), 0.05), keys, deviation=False)
    return rounded(cp.feature_parity(full, thin, _THIN), ["max_abs_diff"], 6)


@query(
    "worst_difference_rows",
    sql(
        """SELECT dataset, "user", day, total_diff, worst_feature, worst_diff FROM (SELECT dataset, "user", day,
          round(dn + dh + dm, 6) AS total_diff, round(greatest(dn, dh, dm), 6) AS worst_diff,
          CASE WHEN dn >= dh AND dn >= dm THEN 'n_events' WHEN dh >= dm THEN 'n_distinct_hosts' ELSE 'hour_mean' END
            AS worst_feature
          FROM (SELECT a.dataset, a."user", a.day, abs(a.n_events - b.n_events)::DOUBLE AS dn,
            abs(a.n_distinct_hosts - b.n_distinct_hosts)::DOUBLE AS dh, abs(a.hour_mean - b.hour_mean) AS dm
            FROM ud a JOIN thinned b ON a.dataset = b.dataset AND a."user" = b."user" AND a.day = b.day))
        ORDER BY total_diff DESC, dataset, "user", day LIMIT 5""",
        "ud", "thinned",
    ),
)
def worst_difference_rows(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    keys = tb.label_keys(raw)
    full = ft.user_day_features(raw, keys, deviation=False)
    thin = ft.user_day_features(sm.uniform_sample(raw, _web(), 0.05), keys, deviation=False)
    return cp.worst_rows(full, thin, ["n_events", "n_distinct_hosts", "hour_mean"], 5)


@query(
    "prediction_parity",
    sql(
        """SELECT a.dataset, count(*) FILTER (b.day IS NULL) AS only_first, CAST(0 AS BIGINT) AS only_second,
        count(*) FILTER (b.day IS NULL) = 0 AS identical FROM ud a LEFT JOIN thinned b ON a.dataset = b.dataset
        AND a."user" = b."user" AND a.day = b.day GROUP BY 1""",
        "ud", "thinned",
    ),
)
def prediction_parity(spark, sf_dir):
    """Rows scored from all events against rows scored from sampled ones."""
    raw = tb.raw_events(spark, sf_dir)
    keys = tb.label_keys(raw)
    full = ft.user_day_features(raw, keys, deviation=False)
    thin = ft.user_day_features(sm.uniform_sample(raw, _web(), 0.05), keys, deviation=False)
    return cp.prediction_parity(full, thin, ["user", "day", "label"])


@query(
    "dense_node_index",
    sql(
        """SELECT kind, node, row_number() OVER (PARTITION BY kind ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT 'user' AS kind,
        dataset || '::' || "user" AS node FROM raw UNION SELECT 'host', dataset || '::' || src_host FROM raw UNION
        SELECT 'host', dataset || '::' || dst_host FROM raw)""",
        "raw",
    ),
)
def dense_node_index(spark, sf_dir):
    return cp.node_index(cp.tag(tb.raw_events(spark, sf_dir)))


@query(
    "edge_stream",
    sql(
        """SELECT dataset, event_id, epoch_us("timestamp") AS t, du.r - 1 AS u, dh.r - 1 AS h,
          CAST(list_position(""" + repr(sc.ACTIONS) + """, action) - 1 AS BIGINT) AS a, label AS y,
          row_number() OVER (PARTITION BY dataset ORDER BY "timestamp", event_id, du.r, dh.r, action) AS position
        FROM labelled l
        JOIN (SELECT node, row_number() OVER (ORDER BY node) AS r FROM (SELECT DISTINCT dataset || '::' || "user" AS node
          FROM raw)) du ON du.node = l.dataset || '::' || l."user"
        JOIN (SELECT node, row_number() OVER (ORDER BY node) AS r FROM (SELECT dataset || '::' || src_host AS node FROM raw
          UNION SELECT dataset || '::' || dst_host FROM raw)) dh ON dh.node = l.dataset || '::' || l.dst_host""",
        "labelled", "raw",
    ),
)
def edge_stream(spark, sf_dir):
    events = cp.tag(labelled_events(spark, sf_dir))
    return cp.edge_stream(events, cp.node_index(events))


@query(
    "feature_cache_alignment",
    sql("SELECT dataset, count(*) AS n, CAST(46 AS INTEGER) AS n_columns, CAST(sum(label) AS BIGINT) AS n_pos FROM ud GROUP BY 1", "ud"),
)
def feature_cache_alignment(spark, sf_dir):
    """Feature cache written per domain, read back with its columns checked."""
    from daymark.session import work_path
    from daymark.sources import cache

    path = work_path(spark, "features")
    cache.write_features(user_days(spark, sf_dir, deviation=True), path)
    f = cache.read_features(spark, path)
    return f.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(f.columns)).alias("n_columns"), F.sum("label").alias("n_pos")
    )
