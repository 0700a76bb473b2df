"""Queries on user-day features and table summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.functions import timeparts as tp
from daymark.operators import features as ft
from daymark.operators import labels as lb
from daymark.operators import profile as pf
from daymark.queries.common import labelled_events, rounded, user_days
from daymark.queries.registry import draw_sql, query, rounded as sql_rounded, sql
from daymark.sources import tables as tb

REAL = ["frac_offhours", "hour_mean", "hour_std"]
KEYS_SQL = 'dataset, "user", day'
_BASE_OUT = f"{KEYS_SQL}, label, {', '.join(sc.INTEGER_COLUMNS)}, {sql_rounded(REAL, 6)}"


@query("user_day_features", sql(f"SELECT {_BASE_OUT}, {sql_rounded(sc.DEV_COLUMNS, 3)} FROM dev", "dev"))
def user_day_features(spark, sf_dir):
    out = user_days(spark, sf_dir, deviation=True)
    out = ft.align_features(out)
    return rounded(rounded(out, REAL, 6), sc.DEV_COLUMNS, 3)


@query("base_user_day_features", sql(f"SELECT {_BASE_OUT} FROM ud", "ud"))
def base_user_day_features(spark, sf_dir):
    out = user_days(spark, sf_dir)
    return rounded(out, REAL, 6).select(*sc.USER_DAY_KEY, "label", *sc.BASE_COLUMNS)


@query(
    "canonical_events",
    sql(
        f"""SELECT dataset, event_id, "timestamp", "user", src_host, dst_host, action, object, label, insider_type, day,
        CAST(hour("timestamp") AS INTEGER) AS hour,
        CASE WHEN hour("timestamp") < 7 OR hour("timestamp") > 19 THEN 1 ELSE 0 END AS off_hours,
        CAST(list_position({sc.ACTIONS!r}, action) - 1 AS BIGINT) AS action_id FROM labelled""",
        "labelled",
    ),
)
def canonical_events(spark, sf_dir):
    e = labelled_events(spark, sf_dir)
    hour = F.hour("timestamp")
    return e.select(
        "dataset", "event_id", "timestamp", "user", "src_host", "dst_host", "action", "object", "label",
        "insider_type", "day", hour.alias("hour"), tp.off_hours(hour).alias("off_hours"),
        sc.action_id(F.col("action")).cast("long").alias("action_id"),
    )


@query(
    "off_vocabulary_actions",
    "SELECT event_type AS action, count(*) AS n_rows FROM events "
    f"WHERE event_type NOT IN ({', '.join(repr(a) for a in sc.ACTIONS)}) GROUP BY 1",
)
def off_vocabulary_actions(spark, sf_dir):
    return sc.off_vocabulary(tb.table(spark, sf_dir, "events"), "event_type")


@query(
    "cold_start_report",
    sql(
        """SELECT dataset, count(*) AS n_user_days, count(DISTINCT "user") AS n_first_days,
        count(DISTINCT "user") * 21 AS n_cells_filled FROM ud GROUP BY 1""",
        "ud",
    ),
)
def cold_start_report(spark, sf_dir):
    return ft.cold_start_report(user_days(spark, sf_dir))


_BATCHES = 5


def _batched_partials(events):
    """Partials of five ingest batches, as five loads would have written them."""
    tagged = events.withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(_BATCHES)))
    keys = [*sc.USER_DAY_KEY, "batch"]
    return ft.partial_aggregates(tagged, keys), ft.host_pairs(tagged, keys)


@query("merged_partial_features", sql(f"SELECT {_BASE_OUT} FROM ud", "ud"))
def merged_partial_features(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    out = ft.merge_partials(*_batched_partials(raw))
    out = ft.label_user_days(out, tb.label_keys(raw))
    return rounded(out, REAL, 6).select(*sc.USER_DAY_KEY, "label", *sc.BASE_COLUMNS)


_CHANNELS = {
    "logon": ["logon", "logoff", "auth"],
    "file": ["file_read", "file_write", "file_delete"],
    "email": ["email_send", "email_recv"],
    "http": ["http"],
}


@query(
    "channel_streamed_features",
    sql(
        f"""SELECT {KEYS_SQL}, CASE WHEN (dataset, "user", day) IN (SELECT (dataset, "user", day) FROM keys)
        THEN 1 ELSE 0 END AS label, n_events, cnt_http, n_distinct_hosts, {sql_rounded(REAL, 6)}
        FROM (SELECT dataset, "user", day, count(*) AS n_events, count(*) FILTER (action = 'http') AS cnt_http,
          count(DISTINCT dst_host) AS n_distinct_hosts,
          avg(CASE WHEN hour("timestamp") < 7 OR hour("timestamp") > 19 THEN 1.0 ELSE 0.0 END) AS frac_offhours,
          avg(hour("timestamp")) AS hour_mean, coalesce(stddev_samp(hour("timestamp")), 0) AS hour_std
          FROM raw WHERE action <> 'http' OR {draw_sql("'7'", 'event_id')} < 0.05 GROUP BY ALL)""",
        "raw", "keys",
    ),
)
def channel_streamed_features(spark, sf_dir):
    """Each channel folded to partials on its own, the web channel sampled first, then merged."""
    from daymark.operators.sampling import keep

    raw = tb.raw_events(spark, sf_dir)
    partials = hosts = None
    for name, actions in _CHANNELS.items():
        part = raw.filter(F.col("action").isin(actions))
        part = part.filter(keep(0.05)) if name == "http" else part
        p, h = ft.partial_aggregates(part), ft.host_pairs(part)
        partials = p if partials is None else partials.unionByName(p)
        hosts = h if hosts is None else hosts.unionByName(h)
    out = ft.label_user_days(ft.merge_partials(partials, hosts), tb.label_keys(raw))
    return rounded(out, REAL, 6).select(
        *sc.USER_DAY_KEY, "label", "n_events", "cnt_http", "n_distinct_hosts", *REAL
    )


@query(
    "graph_summary",
    sql(
        """SELECT dataset, count(DISTINCT "user") AS n_users,
        (SELECT count(*) FROM (SELECT src_host AS h FROM labelled x WHERE x.dataset = l.dataset
           UNION SELECT dst_host FROM labelled x WHERE x.dataset = l.dataset)) AS n_hosts,
        count(*) AS n_edges, CAST(sum(label) AS BIGINT) AS n_malicious, round(avg(label), 9) AS malicious_rate,
        round(count(*) / count(DISTINCT "user"), 6) AS mean_user_degree,
        round(count(*) / count(DISTINCT dst_host), 6) AS mean_host_degree,
        round(date_diff('microsecond', min("timestamp"), max("timestamp")) / 86400000000.0, 6) AS span_days
        FROM labelled l GROUP BY dataset""",
        "labelled",
    ),
)
def graph_summary(spark, sf_dir):
    out = pf.graph_summary(labelled_events(spark, sf_dir))
    out = rounded(out, ["malicious_rate"], 9)
    return rounded(out, ["mean_user_degree", "mean_host_degree", "span_days"], 6)


@query(
    "target_statistics",
    sql(
        "SELECT dataset, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(label), 9) AS base_rate "
        "FROM ud GROUP BY 1",
        "ud",
    ),
)
def target_statistics(spark, sf_dir):
    return rounded(pf.target_statistics(user_days(spark, sf_dir)), ["base_rate"], 9)


@query(
    "domain_manifest",
    sql(
        """SELECT e.*, u.user_days, u.positive_user_days, a.action_counts FROM
        (SELECT dataset, count(*) AS events, CAST(sum(label) AS BIGINT) AS positive_events,
           count(DISTINCT "user") AS users FROM labelled GROUP BY 1) e
        JOIN (SELECT dataset, count(*) AS user_days, CAST(sum(label) AS BIGINT) AS positive_user_days
              FROM ud GROUP BY 1) u USING (dataset)
        JOIN (SELECT dataset, string_agg(action || '=' || n, ',' ORDER BY action) AS action_counts FROM
              (SELECT dataset, action, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY 1) a USING (dataset)""",
        "labelled", "ud",
    ),
)
def domain_manifest(spark, sf_dir):
    out = pf.domain_manifest(labelled_events(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("action_counts")),
                        lambda kv: F.concat_ws("=", kv["key"], kv["value"].cast("string")))
    return out.withColumn("action_counts", F.array_join(pairs, ","))


@query(
    "raw_profile",
    sql(
        """SELECT dataset, action, src_host, n, round(n / sum(n) OVER (PARTITION BY dataset), 9) AS share
        FROM (SELECT dataset, action, src_host, count(*) AS n FROM raw GROUP BY ALL)""",
        "raw",
    ),
)
def raw_profile(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return rounded(pf.histogram(raw, ["action", "src_host"]), ["share"], 9)


@query(
    "top_actions_by_host",
    sql(
        """SELECT dataset, action, src_host, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset
        ORDER BY n DESC, action, src_host) AS r FROM (SELECT dataset, action, src_host, count(*) AS n
        FROM raw GROUP BY ALL)) WHERE r <= 20""",
        "raw",
    ),
)
def top_actions_by_host(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    return pf.top_entries(pf.histogram(raw, ["action", "src_host"]), ["action", "src_host"], 20).drop("share")


@query(
    "coverage_check",
    sql(
        """SELECT k.dataset, r.n_roster, r.n_present, r.n_roster - r.n_present AS n_missing,
          k.n_keys, k.n_seen, k.n_keys - k.n_seen AS n_keys_missing, d.n_days
        FROM (SELECT k.dataset, count(*) AS n_keys, count(*) FILTER (EXISTS (SELECT 1 FROM raw x
            WHERE x.dataset = k.dataset AND x."user" = k."user" AND x.day = k.day
            AND (x.action <> 'http' OR """ + draw_sql("'7'", "x.event_id") + """ < 0.05))) AS n_seen
            FROM keys k GROUP BY 1) k
        JOIN (SELECT o.dataset, count(*) AS n_roster, count(*) FILTER (EXISTS (SELECT 1 FROM raw x
            WHERE x.dataset = o.dataset AND x."user" = o."user"
            AND (x.action <> 'http' OR """ + draw_sql("'7'", "x.event_id") + """ < 0.05))) AS n_present
            FROM roster o GROUP BY 1) r USING (dataset)
        JOIN (SELECT dataset, count(DISTINCT day) AS n_days FROM raw
            WHERE action <> 'http' OR """ + draw_sql("'7'", "event_id") + """ < 0.05 GROUP BY 1) d USING (dataset)""",
        "raw", "keys", "roster",
    ),
)
def coverage_check(spark, sf_dir):
    from daymark.operators.sampling import uniform_sample

    raw = tb.raw_events(spark, sf_dir)
    kept = uniform_sample(raw, F.col("action") == "http", 0.05)
    return pf.coverage(kept, tb.label_keys(raw), tb.roster(raw))


@query(
    "field_count_histogram",
    sql(
        """SELECT CAST(9 + CASE WHEN action = 'auth' THEN 1 ELSE 0 END AS INTEGER) AS n_fields, count(*) AS n_lines,
        action = 'auth' AS malformed FROM raw GROUP BY ALL""",
        "raw",
    ),
)
def field_count_histogram(spark, sf_dir):
    """Raw comma lines built from the events, some with a stray comma, counted by fields."""
    raw = tb.raw_events(spark, sf_dir)
    clean = F.replace("object", F.lit(","), F.lit(";"))
    obj = F.when(F.col("action") == "auth", F.concat_ws(",", clean, "dst_host")).otherwise(clean)
    line = F.concat_ws(",", "dataset", "event_id", F.col("timestamp").cast("string"), "user", "src_host", "dst_host",
                       "action", obj, F.col("value").cast("string"))
    return pf.field_counts(raw.select(line.alias("value")), expected=9)


@query(
    "evaluability",
    sql(
        """SELECT dataset, n_pos, n_test_pos, n_pos >= 50 AND n_test_pos > 0 AS target_evaluable, n_pos = 0 AS source_refused,
        n_pos > 0 AND n_pos < 50 AS source_warned FROM (SELECT dataset, CAST(sum(label) AS BIGINT) AS n_pos,
          CAST(coalesce(sum(label) FILTER (epoch(day) / 86400 > c.cut), 0) AS BIGINT) AS n_test_pos FROM ud
          JOIN (SELECT dataset, quantile_cont(epoch(day) / 86400, 0.7) AS cut FROM ud GROUP BY 1) c USING (dataset)
          GROUP BY 1)""",
        "ud",
    ),
)
def evaluability(spark, sf_dir):
    from daymark.operators.splits import chronological_user_days

    return pf.evaluability(chronological_user_days(user_days(spark, sf_dir, staged=True)))


@query(
    "standardised_features",
    sql(
        "SELECT dataset, \"user\", day, " + ", ".join(
            f"round(greatest(least(({c} - m_{c}) / CASE WHEN s_{c} > 1e-12 THEN s_{c} ELSE 1 END, 8), -8), 6) AS {c}"
            for c in sc.BASE_COLUMNS
        ) + ", round(greatest(least(dev_n_events, 8), -8), 4) AS dev_n_events FROM dev, (SELECT " + ", ".join(
            f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in sc.BASE_COLUMNS
        ) + " FROM ud WHERE dataset = 'retail')",
        "dev",
    ),
)
def standardised_features(spark, sf_dir):
    """Every domain on the scale of the retail domain, as when a retail model scores it."""
    f = user_days(spark, sf_dir, deviation=True, staged=True)
    stats = ft.scale_statistics(f.filter("dataset = 'retail'"), sc.BASE_COLUMNS)
    out = ft.standardise(f, stats)
    return rounded(rounded(out, sc.BASE_COLUMNS, 6), ["dev_n_events"], 4).select(
        *sc.USER_DAY_KEY, *sc.BASE_COLUMNS, "dev_n_events"
    )


@query(
    "relative_time",
    sql(
        """SELECT dataset, event_id, round(CASE WHEN hi > lo THEN date_diff('microsecond', lo, "timestamp")
        / date_diff('microsecond', lo, hi)::DOUBLE ELSE 0 END, 9) AS rel_time FROM raw JOIN (SELECT dataset,
        min("timestamp") AS lo, max("timestamp") AS hi FROM raw GROUP BY 1) USING (dataset)""",
        "raw",
    ),
)
def relative_time(spark, sf_dir):
    return rounded(pf.relative_time(tb.raw_events(spark, sf_dir)).select("dataset", "event_id", "rel_time"),
                   ["rel_time"], 9)


@query(
    "dataset_traits",
    sql(
        """SELECT dataset, count(*) AS n, bool_and(dataset = 'retail') AS is_real,
        string_agg(DISTINCT insider_type, ',' ORDER BY insider_type) AS types_seen FROM labelled GROUP BY 1""",
        "labelled",
    ),
)
def dataset_traits(spark, sf_dir):
    """Domain metadata joined to what the events show."""
    e = labelled_events(spark, sf_dir)
    traits = spark.createDataFrame(
        [("ev0", False), ("ev1", False), ("ev2", False), ("retail", True)], "dataset string, is_real boolean"
    )
    return (
        e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.collect_set("insider_type").alias("t"))
        .join(traits, "dataset", "left")
        .select("dataset", "n", "is_real", F.array_join(F.array_sort("t"), ",").alias("types_seen"))
    )


@query(
    "feature_vectors",
    sql(
        f"SELECT dataset, \"user\", day, CAST(42 AS INTEGER) AS n_features, round({' + '.join(sc.BASE_COLUMNS)}, 6) "
        "AS base_sum FROM ud",
        "ud",
    ),
)
def feature_vectors(spark, sf_dir):
    """Model input vectors in the fixed column order."""
    from daymark.operators.detectors import assemble
    from pyspark.ml.functions import vector_to_array

    f = user_days(spark, sf_dir, deviation=True)
    v = vector_to_array(F.col("features"))
    total = F.aggregate(F.slice(v, 1, len(sc.BASE_COLUMNS)), F.lit(0.0), lambda a, x: a + x)
    return assemble(f, ft.active_columns(f)).select(
        *sc.USER_DAY_KEY, F.size(v).alias("n_features"), F.round(total, 6).alias("base_sum")
    )
