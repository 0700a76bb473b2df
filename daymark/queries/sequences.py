"""Queries on sequences, transitions and memory profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.operators import sequences as sq
from daymark.queries.common import rounded, user_days
from daymark.queries.registry import cte, query, sql
from daymark.sources import tables as tb


@query(
    "context_windows",
    sql(
        """SELECT dataset, "user", day, CAST(least(row_number() OVER w, 8) AS INTEGER) AS n_context,
        string_agg(CAST(n_events AS VARCHAR), ',') OVER (PARTITION BY dataset, "user" ORDER BY day ROWS BETWEEN 7 PRECEDING AND
        CURRENT ROW) AS n_events_seen, CAST(8 AS INTEGER) AS n_rows FROM ud WINDOW w AS (PARTITION BY dataset, "user" ORDER BY day)""",
        "ud",
    ),
)
def context_windows(spark, sf_dir):
    out = sq.context_windows(user_days(spark, sf_dir), ["n_events", "n_distinct_hosts"])
    seen = F.transform(F.slice("context", F.lit(9) - F.col("n_context"), F.col("n_context")),
                       lambda v: v[0].cast("long").cast("string"))
    return out.select(*sc.USER_DAY_KEY, "n_context", F.array_join(seen, ",").alias("n_events_seen"),
                      F.size("context").alias("n_rows"))


@query(
    "day_sequences",
    sql(
        """SELECT dataset, "user", string_agg(CAST(n_events AS VARCHAR), ',' ORDER BY day) AS n_events_by_day FROM
        (SELECT *, row_number() OVER (PARTITION BY dataset, "user" ORDER BY day DESC) AS r FROM ud) WHERE r <= 64 GROUP BY ALL""",
        "ud",
    ),
)
def day_sequences(spark, sf_dir):
    out = sq.day_sequences(user_days(spark, sf_dir), ["n_events"])
    text = F.array_join(F.transform("days", lambda d: d["x"][0].cast("long").cast("string")), ",")
    return out.select("dataset", "user", text.alias("n_events_by_day"))


_AID = f"list_position({sc.ACTIONS!r}, action) - 1"


@query(
    "token_sequences",
    sql(
        f"""SELECT dataset, "user", day, CAST(count(*) AS INTEGER) AS n_tokens,
        string_agg(CAST(a AS VARCHAR), ',' ORDER BY r DESC) AS tokens, CAST(64 - count(*) AS INTEGER) AS n_padded FROM
        (SELECT *, {_AID} AS a, row_number() OVER (PARTITION BY dataset, "user", day ORDER BY "timestamp" DESC, event_id DESC,
          {_AID} DESC) AS r FROM raw) WHERE r <= 64 GROUP BY ALL""",
        "raw",
    ),
)
def token_sequences(spark, sf_dir):
    out = sq.token_sequences(tb.raw_events(spark, sf_dir))
    real = F.slice("tokens", F.lit(1), F.col("n_tokens"))
    return out.select(
        *sc.USER_DAY_KEY, "n_tokens", F.array_join(F.transform(real, lambda t: t.cast("string")), ",").alias("tokens"),
        F.size(F.filter("mask", lambda m: m)).alias("n_padded"),
    )


cte(
    "pairs",
    """
    SELECT dataset, "user", day, prev, action, count(*) AS n FROM (SELECT dataset, "user", day, action,
      coalesce(lag(action) OVER (PARTITION BY dataset, "user", day ORDER BY "timestamp", event_id, action), '<start>') AS prev
      FROM raw) GROUP BY ALL
    """,
    "raw",
)
cte(
    "tmodel",
    f"""
    SELECT p.prev, a.action, ln((coalesce(c.n, 0) + 1) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY p.prev) + 16)) AS log_p
    FROM (SELECT unnest({['<start>', *sc.ACTIONS]!r}) AS prev) p, (SELECT unnest({sc.ACTIONS!r}) AS action) a
    LEFT JOIN (SELECT prev, action, sum(n) AS n FROM pairs WHERE dataset <> 'retail' GROUP BY ALL) c
      ON c.prev = p.prev AND c.action = a.action
    """,
    "pairs",
)


@query("action_transitions", sql('SELECT dataset, prev, action, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_user_days FROM pairs GROUP BY ALL', "pairs"))
def action_transitions(spark, sf_dir):
    return sq.transitions(tb.raw_events(spark, sf_dir)).groupBy("dataset", "prev", "action").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_user_days")
    )


@query("transition_model", sql("SELECT prev, action, round(log_p, 8) AS log_p FROM tmodel", "tmodel"))
def transition_model(spark, sf_dir):
    pairs = sq.transitions(tb.raw_events(spark, sf_dir))
    return rounded(sq.transition_model(pairs.filter("dataset <> 'retail'")), ["log_p"], 8)


@query(
    "sequence_surprise",
    sql(
        """SELECT dataset, "user", day, round(-sum(n * log_p) / sum(n), 7) AS mean_surprise, round(max(-log_p), 7) AS max_surprise,
        CAST(sum(n) AS BIGINT) AS n_actions FROM pairs JOIN tmodel USING (prev, action) GROUP BY ALL""",
        "pairs", "tmodel",
    ),
)
def sequence_surprise(spark, sf_dir):
    """Transitions learnt on the ``ev`` domains, all user-days scored."""
    pairs = sq.transitions(tb.raw_events(spark, sf_dir))
    model = sq.transition_model(pairs.filter("dataset <> 'retail'"))
    return rounded(sq.sequence_scores(pairs, model), ["mean_surprise", "max_surprise"], 7)


_MEM = sc.ACTIONS
_RATE = "(1.0 / 7.0)"
cte(
    "hd",
    "SELECT dataset, dst_host, day, " + ", ".join(f"count(*) FILTER (action = '{a}') AS cnt_{a}" for a in _MEM)
    + " FROM raw GROUP BY ALL",
    "raw",
)


@query(
    "memory_profiles",
    sql(
        'SELECT u.dataset, u."user", u.day, ' + ", ".join(f"round(u.mem_cnt_{a}, 5) AS mem_cnt_{a}" for a in _MEM) + ", "
        + ", ".join(f"round(coalesce(h.host_cnt_{a}, 0), 5) AS host_cnt_{a}" for a in _MEM)
        + ' FROM (SELECT x.dataset, x."user", x.day, ' + ", ".join(
            f"coalesce(sum(y.cnt_{a} * exp(-(x.day - y.day) * {_RATE})), 0) AS mem_cnt_{a}" for a in _MEM)
        + ' FROM ud x LEFT JOIN ud y ON y.dataset = x.dataset AND y."user" = x."user" AND y.day < x.day GROUP BY ALL) u'
        + ' LEFT JOIN (SELECT t.dataset, t."user", t.day, ' + ", ".join(f"avg(p.host_cnt_{a}) AS host_cnt_{a}" for a in _MEM)
        + ' FROM (SELECT DISTINCT dataset, "user", day, dst_host FROM raw) t JOIN (SELECT x.dataset, x.dst_host, x.day, '
        + ", ".join(f"coalesce(sum(y.cnt_{a} * exp(-(x.day - y.day) * {_RATE})), 0) AS host_cnt_{a}" for a in _MEM)
        + " FROM hd x LEFT JOIN hd y ON y.dataset = x.dataset AND y.dst_host = x.dst_host AND y.day < x.day GROUP BY ALL) p"
        + ' USING (dataset, dst_host, day) GROUP BY ALL) h ON h.dataset = u.dataset AND h."user" = u."user" AND h.day = u.day',
        "ud", "raw", "hd",
    ),
)
def memory_profiles(spark, sf_dir):
    out = sq.memory_features(tb.raw_events(spark, sf_dir), user_days(spark, sf_dir))
    cols = [f"{p}_cnt_{a}" for p in ("mem", "host") for a in _MEM]
    return rounded(out, cols, 5).select(*sc.USER_DAY_KEY, *cols)
