"""Query registration and the shared SQL building blocks of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daymark.schema import ACTIONS, BASE_COLUMNS, COUNT_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB statement that must return the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- shared SQL -----------------------------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def sql(body: str, *needs: str) -> str:
    """Statement with the named building blocks and what they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    blocks = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {blocks}\n{body}"


def draw_sql(seed: str, key: str) -> str:
    """Hash draw in [0, 1) for the text ``seed:key``; both arguments are SQL expressions of text."""
    return f"(CAST(('0x' || substr(md5({seed} || ':' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


cte(
    "raw",
    """
    SELECT 'ev' || (user_id % 3) AS dataset, CAST(event_id AS VARCHAR) AS event_id, ts AS "timestamp",
      'u' || user_id AS "user", 'h' || (user_id % 20) AS src_host,
      'h' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20) AS dst_host,
      CASE event_type WHEN 'click' THEN 'http' WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'file_write'
        WHEN 'signup' THEN 'logon' WHEN 'error' THEN 'auth' END AS action,
      props AS object, (value >= 100 AND user_id % 10 = 3) AS is_positive, value, CAST(ts AS DATE) AS day
    FROM events
    UNION ALL
    SELECT 'retail', l_orderkey || '-' || l_linenumber, o_orderdate + to_hours(3 * l_linenumber),
      'c' || o_custkey, 'h' || (o_custkey % 20), 's' || (l_suppkey % 20),
      CASE WHEN l_returnflag = 'R' THEN 'file_delete' ELSE
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'email_send' WHEN '2' THEN 'logon' WHEN '3' THEN 'http'
          WHEN '4' THEN 'file_write' WHEN '5' THEN 'auth' END END,
      CAST(l_partkey AS VARCHAR), (l_discount >= 0.09 AND l_quantity >= 35 AND o_custkey % 10 = 3), l_quantity,
      CAST(o_orderdate + to_hours(3 * l_linenumber) AS DATE)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
cte("keys", 'SELECT DISTINCT dataset, "user", day FROM raw WHERE is_positive', "raw")
cte("roster", "SELECT DISTINCT dataset, \"user\" FROM raw WHERE is_positive", "raw")
cte(
    "labelled",
    """
    SELECT r.*, CASE WHEN k.day IS NULL THEN 0 ELSE 1 END AS label,
      CASE WHEN k.day IS NULL THEN 'benign' ELSE 'traitor' END AS insider_type
    FROM raw r LEFT JOIN keys k USING (dataset, "user", day)
    """,
    "raw", "keys",
)
BASE_AGG = (
    ", ".join(f"CAST(count(*) FILTER (action = '{a}') AS BIGINT) AS cnt_{a}" for a in ACTIONS)
    + ', count(*) AS n_events, count(DISTINCT dst_host) AS n_distinct_hosts,'
    ' avg(CASE WHEN hour("timestamp") < 7 OR hour("timestamp") > 19 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac_offhours,'
    ' avg(hour("timestamp")) AS hour_mean, coalesce(stddev_samp(hour("timestamp")), 0) AS hour_std'
)
cte("base", f'SELECT dataset, "user", day, {BASE_AGG} FROM raw GROUP BY ALL', "raw")
cte(
    "ud",
    """
    SELECT b.*, CASE WHEN k.day IS NULL THEN 0 ELSE 1 END AS label
    FROM base b LEFT JOIN keys k USING (dataset, "user", day)
    """,
    "base", "keys",
)


def dev_columns(columns=BASE_COLUMNS) -> str:
    out = []
    for c in columns:
        x = f"round({c}, 9)" if c in BASE_COLUMNS[-3:] else c
        out.append(f"coalesce(({x} - avg({x}) OVER w) / (stddev_pop({x}) OVER w + 1e-6), 0) AS dev_{c}")
    return ", ".join(out)


cte(
    "dev",
    f"""
    SELECT *, {dev_columns()} FROM ud
    WINDOW w AS (PARTITION BY dataset, "user" ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
    "ud",
)
cte(
    "spans",
    """
    SELECT dst_host AS host, "timestamp" - INTERVAL 1 HOUR AS "start", "timestamp" + INTERVAL 1 HOUR AS "end"
    FROM raw WHERE dataset <> 'retail' AND value >= 250
    """,
    "raw",
)

COUNTS_SQL = ", ".join(COUNT_COLUMNS)


def rounded(columns, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
