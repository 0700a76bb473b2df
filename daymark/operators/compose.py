"""Composing domains, comparing feature and prediction tables, and indexing graph nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions import timeparts as tp
from daymark.operators.ordered import ranked
from daymark.schema import INTEGER_COLUMNS, USER_DAY_KEY, action_id


def tag(events: DataFrame, name: str | Column | None = None) -> DataFrame:
    """Prefix user and host ids with the domain, so that equal ids of two domains stay apart."""
    domain = F.col("dataset") if name is None else (F.lit(name) if isinstance(name, str) else name)
    out = events.withColumn("dataset", domain)
    return out.withColumns(
        {c: F.concat_ws("::", domain, F.col(c)) for c in ("user", "src_host", "dst_host") if c in events.columns}
    )


def tag_and_concat(domains: dict[str, DataFrame]) -> DataFrame:
    if not domains:
        raise ValueError("no domains given")
    return reduce(lambda a, b: a.unionByName(b), [tag(df, name) for name, df in domains.items()])


def lodo_folds(rows: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Every row once per held-out domain, as its ``test`` or ``train`` part."""
    if len(set(domains)) < 2 or len(set(domains)) != len(domains):
        raise ValueError("leave-one-domain-out needs at least two distinct domains")
    folded = rows.withColumn("held_out", F.explode(F.array(*[F.lit(d) for d in domains])))
    return folded.withColumn("part", F.when(F.col("dataset") == F.col("held_out"), "test").otherwise("train"))


def _side_by_side(a: DataFrame, b: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    return left.join(right, list(keys), "full_outer")


def feature_parity(a: DataFrame, b: DataFrame, columns: Sequence[str], keys: Sequence[str] = USER_DAY_KEY,
                   tolerance: float = 1e-6) -> DataFrame:
    """Per column: rows on one side only and the largest difference; counts must agree exactly."""
    joined = _side_by_side(a, b, columns, keys)
    exact = {*INTEGER_COLUMNS, "label"}
    summary = joined.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(c) for c in columns],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("max_abs_diff"),
                     (F.col(c) <= F.lit(0.0 if c in exact else tolerance)).alias("within"))
            for c in columns
        ]
    )
    return summary.select("only_a", "only_b", F.inline(pairs)).select(
        "feature", "only_a", "only_b", "max_abs_diff", "within"
    )


def worst_rows(a: DataFrame, b: DataFrame, columns: Sequence[str], n: int = 5,
               keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """The ``n`` shared rows with the largest summed difference, and the column that differs most."""
    joined = _side_by_side(a, b, columns, keys).filter("in_a AND in_b")
    diffs = F.array(
        *[F.struct(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("d"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
          for i, c in enumerate(columns)]
    )
    worst = F.array_max("diffs")
    return (
        joined.select(*keys, diffs.alias("diffs"))
        .select(
            *keys,
            F.round(F.aggregate("diffs", F.lit(0.0), lambda acc, x: acc + x["d"]), 6).alias("total_diff"),
            worst["c"].alias("worst_feature"),
            F.round(worst["d"], 6).alias("worst_diff"),
        )
        .orderBy(F.desc("total_diff"), *keys)
        .limit(n)
    )


def prediction_parity(first: DataFrame, second: DataFrame, columns: Sequence[str] = ("user", "day", "label"),
                      by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows that only one of two prediction tables has, per group, counting copies."""
    rows = first.select(*by, *columns, F.lit(1).alias("s")).unionByName(
        second.select(*by, *columns, F.lit(-1).alias("s"))
    )
    net = rows.groupBy(*by, *columns).agg(F.sum("s").alias("net"))
    return net.groupBy(*by).agg(
        F.sum(F.greatest("net", F.lit(0))).alias("only_first"),
        F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_second"),
        F.max(F.col("net") != 0).alias("_differs"),
    ).withColumn("identical", ~F.col("_differs")).drop("_differs")


def require_prediction_parity(first: DataFrame, second: DataFrame, by: Sequence[str] = ("dataset",)) -> None:
    """Raise unless both tables scored the same rows."""
    bad = prediction_parity(first, second, by=by).filter(~F.col("identical")).limit(5).collect()
    if bad:
        raise ValueError(f"models did not score the same rows: {bad}")


def node_index(events: DataFrame) -> DataFrame:
    """Dense ids 0..n-1 of users and of hosts, in name order. Names must be unique across domains (see ``tag``)."""
    names = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("user").alias("node")),
        F.struct(F.lit("host").alias("kind"), F.col("src_host").alias("node")),
        F.struct(F.lit("host").alias("kind"), F.col("dst_host").alias("node")),
    )
    nodes = events.select(F.inline(names)).distinct()
    return ranked(nodes, ["kind"], [F.col("node")]).select("kind", "node", (F.col("rank") - 1).alias("idx"))


def edge_stream(events: DataFrame, index: DataFrame) -> DataFrame:
    """Edges (t, u, h, a, y) with their position in the time order of the domain."""
    users = index.filter("kind = 'user'").select(F.col("node").alias("user"), F.col("idx").alias("u"))
    hosts = index.filter("kind = 'host'").select(F.col("node").alias("dst_host"), F.col("idx").alias("h"))
    edges = events.join(users, "user").join(hosts, "dst_host").select(
        "dataset", "event_id", tp.micros(F.col("timestamp")).alias("t"), "u", "h",
        action_id(F.col("action")).cast("long").alias("a"), F.col("label").alias("y"), "action",
    )
    return ranked(edges, ["dataset"], [F.col(c) for c in ("t", "event_id", "u", "h", "action")]).withColumnRenamed("rank", "position").drop(
        "group_size", "action"
    )
