"""Running totals and ranks over groups of any size.

A window over one huge group is one task. Here rows are range-partitioned by (group, order), which
also splits a group that holds most of the rows, each slice is totalled on its own, and the totals of
the earlier slices are added. The slice number is written to the shared folder with the rows, so both
passes see the same slices even when tasks are rerun.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.session import cut, fixed


def attach_groups(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a table with one row per group (a domain, a cell) to the rows of the groups.

    The table is written first, so Spark knows its bytes: a small one is broadcast by the session's threshold and the rows are not
    shuffled by their few, heavy groups; a large one meets them in an ordinary join, with splitting of skewed groups.
    """
    return rows.join(fixed(table), list(by))


def slices(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by group and order, and keep the partition number as ``slice``."""
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order)
    keep = fixed if len({c.lower() for c in df.columns}) == len(df.columns) else cut  # a file has no two columns of one name
    return keep(ranged.withColumn("slice", F.spark_partition_id()))


def slice_offsets(sliced: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (group, slice): totals of the earlier slices as ``before_x`` and of the group as ``all_x``."""
    per_slice = sliced.groupBy(*by, "slice").agg(*[F.sum(e).alias(f"in_{n}") for n, e in sums.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *by,
        "slice",
        *[F.coalesce(F.sum(f"in_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums],
        *[F.sum(f"in_{n}").over(group).alias(f"all_{n}") for n in sums],
    )


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add ``run_x`` (inclusive running sum in ``order``) and ``all_x`` (group sum) for each entry of ``sums``.

    ``order`` must be a total order inside a group.
    """
    sliced = slices(df, by, order)
    inside = Window.partitionBy(*by, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(e).over(inside).alias(f"run_{n}") for n, e in sums.items()])
    joined = local.hint("merge").join(slice_offsets(sliced, by, sums), [*by, "slice"])  # the window has moved and sorted the rows that way
    for name in sums:
        joined = joined.withColumn(f"run_{name}", F.col(f"run_{name}") + F.col(f"before_{name}"))
    return joined.drop("slice", *[f"before_{n}" for n in sums])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``rank`` (1-based position in its group) and ``group_size``."""
    out = running(df, by, order, {"row": F.lit(1)})
    return out.withColumnsRenamed({"run_row": "rank", "all_row": "group_size"})


def first_by_hash(df: DataFrame, by: Sequence[str], digest: Column, key: Sequence[Column], allowed: DataFrame, digits: int = 3) -> DataFrame:
    """The first ``allowed`` rows (a column of a table with one row per group) of each group by (``digest``, ``key``), with their ``rank`` (1-based).

    ``digest`` is a hexadecimal hash, so its first ``digits`` cut a group into even parts. Rows are counted per part; only rows of parts that are
    needed are moved, and a part is ordered in one task. ``df`` is read twice.
    """
    marked = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, digits))
    counts = marked.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))  # at most 16 ** digits rows a group
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    needed = before.join(allowed, list(by)).filter("_before < allowed")
    inside = Window.partitionBy(*by, "_part").orderBy("_digest", *key)
    placed = attach_groups(marked, needed, [*by, "_part"]).withColumn("rank", F.col("_before") + F.row_number().over(inside))
    return placed.filter("rank <= allowed").select(*df.columns, "rank")
