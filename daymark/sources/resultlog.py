"""Result rows out of text logs whose lines may be soft-wrapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Layout of a result line.
_HEAD = r"(\w[\w/]*) seed=(\d+) (\w+)->(\w+)(?: \[(\w+)\])?:"
_NUMBERS = r"pr_auc=([0-9.]+)(?:\s+lift=([0-9.]+))?"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with exact line numbers.

    Rows of one file split are consecutive, so a row's number is its place in the split plus the rows of
    the file's earlier splits.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    sizes = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return raw.join(offsets, ["file", "start"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value"
    )


def parse(lines: DataFrame) -> DataFrame:
    """One row per (model, seed, source, target, protocol), the last one written.

    A line that ends after the colon continues on the next line, and a lone ``lift=`` belongs to the line
    before. Continuations are found by their line number, so no file is ordered as a whole. A diagonal
    without a protocol is dropped.
    """
    head = lines.filter(F.col("value").rlike(_HEAD))
    next_line = lines.filter(F.col("value").rlike(r"^\s*(pr_auc|lift)=")).select(
        "file", (F.col("line") - 1).alias("line"), F.trim("value").alias("more")
    )
    joined = head.join(next_line, ["file", "line"], "left")
    open_end = ~F.col("value").rlike(r"lift=")
    text = F.when(open_end & F.col("more").isNotNull(), F.concat_ws(" ", F.rtrim("value"), "more")).otherwise(F.col("value"))
    pattern = F.lit(_HEAD + r"\s*" + _NUMBERS)
    part = lambda i: F.nullif(F.regexp_extract(text, _HEAD + r"\s*" + _NUMBERS, i), F.lit(""))
    rows = joined.filter(F.regexp_like(text, pattern)).select(
        "file", "line", part(1).alias("model"), part(2).cast("int").alias("seed"), part(3).alias("source"),
        part(4).alias("target"), part(5).alias("protocol"), part(6).try_cast("double").alias("pr_auc"),
        part(7).try_cast("double").alias("lift"),
    )
    rows = rows.filter("source <> target OR protocol IS NOT NULL").withColumn(
        "protocol", F.coalesce("protocol", F.lit("full_source"))
    )
    key = ["model", "seed", "source", "target", "protocol"]
    last = F.max_by(F.struct("pr_auc", "lift"), F.struct("file", "line")).alias("v")
    return rows.groupBy(*key).agg(last).select(*key, "v.pr_auc", "v.lift")
