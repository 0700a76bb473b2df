"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of the ``N`` documents and the target weight ``w`` has the repetition rate ``w * N / n``. Each document
is repeated as often as a Poisson variable of that mean, got by inverting the distribution at a uniform number
hashed from the seed and the document's id; rates above ``SPLIT`` are sums of several such variables. So the
result does not depend on partitions or retries, and every document decides alone. The copies are then put into
one global random order, by a hash of the id and the copy's number.

Scale: one aggregation by source with partial sums; the rates are a written table of one row per source, which Spark
broadcasts when it is small by the size of its files and otherwise joins with splitting of hot sources. The global order is
a range shuffle on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import table

SPLIT = 50.0
TWO_52 = float(1 << 52)


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from 52 bits of the MD5 of the colon-joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(TWO_52)


def rates(docs: DataFrame, by: str, weights: DataFrame | None, power: float, epochs: float) -> DataFrame:
    """(source, draws, steps): the number of Poisson variables to add, and their distribution function from 0 up."""
    sizes = docs.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        weighed = sizes.join(weights.select(F.col("source").cast("string"), F.col("weight").cast("double")), "source", "left").fillna(0.0, ["weight"])
    all_n, all_weight = weighed.agg(F.sum("n"), F.sum("weight")).first()
    rated = weighed.select("source", (F.col("weight") / F.lit(all_weight or 1.0) * F.lit(epochs) * F.lit(all_n or 0) / F.col("n")).alias("rate"))
    rated = rated.where("rate > 0").withColumn("draws", F.ceil(F.col("rate") / SPLIT).cast("int"))
    mean = (F.col("rate") / F.col("draws")).alias("mean")
    steps = rated.select("source", "draws", "rate", mean).select("*", F.explode(F.expr("sequence(0, cast(mean + 12 * sqrt(mean) + 20 as int))")).alias("k"))
    run = Window.partitionBy("source").orderBy("k")
    chance = F.exp(-F.col("mean") + F.col("k") * F.ln("mean") - F.sum(F.ln(F.greatest("k", F.lit(1)))).over(run))
    steps = steps.withColumn("p", chance).withColumn("below", F.sum("p").over(run))
    # At most 156 steps: the mean is 50 or less.
    return steps.groupBy("source", "draws", "rate").agg(F.sort_array(F.collect_list("below")).alias("steps"))


def mix(docs: DataFrame, weights: DataFrame | None = None, by: str = "source", power: float = 0.7, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` repeated to target weights and shuffled globally, with ``copy`` (from 0), ``rate`` and ``shuffle_key``.

    ``weights`` has a row (source, weight) for each source, or is None for weights proportional to the source's number of documents to
    ``power``; the result is about ``epochs`` times as long as the input. A source without a weight goes. A null source is the empty
    name; documents without an id draw by their text. Rows that repeat an id draw alike. Columns named ``copy``, ``rate``
    or ``shuffle_key`` are replaced.
    """
    table_ = table(rates(docs, by, weights, power, epochs), "mixing-rates")
    kept = [c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(by).cast("string"), F.lit("")).alias("__source"), name.alias("__name"))
    rows = rows.join(table_.select(F.col("source").alias("__source"), F.col("draws").alias("__draws"), "rate", F.col("steps").alias("__steps")), "__source")
    # One variable is the usual case and needs its hash once; the sum is for rates above SPLIT.
    rows = rows.withColumn("__u", uniform(F.lit(seed), F.col("__name"), F.lit("1")))
    more = F.transform(F.sequence(F.lit(1), "__draws"), lambda j: uniform(F.lit(seed), F.col("__name"), j.cast("string")))
    summed = F.aggregate(more, F.lit(0), lambda total, u: total + F.size(F.filter("__steps", lambda s: u >= s)))
    drawn = F.when(F.col("__draws") == 1, F.size(F.filter("__steps", lambda s: F.col("__u") >= s))).otherwise(summed)
    copies = rows.withColumn("__n", drawn).where("__n > 0")
    out = copies.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.expr("sequence(0L, __n - 1L)")).alias("copy"), "rate", "__name")
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), "__name", F.col("copy").cast("string")))).drop("__name")
    return out.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
