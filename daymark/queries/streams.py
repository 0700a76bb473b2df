"""Queries that feed the tables through the streaming jobs and must equal the batch results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.functions import timeparts as tp
from daymark.queries.common import rounded
from daymark.queries.features import REAL, sql_rounded
from daymark.queries.registry import query, sql
from daymark.session import fixed, work_path
from daymark.sources import tables as tb
from daymark.streaming import deviation as dv
from daymark.streaming import userdays as ud

_COLUMNS = ["dataset", "event_id", "timestamp", "user", "dst_host", "action"]


#: Events that arrive before a stream is run, unless one day has more.
ARRIVALS = 4_000_000


def _arrivals(events, size: int):
    """``events`` with the number of the arrival they come in: consecutive days of about ``size`` events together."""
    days = events.groupBy(tp.day(F.col("timestamp")).alias("_day")).agg(F.count(F.lit(1)).alias("n"))  # one row a day
    before = F.coalesce(F.sum("n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = fixed(days.filter("_day is not null").select("_day", F.floor(before / size).cast("int").alias("arrival")))
    return events.join(F.broadcast(marks), tp.day(F.col("timestamp")) == F.col("_day")).drop("_day")


def _closed_days(spark, sf_dir, size: int = ARRIVALS) -> str:
    """Run the stream over all events as they arrive, oldest days first, then over one much later event that closes every day; returns the table.

    The stream holds the open days only, so its state follows the size of an arrival and not that of the tables.
    """
    folder, out, mark, waiting = (work_path(spark, n) for n in ("arrivals", "closed-days", "stream-checkpoint", "waiting"))
    events = tb.raw_events(spark, sf_dir).select(*_COLUMNS)
    _arrivals(events, size).write.partitionBy("arrival").parquet(waiting)
    staged = spark.read.parquet(waiting)
    for (arrival,) in sorted(staged.select("arrival").distinct().collect()):
        staged.filter(F.col("arrival") == arrival).select(*_COLUMNS).write.mode("append").parquet(folder)
        ud.run_available(ud.user_day_stream(ud.event_stream(spark, folder, events)), out, mark)
    last = staged.select(*_COLUMNS).orderBy(F.desc("timestamp"), "event_id").limit(1)
    late = last.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '400' DAY")).withColumn("user", F.lit("sentinel"))
    late.write.mode("append").parquet(folder)
    ud.run_available(ud.user_day_stream(ud.event_stream(spark, folder, events)), out, mark)
    return out


@query(
    "streamed_user_days",
    sql(f'SELECT dataset, "user", day, {", ".join(sc.INTEGER_COLUMNS)}, {sql_rounded(REAL, 6)} FROM base', "base"),
)
def streamed_user_days(spark, sf_dir):
    return rounded(spark.read.parquet(_closed_days(spark, sf_dir)), REAL, 6)


@query(
    "streamed_partials",
    sql(f'SELECT dataset, "user", day, {", ".join(sc.INTEGER_COLUMNS)}, {sql_rounded(REAL, 6)} FROM base', "base"),
)
def streamed_partials(spark, sf_dir):
    """Three micro-batches folded to partials, merged afterwards."""
    folder, out, mark = (work_path(spark, n) for n in ("arrivals", "partials", "stream-checkpoint"))
    events = tb.raw_events(spark, sf_dir).select(*_COLUMNS)
    events.repartition(3).write.parquet(folder)
    ud.merge_stream(ud.event_stream(spark, folder, events, files_per_batch=1), out, mark).awaitTermination()
    return rounded(ud.merged_features(spark, out), REAL, 6)


_DEV = sc.BASE_COLUMNS


@query(
    "streamed_deviation",
    sql('SELECT dataset, "user", day, ' + ", ".join(f"round(dev_{c}, 3) AS dev_{c}" for c in _DEV) + " FROM dev", "dev"),
)
def streamed_deviation(spark, sf_dir):
    """The closed days of the first stream feed the second one in three batches, by date; its state is read back between them."""
    folder, out, mark = (work_path(spark, n) for n in ("user-days", "deviation", "stream-checkpoint"))
    days = spark.read.parquet(_closed_days(spark, sf_dir))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    dv.use_rocksdb(spark)
    try:
        for part in range(3):
            third = F.least(F.floor(F.datediff("day", F.lit(first)) * 3 / (F.datediff(F.lit(last), F.lit(first)) + 1)), F.lit(2))
            days.filter(third == part).write.mode("append").parquet(folder)
            arriving = spark.readStream.schema(days.schema).parquet(folder)
            ud.run_available(dv.deviation_stream(arriving, _DEV), out, mark)
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return rounded(spark.read.parquet(out), [f"dev_{c}" for c in _DEV], 3)
