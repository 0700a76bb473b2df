"""Deviation from a user's earlier days as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daymark.schema import BASE_COLUMNS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Users of a domain are kept in so many buckets.
BUCKETS = 4096


class EarlierDays(StatefulProcessor):
    """Per user of a bucket: number of days seen, the first day's values, sums and squares of the differences to them, and the last day.

    Differences to the user's first values keep constant features exact. State is read and written once per bucket and batch, as blocks of bytes, and the
    days are taken for all users of the bucket together.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stats", "users array<string>, n binary, sums binary, last binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width = len(self.columns)
        known, n, sums, last = pd.Index([], dtype=object), np.zeros(0, np.int64), np.zeros((0, 3, width)), np.zeros(0, "datetime64[D]")
        if self.state.exists():
            users, *numbers = self.state.get()
            n, sums, last = (np.frombuffer(v, t).copy() for v, t in zip(numbers, (np.int64, np.float64, np.int64)))
            last = last.view("datetime64[D]")
            known, sums = pd.Index(users, dtype=object), sums.reshape(len(n), 3, width)  # first values, sums, squares
        days = pd.concat(list(rows), ignore_index=True)
        codes, names = pd.factorize(days["user"], use_na_sentinel=False)
        days = days.iloc[np.lexsort((pd.to_datetime(days["day"]).to_numpy(), codes))].reset_index(drop=True)
        ends = np.cumsum(np.bincount(codes, minlength=len(names)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        x, dates = days[self.columns].to_numpy(dtype=float), pd.to_datetime(days["day"]).to_numpy().astype("datetime64[D]")
        names = pd.Index([None if pd.isna(u) else u for u in names], dtype=object)
        at = known.get_indexer(names)  # the place of each user in the state
        for i in np.flatnonzero((at >= 0) & (dates[starts] <= last[at])) if len(last) else ():
            raise ValueError(f"day {dates[starts[i]]} of {(key[0], names[i])} arrived after {last[at[i]]}")
        new = np.flatnonzero(at < 0)
        at[new] = len(known) + np.arange(len(new))
        known, n, last = known.append(names[new]), np.append(n, np.zeros(len(new), np.int64)), np.append(last, dates[starts[new]])
        first = np.zeros((len(new), 3, width))
        first[:, 0] = x[starts[new]]
        sums = np.concatenate([sums, first])
        out, run = np.zeros_like(x), np.zeros((len(names), 2, width))  # what this batch adds
        order = np.argsort(starts - ends, kind="stable")  # users with most days first
        lengths = (ends - starts)[order]
        for k in range(int(lengths[0]) if len(lengths) else 0):  # the k-th day of all users that have one
            some = order[: np.searchsorted(-lengths, -k, side="left")]
            here, row = at[some], starts[some] + k
            base, total, squares = sums[here, 0], sums[here, 1] + run[some, 0], sums[here, 2] + run[some, 1]
            seen, off = n[here][:, None], x[row] - base
            mean = total / np.maximum(seen, 1)
            spread = np.sqrt(np.maximum(squares / np.maximum(seen, 1) - mean * mean, 0.0))
            out[row] = np.where(seen > 0, (off - mean) / (spread + 1e-6), 0.0)
            run[some, 0] += off
            run[some, 1] += off * off
            n[here] += 1
        sums[at, 1:] += run
        last[at] = dates[ends - 1]
        self.state.update((known.tolist(), n.tobytes(), sums.tobytes(), last.astype(np.int64).tobytes()))
        result = days[["dataset", "user", "day"]].copy()
        for j, c in enumerate(self.columns):
            result[f"dev_{c}"] = out[:, j]
        yield result

    def close(self) -> None:
        pass


def deviation_stream(user_days: DataFrame, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    """``dev_x`` of each user-day as it closes. Days of a user must arrive in order: within a batch they are sorted,
    and a batch with a day that is not after the user's last one stops the stream."""
    real = {"frac_offhours", "hour_mean", "hour_std"}
    exact = user_days.withColumns({c: F.round(F.col(c), 9) if c in real else F.col(c).cast("double") for c in columns})
    schema = "dataset string, user string, day date, " + ", ".join(f"dev_{c} double" for c in columns)
    keyed = exact.withColumn("bucket", F.pmod(F.xxhash64("user"), F.lit(BUCKETS)))
    return keyed.select("dataset", "bucket", "user", "day", *columns).groupBy("dataset", "bucket").transformWithStateInPandas(
        statefulProcessor=EarlierDays(columns), outputStructType=schema, outputMode="Append", timeMode="None"
    )
