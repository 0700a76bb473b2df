"""Session settings and the shared folder used for checkpoints and working tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "daymark", cores: int | str = "*", shuffle: int = 8, **conf) -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode when it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="daymark-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later reads see the same rows after executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a working table in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/daymark-{name}-{uuid.uuid4().hex}"
    if get_ident() in _MADE:
        _MADE[get_ident()].append(path)
    return path


#: Working tables of the scratch block that a thread is in. A plain dict, since functions sent to the tasks carry the names they use.
_MADE: dict[int, list[str]] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that the block makes in this thread are deleted at its end, and shuffle files that nothing reads any more. What the block gives
    back must be written to a path from before it."""
    outer = _MADE.get(get_ident())
    _MADE[get_ident()] = []
    try:
        yield
    finally:
        made = _MADE.pop(get_ident())
        if outer is not None:
            _MADE[get_ident()] = outer
        jvm = spark.sparkContext._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, made):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()  # Python's frames hold those of the JVM
        jvm.System.gc()  # Spark deletes shuffle files when the driver has collected what made them


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins planned in the block take rows that are already together by some of their keys as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def fixed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and of known size to the planner."""
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
