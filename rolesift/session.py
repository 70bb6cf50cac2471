"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def build_session(app_name: str = "rolesift", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    A local session without that setting gets a temporary folder of its own; a
    cluster session without it is an error, since a lost machine would lose it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="rolesift-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where a result is read more than once, where its rows must not be
    recomputed differently (row numbers), or where its true size must be known
    before choosing a join. The table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    kept = _scratch.get()
    if kept is not None:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Drop the table that `stage` has written for `df`; only once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables staged inside the block when it ends.

    For blocks that write their results before they end, such as a micro-batch.
    Tables staged elsewhere stay until the application's folder is dropped.
    """
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Tasks of what is run inside the block hand rows to Python about `limit` bytes at a time.

    Spark counts rows only, so long texts make batches of any size, which an executor holds
    several times for each of its cores. A limit that the session has set itself is kept.
    """
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(limit)):
        yield


@contextmanager
def drop_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside the block go when it has run, not when the driver collects its garbage.

    Only for writes, whose result is not computed from their shuffles again. A choice of the session's own is kept.
    """
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of `df`, the one its broadcast check uses."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
