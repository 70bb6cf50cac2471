"""Tables on Parquet.

Insert-only tables keep one `writer=<name>/batch_id=<n>` folder per batch. Writing
a batch again overwrites its own folder only, and a batch reads the table as it was
before it, so a replay gives the same rows. The overrides table is small and is
written whole, one `version=<n>` folder after another. No path is ever overwritten
while it is read.

Writers of one root take turns, as ids go on from the table's greatest one: each
batch reads and writes inside `turn`.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolesift import schemas


_turns = threading.Lock()


@contextmanager
def turn(spark: SparkSession, root: str, writer: str, batch_id: int, wait_seconds: float = 600) -> Iterator[None]:
    """Hold the one turn that a root has, from the first read to the last write of a batch.

    The turn is a file that only one writer can create. A writer waits while another has
    it, and fails with the other's name after `wait_seconds`. A batch that died with the
    turn takes it again when it is repeated; if it never will be, `clear_turn` ends its turn.
    """
    files, path = _file(spark, f"{root}/_turn")
    mine = f"{writer}/{batch_id}"

    def holder() -> str:
        try:
            stream = files.open(path)
        except Exception:  # it has just been given back
            return ""
        try:
            return stream.readUTF()
        except Exception:  # created, but not yet written
            return "another writer"
        finally:
            stream.close()

    def taken() -> bool:
        with _turns:  # a local file system checks and creates in two steps
            if files.exists(path):
                return holder() == mine
            try:
                out = files.create(path, False)
            except Py4JJavaError as e:  # another process was faster
                if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    raise
                return False
            out.writeUTF(mine)
            out.close()
            return True

    until = time.monotonic() + wait_seconds
    while not taken():
        if time.monotonic() > until:
            raise TimeoutError(f"{root} is being written by {holder()}")
        time.sleep(0.2)
    try:
        yield
    finally:
        files.delete(path, False)


def _file(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def clear_turn(spark: SparkSession, root: str) -> bool:
    """End the turn of a writer that died and will not be restarted; whether there was one.

    Only for a root that nothing writes at the moment: a live writer would lose its turn.
    """
    files, path = _file(spark, f"{root}/_turn")
    return files.delete(path, False)


def batch_time(spark: SparkSession, root: str, writer: str, batch_id: int) -> datetime:
    """When the batch was first tried; a repeated batch is judged by the same time."""
    table = _read(spark, f"{root}/batches", schemas.BATCH_TIMES, schemas.BATCH)
    known = table.filter((F.col("writer") == writer) & (F.col("batch_id") == batch_id)).select("started_at").first()
    if known is not None:
        return known.started_at
    now = spark.range(1).select(F.lit(datetime.now(timezone.utc)).alias("started_at"))
    append_batch(now, root, "batches", writer, batch_id)
    return now.first().started_at


_drills: set[tuple[str, str, int]] = set()


class Interrupted(RuntimeError):
    """A write that a drill has stopped."""


@contextmanager
def interrupted_before(root: str, table: str, batch_id: int) -> Iterator[None]:
    """A drill: the first write of that batch to that table fails, as if the run was lost there.

    What the batch has written before stays. The run dies; started again from its
    checkpoint it repeats the batch.
    """
    drill = (root, table, batch_id)
    _drills.add(drill)
    try:
        yield
    finally:
        _drills.discard(drill)


def append_batch(df: DataFrame, root: str, table: str, writer: str, batch_id: int) -> None:
    if (root, table, batch_id) in _drills:
        _drills.discard((root, table, batch_id))
        raise Interrupted(f"{table} of {writer}/{batch_id}")
    df.write.mode("overwrite").parquet(f"{root}/{table}/writer={writer}/batch_id={batch_id}")


def _read(spark: SparkSession, path: str, schema: StructType, parts: StructType) -> DataFrame:
    full = StructType([*schema.fields, *parts.fields])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    schema: StructType,
    before: tuple[str, int] | None = None,
) -> DataFrame:
    """The table, or its state before one (writer, batch); empty if never written."""
    rows = _read(spark, f"{root}/{table}", schema, schemas.BATCH)
    if before is not None:
        writer, batch_id = before
        rows = rows.filter((F.col("writer") != writer) | (F.col("batch_id") < batch_id))
    return rows.select(*schema.names)


def read_batches(spark: SparkSession, root: str, table: str, schema: StructType) -> DataFrame:
    """The table with the `writer` and `batch_id` of each row."""
    return _read(spark, f"{root}/{table}", schema, schemas.BATCH)


def read_batch(
    spark: SparkSession, root: str, table: str, schema: StructType, writer: str, batch_id: int
) -> DataFrame:
    """What one batch has written; empty if it has written nothing."""
    rows = _read(spark, f"{root}/{table}", schema, schemas.BATCH)
    return rows.filter((F.col("writer") == writer) & (F.col("batch_id") == batch_id)).select(*schema.names)


def last_batch(spark: SparkSession, root: str, writer: str) -> int | None:
    """The last batch that a writer has begun."""
    table = _read(spark, f"{root}/batches", schemas.BATCH_TIMES, schemas.BATCH)
    return table.filter(F.col("writer") == writer).agg(F.max("batch_id")).first()[0]


def is_written(spark: SparkSession, root: str, table: str, writer: str, batch_id: int) -> bool:
    """Whether a batch has written its part of a table to the end."""
    files, path = _file(spark, f"{root}/{table}/writer={writer}/batch_id={batch_id}/_SUCCESS")
    return files.exists(path)


def override_versions(spark: SparkSession, root: str) -> DataFrame:
    """The versions of the overrides that hold any."""
    return _read(spark, f"{root}/overrides", schemas.OVERRIDES, schemas.VERSION).select("version").distinct()


def read_overrides(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest overrides, or the newest before a version; empty if there are none yet."""
    rows = _read(spark, f"{root}/overrides", schemas.OVERRIDES, schemas.VERSION)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.agg(F.max("version")).scalar()
    return rows.filter(F.col("version") == newest).drop("version")


def write_overrides(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/overrides/version={version}")


def write_outbox(df: DataFrame, root: str, writer: str, batch_id: int) -> None:
    """Messages to send, one row each. The batch's folder is the idempotency key."""
    append_batch(df, root, "outbox", writer, batch_id)


def write_run_csv(df: DataFrame, folder: str, source: str, stamp: str) -> str:
    """One run's rows as CSV under `<source>_<UTC stamp>.csv`."""
    path = f"{folder}/{source}_{stamp}.csv"
    df.write.mode("overwrite").csv(path, header=True)
    return path


def current_jobs(
    spark: SparkSession, root: str, before: tuple[str, int] | None = None
) -> DataFrame:
    """job_info with the decisions made so far.

    Decisions are rows of their own, since a job is decided once; so no decision
    ever rewrites the job table.
    """
    jobs = read_table(spark, root, "job_info", schemas.JOB_INFO).drop("user_decision")
    decided = read_table(spark, root, "decisions", schemas.DECISIONS, before)
    joined = jobs.join(decided.withColumnRenamed("job_id", "id"), "id", "left")
    return joined.select(*jobs.columns, F.col("decision").alias("user_decision"))
