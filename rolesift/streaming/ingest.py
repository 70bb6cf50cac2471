"""Incremental ingest: each micro-batch of landed files adds only unseen postings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolesift import rules as fixed
from rolesift import schemas
from rolesift.plans.ingest import IngestResult, combine, ingest_boards, ingest_pages
from rolesift.rules import RuleSet
from rolesift.session import scratch, stage
from rolesift.sources import landed, tables


def write_result(result: IngestResult, root: str, writer: str, batch_id: int) -> None:
    """All outputs of a run, jobs last: a batch counts once its jobs are there."""
    tables.write_outbox(result.outbox, root, writer, batch_id)
    if result.held is not None:
        tables.append_batch(result.held, root, "held_pages", writer, batch_id)
    for name in ("rejects", "funnel", "analysis", "jobs"):
        table = {"analysis": "job_analysis", "jobs": "job_info"}.get(name, name)
        tables.append_batch(getattr(result, name), root, table, writer, batch_id)


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, str, int], None],
    name: str,
    checkpoint: str,
    every: str | None,
) -> StreamingQuery:
    """Run `handle(batch, writer, batch_id)` per micro-batch.

    The writer is named after the query's own id, kept in its checkpoint: a restart
    goes on under the same name, and a new checkpoint never overwrites old batches.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        with scratch(batch.sparkSession):
            handle(batch, f"{name}-{query_id}", batch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


@dataclass(frozen=True)
class Feed:
    """One source: its landed lists and details, its companies and rules.

    With `detail_days`, details are landed in folders `dt=<day>`, and only folders from so
    many days before the batch's first list file on are read.
    """

    source: str
    list_path: str
    detail_path: str
    companies: DataFrame
    rules: RuleSet = RuleSet()
    detail_days: int | None = None

    @property
    def paged(self) -> bool:
        return self.source == fixed.SOURCE_A

    def read(self, spark: SparkSession, max_files: int | None) -> DataFrame:
        reader = landed.read_pages if self.paged else landed.read_boards
        return reader(spark, self.list_path, streaming=True, max_files=max_files)


class IngestRun:
    """A started ingest. `awaitTermination` also closes what the run would leave held.

    All else is that of the streaming query. A run that is stopped closes nothing.
    """

    def __init__(self, query: StreamingQuery, close: Callable[[str], None] | None):
        self._query, self._close = query, close

    def __getattr__(self, name: str):
        return getattr(self._query, name)

    def stop(self) -> None:
        self._close = None
        self._query.stop()

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        ended = self._query.awaitTermination(timeout) if timeout is not None else self._query.awaitTermination()
        if ended is not False and self._close is not None:
            close, self._close = self._close, None
            close(self._query.id)
        return ended


def ingest_feeds(
    spark: SparkSession,
    feeds: Sequence[Feed],
    root: str,
    checkpoint: str,
    every: str | None = None,
    as_of: str | None = None,
    hold_batches: int | None = None,
    max_files: int | None = None,
    collation: str | None = None,
    close_at_end: bool | None = None,
) -> IngestRun:
    """Run the ingest plan on every batch of new list files of one or more sources.

    All sources are one stream. Within a batch they are run in the order given, each on
    what the one before has added, so their ids are one range and a posting that several
    sources list is inserted once; the batch is written as a whole.

    `every` such as `1 hour` keeps the query running; without it, it stops when all
    landed files are read. Recency is judged by the time of the batch's first attempt,
    or by `as_of`, so a repeated batch gives the same rows. `max_files` bounds what a
    batch reads of each source.

    A page series that is still landing waits up to `hold_batches` batches (2) for its
    next page. With `every` there is a batch each time, with or without new files, so that
    is also a limit in time. Without `every`, a run that was given no `hold_batches` closes
    at its end: what is still held is read up to its gap, and pages beyond are rejected.
    With `hold_batches` it goes on waiting in the next run, unless `close_at_end` is set.
    """
    if len({f.source for f in feeds}) != len(feeds):
        raise ValueError("each source can be given once")
    closing = close_at_end if close_at_end is not None else every is None and hold_batches is None
    holding = 2 if hold_batches is None else hold_batches

    def handle(batch: DataFrame, writer: str, batch_id: int) -> None:
        session = batch.sparkSession
        with tables.turn(session, root, writer, batch_id):
            many = len(feeds) > 1 or feeds[0].detail_days is not None
            rows = stage(batch, "landed-batch") if many else batch
            before = tables.read_batch(session, root, "held_pages", schemas.HELD_PAGES, writer, batch_id - 1)
            if tables.last_batch(session, root, _closer(writer)) == batch_id - 1:
                finish_closing(session, writer, batch_id - 1)
                before = before.limit(0)
            take(session, rows, before, holding, writer, batch_id)

    def take(session: SparkSession, batch: DataFrame, held: DataFrame, hold: int, writer: str, batch_id: int) -> None:
        mine = (writer, batch_id)
        started = tables.batch_time(session, root, writer, batch_id)
        now = F.to_timestamp(F.lit(as_of or started))
        jobs = tables.read_table(session, root, "job_info", schemas.JOB_INFO, mine)
        analysis = tables.read_table(session, root, "job_analysis", schemas.JOB_ANALYSIS, mine)
        overrides = tables.read_overrides(session, root)
        reported = tables.read_table(session, root, "rejects", schemas.REJECTS, mine)
        results: list[IngestResult] = []
        for number, feed in enumerate(feeds):
            rows = batch.filter(F.col("_feed") == number)
            waiting = feed.paged and not held.isEmpty()
            if not waiting and rows.isEmpty():
                continue
            since = None
            if feed.detail_days is not None:
                dates = rows.unionByName(held, allowMissingColumns=True) if waiting else rows
                first = dates.agg(F.min(F.to_date("landed_at"))).first()[0]
                since = first - timedelta(days=feed.detail_days) if first else None
            details = landed.read_details(session, feed.detail_path, feed.source, since=since)
            extra = {"held": held, "hold_batches": hold} if feed.paged else {"as_of": now}
            plan = ingest_pages if feed.paged else ingest_boards
            result = plan(
                rows, details, feed.companies, jobs, analysis, now=now, rules=feed.rules, overrides=overrides,
                source=feed.source, collation=collation, reported=reported, **extra,
            )
            results.append(result)
            jobs, analysis = jobs.unionByName(result.jobs), analysis.unionByName(result.analysis)
        if results:
            write_result(combine(results), root, writer, batch_id)

    def finish_closing(session: SparkSession, writer: str, batch_id: int) -> None:
        """Read what the batch has left held up to its gaps, as a batch of a writer of its own."""
        held = tables.read_batch(session, root, "held_pages", schemas.HELD_PAGES, writer, batch_id)
        closer = _closer(writer)
        if not held.isEmpty() and not tables.is_written(session, root, "job_info", closer, batch_id):
            none = session.createDataFrame([], schemas.PAGES).withColumn("_feed", F.lit(0))
            take(session, none, held, 0, closer, batch_id)

    def close(query_id: str) -> None:
        writer = f"{name}-{query_id}"
        last = tables.last_batch(spark, root, writer)
        if last is not None:
            with tables.turn(spark, root, _closer(writer), last), scratch(spark):
                finish_closing(spark, writer, last)

    name = "-".join(f.source for f in feeds)
    streams = [f.read(spark, max_files).withColumn("_feed", F.lit(k)) for k, f in enumerate(feeds)]
    if every:  # one row each time, so that there is a batch without new files too
        beat = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", "1").load()
        streams.append(beat.select(F.lit(-1).alias("_feed")))
    stream = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    paged = any(f.paged for f in feeds)
    return IngestRun(start(stream, handle, name, checkpoint, every), close if closing and paged else None)


def _closer(writer: str) -> str:
    return f"{writer}-close"


def ingest_stream(
    spark: SparkSession,
    list_path: str,
    detail_path: str,
    companies: DataFrame,
    root: str,
    checkpoint: str,
    source: str = fixed.SOURCE_A,
    rules: RuleSet = RuleSet(),
    every: str | None = None,
    as_of: str | None = None,
    detail_days: int | None = None,
    hold_batches: int | None = None,
    max_files: int | None = None,
    collation: str | None = None,
    close_at_end: bool | None = None,
) -> IngestRun:
    """`ingest_feeds` with one source. Streams of one root take turns batch by batch."""
    feed = Feed(source, list_path, detail_path, companies, rules, detail_days)
    return ingest_feeds(
        spark, [feed], root, checkpoint, every, as_of, hold_batches, max_files, collation, close_at_end
    )
