"""The decision stream: first decision per job wins, with its effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolesift import schemas
from rolesift.operators import metrics
from rolesift.operators.decisions import (
    callback_answers,
    decide,
    decision_effects,
    new_decisions,
    parse_decision,
)
from rolesift.operators.joins import jobs_with_company
from rolesift.operators.merge import insert_new
from rolesift.session import stage
from rolesift.sources import landed, tables
from rolesift.streaming.ingest import start

ARRIVAL = ["received_at", "callback_id", "_arrival"]


def number_arrivals(events: DataFrame) -> DataFrame:
    """Parsed events with a tag that tells exact copies apart, written before use."""
    parsed = parse_decision(events)
    return stage(parsed.withColumn("_arrival", F.monotonically_increasing_id()), "events")


def apply_batch(
    spark: SparkSession,
    events: DataFrame,
    companies: DataFrame,
    root: str,
    writer: str,
    batch_id: int,
    as_of: str | None = None,
) -> None:
    """Judge one batch of events and write verdicts, decisions, applications, messages.

    The state is the stored decisions. The batch reads them as they were before it,
    so a replay repeats its own result. Lines that cannot be read are no events: they are
    written to the rejects.
    """
    mine = (writer, batch_id)
    if landed.BROKEN in events.columns:
        lines = metrics.line_rejects(landed.broken_lines(events), "decisions", "event")
        tables.append_batch(lines, root, "rejects", writer, batch_id)
    jobs = tables.current_jobs(spark, root, mine)
    known = jobs.select(F.col("id").alias("job_id"), F.col("user_decision").alias("decision"))
    verdicts = stage(decide(number_arrivals(landed.whole_lines(events)), known, ARRIVAL), "verdicts")
    decided = new_decisions(verdicts)
    now = F.to_timestamp(F.lit(as_of or tables.batch_time(spark, root, writer, batch_id)))
    # Only the jobs just decided are joined to their company
    touched = jobs.join(decided.select(F.col("job_id").alias("id")), "id", "left_semi")
    outbox, applied = decision_effects(decided, jobs_with_company(touched, companies), now)
    status = tables.read_table(spark, root, "application_status", schemas.APPLICATION_STATUS, mine)
    inserted, _ = insert_new(status, applied, ["job_id"], ["job_id"])
    tables.write_outbox(outbox.unionByName(callback_answers(verdicts)), root, writer, batch_id)
    tables.append_batch(inserted, root, "application_status", writer, batch_id)
    tables.append_batch(verdicts.select(*schemas.VERDICTS.names), root, "verdicts", writer, batch_id)
    tables.append_batch(decided.select("job_id", "decision"), root, "decisions", writer, batch_id)


def decision_stream(
    spark: SparkSession,
    path: str,
    companies: DataFrame,
    root: str,
    checkpoint: str,
    every: str | None = None,
    as_of: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Apply landed decision events batch by batch; see `apply_batch`.

    `max_files` bounds a batch. Streams of one root take turns.
    """

    def handle(batch: DataFrame, writer: str, batch_id: int) -> None:
        session = batch.sparkSession
        with tables.turn(session, root, writer, batch_id):
            apply_batch(session, batch, companies, root, writer, batch_id, as_of)

    stream = landed.read_decisions(spark, path, streaming=True, max_files=max_files)
    return start(stream, handle, "decisions", checkpoint, every)
