"""Decision events: validation, first decision wins, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import messages, urls
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

_FIRST = ("_first_decision", "_first_order")


def decision_label(verb: Column) -> Column:
    return F.when(verb == "apply", F.lit("applied")).otherwise(F.lit("rejected"))


def parse_decision(events: DataFrame) -> DataFrame:
    """Flatten callbacks and give each its validation verdict; `ok` if it may count."""
    call = F.col("callback_query")
    flat = events.withColumn("callback_id", F.coalesce(call["id"], F.lit("")))
    message_id = call["message"]["message_id"]
    flat = flat.withColumn("message_id", message_id)
    data = F.coalesce(call["data"], F.lit(""))
    colon = F.instr(data, ":")
    verb = F.substring(data, 1, colon - 1)
    known = (colon > 0) & verb.isin("apply", "reject")
    number = F.substring(data, colon + 1, F.length(data)).try_cast("bigint")
    # A callback object without any field counts as none
    absent = F.coalesce(call["id"], call["data"], message_id.cast("string")).isNull()
    verdict = (
        F.when(absent, "ignored")
        .when((data == "") | (F.coalesce(F.col("message_id"), F.lit(0)) == 0), "invalid_request")
        .when(~known, "unknown_action")
        .when(number.isNull(), "invalid_id")
        .otherwise("ok")
    )
    return (
        flat.withColumn("verdict", verdict)
        .withColumn("verb", F.when(F.col("verdict") == "ok", verb))
        .withColumn("job_id", F.when(F.col("verdict") == "ok", number))
    )


def first_decisions(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per job: its earliest decision, from partial minima before the shuffle."""
    place = F.struct(*order)
    return events.groupBy("job_id").agg(
        F.min(F.struct(place.alias("place"), decision_label(F.col("verb")).alias("decision"))).alias("f")
    ).select("job_id", F.col("f.decision").alias(_FIRST[0]), F.col("f.place").alias(_FIRST[1]))


def decide(
    events: DataFrame, known: DataFrame, order: Sequence[str]
) -> DataFrame:
    """A verdict for every parsed event, given `known` (job_id, decision or null).

    The first valid event of an undecided job sets its decision; later ones, and
    all events of a decided job, answer `already_<decision>`. `order` must tell
    the events of one job apart. `events` is read three times, so parsed events are
    best staged first.
    """
    valid = events.filter(F.col("verdict") == "ok")
    first = first_decisions(valid, order)
    # Cut to the batch's jobs first: a small batch is broadcast and `known` stays put
    held = known.join(first.select("job_id"), "job_id", "left_semi").select(
        "job_id", F.col("decision").alias("_held"), F.lit(True).alias("_known")
    )
    # Written out, so that its true size decides the next join
    per_job = stage(first.join(held, "job_id", "left"), "job-decisions")
    judged = many_to_one(valid, per_job, ["job_id"])
    is_first = F.struct(*order).eqNullSafe(F.col(_FIRST[1]))
    verdict = (
        F.when(F.col("_known").isNull(), F.lit("job_not_found"))
        .when(F.col("_held").isNotNull(), F.concat(F.lit("already_"), F.col("_held")))
        .when(is_first, F.col(_FIRST[0]))
        .otherwise(F.concat(F.lit("already_"), F.col(_FIRST[0])))
    )
    judged = judged.withColumn("verdict", verdict).select(*events.columns)
    return judged.unionByName(events.filter(F.col("verdict") != "ok"))


def new_decisions(verdicts: DataFrame) -> DataFrame:
    """The decisions that were set, one per job."""
    set_now = F.col("verdict").isin("applied", "rejected")
    return verdicts.filter(set_now).select("job_id", F.col("verdict").alias("decision"), "message_id")


def decision_effects(
    decisions: DataFrame, jobs: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Outbox rows and application rows that follow from decisions just set.

    `jobs` is the job table with its `company` name. Every decision edits its
    message; an accepted one also sends the referral note and is recorded.
    """
    full = decisions.join(
        jobs.select(
            F.col("id").alias("job_id"), "company_id", "company", "ats_job_id", "title",
            "location", "application_link",
        ),
        "job_id",
    )
    c = F.col
    applied = c("decision") == "applied"
    link = F.when(applied, urls.search_url(F.coalesce(c("company"), F.lit(""))))
    edited = full.select(
        F.lit(0).cast("bigint").alias("seq"),
        F.lit("edit").alias("kind"),
        "job_id",
        messages.decided_message(
            c("company"), c("title"), c("location"), c("application_link"), c("decision"), link
        ).alias("text"),
        F.lit(None).cast("string").alias("keyboard"),
        c("message_id").alias("reply_to"),
    )
    note = full.filter(applied).select(
        F.lit(1).cast("bigint").alias("seq"),
        F.lit("referral").alias("kind"),
        "job_id",
        messages.fill_template(
            F.coalesce(c("title"), F.lit("Unknown")),
            F.coalesce(c("company"), F.lit("Unknown")),
            F.coalesce(c("ats_job_id"), F.lit("")),
        ).alias("text"),
        F.lit(None).cast("string").alias("keyboard"),
        c("message_id").alias("reply_to"),
    )
    applications = full.filter(applied).select(
        "company_id",
        "job_id",
        F.date_format(as_of, "yyyy-MM-dd").alias("applied_on"),
        F.lit("applied").alias("status"),
    )
    return edited.unionByName(note.filter("text <> ''")), applications


def callback_answers(verdicts: DataFrame) -> DataFrame:
    """One outbox row for every callback: `keyboard` holds the callback's id."""
    return verdicts.filter(F.col("verdict") != "ignored").select(
        F.lit(2).cast("bigint").alias("seq"),
        F.lit("answer").alias("kind"),
        "job_id",
        messages.callback_answer(F.col("verdict")).alias("text"),
        F.col("callback_id").alias("keyboard"),
        F.col("message_id").alias("reply_to"),
    )
