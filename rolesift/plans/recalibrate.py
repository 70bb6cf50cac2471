"""Recalibration over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift import schemas
from rolesift.operators.joins import many_to_one
from rolesift.operators.learner import count_parts, decode_matches, lift_of_parts, store_learned
from rolesift.session import stage
from rolesift.sources import tables

_WRITER = "recalibration"


def _counted(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The counts that earlier versions have stored; a version counts once its overrides are there."""
    parts = tables.read_batches(spark, root, "keyword_parts", schemas.KEYWORD_PARTS)
    versions = tables.override_versions(spark, root).withColumnRenamed("version", "batch_id")
    done = parts.filter(F.col("batch_id") < version).join(versions, "batch_id", "left_semi")
    # An older version run again may have counted a batch a second time, with the same counts
    return done.select(*schemas.KEYWORD_PARTS.names).dropDuplicates(["of_writer", "of_batch", "keyword"])


def run_recalibration(spark: SparkSession, root: str, version: int, now: Column) -> DataFrame:
    """Learn from all decisions so far and write the overrides as `version`.

    Only match lists of decisions in batches that no earlier version has counted are
    decoded; their counts are stored and added to the earlier ones. Versions rise; the last
    one may be repeated. Runs in the root's turn, so that no batch is half written.
    Returns the keywords whose multiplier is not 1.0.
    """
    with tables.turn(spark, root, _WRITER, version):
        before = stage(_counted(spark, root, version), "counted")
        decisions = tables.read_batches(spark, root, "decisions", schemas.DECISIONS).select(
            "job_id", F.col("decision").alias("user_decision"),
            F.col("writer").alias("of_writer"), F.col("batch_id").alias("of_batch"),
        )
        batches = ["of_writer", "of_batch"]
        fresh = many_to_one(decisions, before.select(*batches).distinct(), batches, "left_anti")
        analysis = tables.read_table(spark, root, "job_analysis", schemas.JOB_ANALYSIS)
        lists = analysis.select("job_id", "positive_matches", "negative_matches")
        parts = count_parts(decode_matches(fresh.join(lists, "job_id")), batches)
        tables.append_batch(parts, root, "keyword_parts", _WRITER, version)
        mine = tables.read_batch(spark, root, "keyword_parts", schemas.KEYWORD_PARTS, _WRITER, version)
        learned = stage(lift_of_parts(before.unionByName(mine)), "learned")
        table, adjusted = store_learned(learned, tables.read_overrides(spark, root, version), now)
        tables.write_overrides(table, root, version)
    return adjusted
