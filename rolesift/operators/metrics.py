"""Funnel counts, run totals and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(df: DataFrame, keys: Sequence[str], stages: dict[str, Column]) -> DataFrame:
    """One count per stage and key, in one pass over rows that carry stage flags."""
    counts = [F.count_if(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in stages.items()]
    return df.groupBy(*keys).agg(*counts)


def run_summary(inserted: DataFrame) -> DataFrame:
    """New jobs per source."""
    return inserted.groupBy("source").agg(F.count(F.lit(1)).alias("new_jobs"))


def rejects(
    df: DataFrame, source: str, stage: str, reason: Column, raw: Column, file: Column | None = None
) -> DataFrame:
    """Rows whose `reason` is not null, in the shape of the rejects table."""
    company = F.col("company_id") if "company_id" in df.columns else F.lit(None)
    return df.withColumn("_reason", reason).filter(F.col("_reason").isNotNull()).select(
        F.lit(source).alias("source"),
        company.cast("int").alias("company_id"),
        F.lit(stage).alias("stage"),
        F.col("_reason").alias("reason"),
        raw.cast("string").alias("raw"),
        (F.lit(None) if file is None else file).cast("string").alias("file"),
    )


UNREADABLE = "unreadable line"


def line_rejects(lines: DataFrame, source: str, stage: str) -> DataFrame:
    """Broken landed lines as rejects: the whole line, and the file it is in."""
    return rejects(lines, source, stage, F.lit(UNREADABLE), F.col("broken_line"), F.col("landed_file"))


def not_reported(found: DataFrame, reported: DataFrame | None) -> DataFrame:
    """Rejected lines without those of files that an earlier batch has reported already."""
    if reported is None:
        return found
    before = reported.filter(F.col("reason") == UNREADABLE).select("stage", "file").distinct()
    return found.join(before, ["stage", "file"], "left_anti")
