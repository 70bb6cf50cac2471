"""Landed JSON: list pages, boards, details and decision events, batch or stream."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from rolesift import rules, schemas
from rolesift.session import stage


# What every landed row tells beside its fields: the whole line if it is no such JSON, and its file
BROKEN, FILE = "broken_line", "landed_file"


def _read(
    spark: SparkSession, path: str, schema: StructType, streaming: bool, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    options = {"maxFilesPerTrigger": str(max_files)} if streaming and max_files else {}
    full = StructType([*schema.fields, StructField(BROKEN, StringType())])
    rows = reader.schema(full).options(columnNameOfCorruptRecord=BROKEN, **options).json(path)
    return rows.withColumn(FILE, F.col("_metadata.file_path"))


def whole_lines(rows: DataFrame) -> DataFrame:
    """The rows whose line could be read; all rows of a table that was not read from files."""
    return rows.filter(F.col(BROKEN).isNull()) if BROKEN in rows.columns else rows


def broken_lines(rows: DataFrame) -> DataFrame:
    """The rows whose line was cut off, is no JSON, or has a field of another type.

    They are written before use: Spark does not read files for their broken lines alone, and
    a line is judged by all its fields, not by those that a plan happens to need.
    """
    return stage(rows.filter(F.col(BROKEN).isNotNull()), "broken-lines")


def read_pages(
    spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.PAGES, streaming, max_files)


def read_boards(
    spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.BOARDS, streaming, max_files)


def read_details(
    spark: SparkSession,
    path: str,
    source: str,
    streaming: bool = False,
    since: date | None = None,
) -> DataFrame:
    """All landed details, or those of the folders `dt=<day>` from `since` on.

    Only the folders' names are looked at to leave out the others.
    """
    schema = schemas.DETAILS_A if source == rules.SOURCE_A else schemas.DETAILS_B
    columns = [*schema.names, BROKEN, FILE]
    if since is None:
        return _read(spark, path, schema, streaming).select(*columns)
    by_day = StructType([*schema.fields, StructField("dt", DateType())])
    rows = _read(spark, path, by_day, streaming)
    return rows.filter(F.col("dt") >= F.lit(since)).select(*columns)


def read_decisions(
    spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.DECISION_EVENTS, streaming, max_files)
