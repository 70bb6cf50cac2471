"""The company registry and the CSV it is built from."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions.html import trim_space
from rolesift.operators.numbering import assign_ids
from rolesift.operators.ordered import first_per_key


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV by header name; a byte-order mark and extra columns are ignored."""
    return spark.read.csv(path, header=True, encoding="UTF-8")


def _text(name: str):
    return trim_space(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def read_registry(spark: SparkSession, path: str, link_col: str) -> DataFrame:
    """Companies with a link in `link_col`: trimmed name and url, both non-empty."""
    rows = scan_csv(spark, path).select(
        _text(rules.NAME_COLUMN).alias("name"), _text(link_col).alias("url")
    )
    return rows.filter((F.col("name") != "") & (F.col("url") != ""))


def _line_order(csv: DataFrame) -> Column:
    """A key that sorts the rows of files by path, place of the block, and line."""
    line = F.monotonically_increasing_id()  # a block is read in order, by one task
    try:
        csv.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return line
    return F.struct("_metadata.file_path", "_metadata.file_block_start", line.alias("line"))


def build_registry(csv: DataFrame, order: Column | None = None) -> DataFrame:
    """company_info rows: the source is the one whose link column is filled.

    The first row of a name in `order` wins, and ids follow it. By default that is the order
    of lines, for a CSV of several files that of their paths and then of lines; for rows that
    are not straight from files it is the order in which Spark holds them.
    """
    ats, link = F.lit(""), F.lit("")
    for source, column in reversed(rules.LINK_COLUMNS):
        filled = _text(column) != ""
        ats = F.when(filled, F.lit(source)).otherwise(ats)
        link = F.when(filled, _text(column)).otherwise(link)
    rows = csv.select(
        (_line_order(csv) if order is None else order).alias("_line"),
        _text(rules.NAME_COLUMN).alias("company_name"),
        F.lit("").alias("base_country"),
        F.lit("").alias("target_location"),
        ats.alias("ats"),
        link.alias("ats_link"),
    ).filter("company_name <> ''")
    once = first_per_key(rows, ["company_name"], ["_line"])
    return assign_ids(once, ["_line"]).drop("_line").withColumn("id", F.col("id").cast("int"))


def _same(name: str, value: str, collation: str | None) -> Column:
    return (F.collate(name, collation) if collation else F.col(name)) == value


def companies_for(registry: DataFrame, ats: str, collation: str | None = None) -> DataFrame:
    """Companies of one source that have a link."""
    hit = _same("ats", ats, collation) & (F.col("ats_link") != "")
    return registry.filter(hit).select(
        "id", F.col("company_name").alias("name"), F.col("ats_link").alias("url")
    )


def company_id(registry: DataFrame, name: str, collation: str | None = None) -> DataFrame:
    """The id of one company, or no row."""
    return registry.filter(_same("company_name", name, collation)).select("id").limit(1)
