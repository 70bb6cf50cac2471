"""Detail documents of both sources in one record shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.html import html_text
from rolesift.functions.lists import json_field

_FIELDS = "map<string,string>"


def _usable(fields: Column) -> Column:
    """The detail answered 200 and is a non-empty object."""
    good = (F.col("status_code") == 200) & (F.size(F.map_keys(fields)) > 0)
    return F.coalesce(good, F.lit(False))


def _or_empty(fields: Column) -> Column:
    return F.coalesce(fields, F.create_map().cast(_FIELDS))


def normalize_a(details: DataFrame) -> DataFrame:
    """Fields of a paged source's detail, and `detail_ok`.

    `''` stands in for a missing key; a null one stays null.
    """
    f, empty = F.col("_f"), F.lit("")
    return (
        details.withColumn("_outer", F.from_json("body", _FIELDS))
        .withColumn("detail_ok", _usable(F.col("_outer")))
        .withColumn("_f", _or_empty(F.from_json(F.col("_outer")["jobPostingInfo"], _FIELDS)))
        .withColumn("title", json_field(f, "title", empty))
        .withColumn("ats_job_id", json_field(f, "jobReqId", empty))
        .withColumn("location", json_field(f, "location", empty))
        .withColumn("posted", json_field(f, "postedOn", empty))
        .withColumn("description", html_text(json_field(f, "jobDescription", empty)))
        .drop("_outer", "_f")
    )


def normalize_b(details: DataFrame) -> DataFrame:
    """Fields of a board's detail, and `detail_ok`.

    The requisition id falls back to the posting id, and the place to `Unknown`, only
    where the key is missing; an explicit null stays null.
    """
    f, empty, unknown = F.col("_f"), F.lit(""), F.lit("Unknown")
    return (
        details.withColumn("_outer", F.from_json("body", _FIELDS))
        .withColumn("detail_ok", _usable(F.col("_outer")))
        .withColumn("_f", _or_empty(F.col("_outer")))
        .withColumn("title", json_field(f, "title", empty))
        .withColumn("ats_job_id", json_field(f, "requisition_id", F.col("job_id").cast("string")))
        .withColumn("location", json_field(_or_empty(F.from_json(f["location"], _FIELDS)), "name", unknown))
        .withColumn("posted", json_field(f, "updated_at", unknown))
        .withColumn("description", json_field(f, "content", empty))
        .withColumn("application_link", json_field(f, "absolute_url", empty))
        .drop("_outer", "_f")
    )
