"""JSON-encoded match lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_list(items: Column) -> Column:
    return F.to_json(items)


def decode_list(text: Column) -> Column:
    """The list in `text`; bad JSON, a non-list and null all give an empty list."""
    return F.coalesce(
        F.from_json(text, "array<string>"), F.array().cast("array<string>")
    )


def json_field(fields: Column, name: str, default: Column) -> Column:
    """A value of a `map<string,string>`: the default stands in for a missing key only."""
    return F.when(F.map_contains_key(fields, name), fields[name]).otherwise(default)
