"""Boolean column rules. None of them is ever null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"[Tt ].*([Zz]|[+-]\d{2}(:?\d{2})?)$"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-insensitive substring test; null and empty texts contain nothing."""

    def hit(lowered: Column) -> Column:
        return reduce(or_, [lowered.contains(word) for word in words], F.lit(False))

    # As a one-element array, so that a filter lowers the text once and not per word
    return F.coalesce(F.exists(F.array(F.lower(text)), hit), F.lit(False))


def title_ok(title: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """No excluded substring and at least one included."""
    return ~contains_any(title, exclude) & contains_any(title, include)


def recent_text(posted: Column) -> Column:
    """`today` or `yesterday`, else a first number of at most 1, whatever its unit."""
    lowered = F.lower(posted)
    number = F.regexp_extract(lowered, r"(\d+)", 1)
    hit = (
        lowered.contains("today")
        | lowered.contains("yesterday")
        | number.rlike("^0*[01]$")
    )
    return F.coalesce(hit, F.lit(False))


def recent_ts(updated: Column, as_of: Column, hours: int = 24) -> Column:
    """ISO text with an offset, not older than `hours` before `as_of`; no upper bound.

    Text without an offset is dropped: it names no instant.
    """
    cutoff = as_of - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    # The guard comes first, as Spark would read offset-less text in the session zone
    instant = F.when(updated.rlike(_OFFSET), F.try_to_timestamp(updated))
    return F.coalesce(instant >= cutoff, F.lit(False))


def fresh_instant(ts: Column, as_of: Column, hours: int = 24) -> Column:
    """The same cut for a column that is a timestamp already."""
    return F.coalesce(ts >= as_of - F.expr(f"INTERVAL '{int(hours)}' HOUR"), F.lit(False))


def location_ok(name: Column, offices: Column, words: Sequence[str]) -> Column:
    """The primary name, or any `offices[].location.name`, holds one of the words."""
    any_office = F.exists(offices, lambda o: contains_any(o["location"]["name"], words))
    return contains_any(name, words) | F.coalesce(any_office, F.lit(False))


def fits(widths: dict[str, int]) -> Column:
    """No named column is longer than its width."""
    too_long = [F.coalesce(F.length(F.col(c)) > n, F.lit(False)) for c, n in widths.items()]
    return ~reduce(or_, too_long, F.lit(False))
