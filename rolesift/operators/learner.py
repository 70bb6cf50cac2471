"""Keyword multipliers from the lift of their acceptance rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions.lists import decode_list
from rolesift.operators.merge import upsert

MEASURES = ("multiplier", "accept_count", "reject_count", "sample_count", "lift")


def _accepted() -> Column:
    return F.coalesce(F.col("user_decision") == "applied", F.lit(False))


def decode_matches(decided: DataFrame) -> DataFrame:
    """Decided rows with one `keywords` array in place of both JSON match lists."""
    both = F.concat(decode_list(F.col("positive_matches")), decode_list(F.col("negative_matches")))
    kept = [n for n in decided.columns if n not in ("positive_matches", "negative_matches", "keywords")]
    return decided.select(*kept, both.alias("keywords"))


def decision_totals(decided: DataFrame) -> DataFrame:
    """One row: total, accepted and rejected decisions."""
    accepted = F.count_if(_accepted())
    total = F.count(F.lit(1))
    return decided.agg(
        total.alias("total"), accepted.alias("accepted"), (total - accepted).alias("rejected")
    )


def keyword_counts(decided: DataFrame) -> DataFrame:
    """Accepted and rejected counts per keyword of the `keywords` array."""
    # Outer, as a plain explode adds a size filter that would decode the lists twice
    each = decided.select(_accepted().alias("_ok"), F.explode_outer("keywords").alias("keyword"))
    return each.filter(F.col("keyword").isNotNull()).groupBy("keyword").agg(
        F.count_if(F.col("_ok")).alias("accept_count"),
        F.count_if(~F.col("_ok")).alias("reject_count"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def lift_multiplier(lift: Column) -> Column:
    """Boost above 1.3, suppress below 0.7, else 1.0; kept within 0.25 and 2."""
    boosted = F.least(F.lit(rules.MAX_MULTIPLIER), 1.0 + (lift - 1.0) * 0.5)
    suppressed = F.greatest(F.lit(rules.MIN_MULTIPLIER), lift)
    return (
        F.when(lift > rules.BOOST_ABOVE, boosted)
        .when(lift < rules.SUPPRESS_BELOW, suppressed)
        .otherwise(1.0)
    )


def keyword_lift(
    decided: DataFrame,
    min_samples: int = rules.MIN_KEYWORD_SAMPLES,
    min_total: int = rules.MIN_TOTAL_DECISIONS,
) -> DataFrame:
    """Counts, lift and multiplier per keyword seen often enough.

    Empty unless there are `min_total` decisions and at least one acceptance.
    """
    return _lifted(keyword_counts(decided), decision_totals(decided), min_samples, min_total)


def _lifted(counts: DataFrame, totals: DataFrame, min_samples: int, min_total: int) -> DataFrame:
    gated = counts.filter(F.col("sample_count") >= min_samples).withColumns(
        {"_total": totals.select("total").scalar(), "_accepted": totals.select("accepted").scalar()}
    ).filter((F.col("_total") >= min_total) & (F.col("_accepted") > 0))
    rate = F.col("accept_count") / F.col("sample_count")
    lifted = gated.withColumn("lift", rate / (F.col("_accepted") / F.col("_total")))
    return lifted.withColumn("multiplier", lift_multiplier(F.col("lift"))).drop(
        "_total", "_accepted"
    )


def count_parts(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per value of `by` and keyword that can be added up later.

    The row with a null keyword counts the decisions themselves, those without keywords too.
    """
    each = decided.select(
        *by, _accepted().alias("_ok"),
        F.explode(F.array_append(F.coalesce(F.array_compact("keywords"), F.array().cast("array<string>")), F.lit(None))).alias("keyword"),
    )
    return each.groupBy(*by, "keyword").agg(
        F.count_if("_ok").alias("accept_count"), F.count_if(~F.col("_ok")).alias("reject_count"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def lift_of_parts(
    parts: DataFrame,
    min_samples: int = rules.MIN_KEYWORD_SAMPLES,
    min_total: int = rules.MIN_TOTAL_DECISIONS,
) -> DataFrame:
    """`keyword_lift` of all decisions that the parts have counted."""
    names = ("accept_count", "reject_count", "sample_count")
    added = parts.groupBy("keyword").agg(*[F.sum(n).alias(n) for n in names])
    totals = parts.filter(F.col("keyword").isNull()).agg(
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("accept_count"), F.lit(0)).alias("accepted"),
    )
    return _lifted(added.filter(F.col("keyword").isNotNull()), totals, min_samples, min_total)


def recalibrate(
    decided: DataFrame, overrides: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """New overrides table, and the keywords whose multiplier is not 1.0.

    `decided` carries the `keywords` array. Negative keywords count like positive
    ones: a high lift on one raises its penalty.
    """
    return store_learned(keyword_lift(decided), overrides, now)


def store_learned(learned: DataFrame, overrides: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The overrides with what was learned, and the keywords whose multiplier is not 1.0."""
    stored = learned.withColumn("lift", F.round("lift", 4))
    table = upsert(overrides, stored, ["keyword"], MEASURES, "updated_at", now)
    adjusted = learned.filter(F.col("multiplier") != 1.0).select("keyword", "multiplier")
    return table, adjusted
