"""Row numbers without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.operators.joins import many_to_one
from rolesift.session import stage

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row's place in its low 33 bits


def assign_ids(
    df: DataFrame, order: Sequence[str], start: Column | None = None, id_col: str = "id"
) -> DataFrame:
    """Consecutive ids in `order` that go on from `start`, such as a greatest id.

    Rows are range-partitioned and sorted once, and written with their place; a
    row's id is its place plus the rows in earlier partitions. `order` must tell
    all rows apart.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    )
    slot = F.col("_slot")
    placed = placed.withColumn("_part", F.shiftright(slot, _SLOT_BITS)).withColumn(
        "_local", slot.bitwiseAND((1 << _SLOT_BITS) - 1)
    )
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_local") + F.col("_before") + 1
    if start is not None:
        number = number + start
    # One row per partition: a proven bound for the broadcast and for the window
    return placed.join(F.broadcast(offsets), "_part").select(number.alias(id_col), *df.columns)


def number_messages(df: DataFrame, order: Sequence[str], group: Sequence[str]) -> DataFrame:
    """`i` of `n` for every message of its group; a group may span any number of tasks."""
    rows = assign_ids(df, [*group, *order], id_col="_row").withColumn("_group", F.struct(*group))
    spans = rows.groupBy("_group").agg(
        (F.min("_row") - 1).alias("_before"), F.count(F.lit(1)).alias("n")
    )
    joined = many_to_one(rows, stage(spans, "groups"), ["_group"])
    return joined.select(*df.columns, (F.col("_row") - F.col("_before")).alias("i"), "n")
