"""Joins of many rows to a table that holds each key at most once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.operators.ordered import first_per_key
from rolesift.session import plan_bytes, stage

BROADCAST_BYTES = 32 << 20
_HOT_SHARE = 1000
_ROW_BYTES = 48  # what a hash table keeps for a row besides its values


def measured_bytes(df: DataFrame) -> int:
    """The size of `df` as rows in memory, counted in one pass.

    Spark's own estimate takes file sizes, which are compressed, and does not grow through
    an explode.
    """
    width = F.lit(_ROW_BYTES + 8 * len(df.columns)).cast("long")
    for field in df.schema:
        if not isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            text = F.col(f"`{field.name}`")
            if not isinstance(field.dataType, (T.StringType, T.BinaryType)):
                text = F.to_json(F.struct(text))
            width = width + F.coalesce(F.octet_length(text), F.lit(0))
    return df.agg(F.sum(width)).first()[0] or 0


def fits_broadcast(df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether Spark's estimate and the counted size of `df` are both within the bound."""
    return plan_bytes(df) <= broadcast_bytes and measured_bytes(df) <= broadcast_bytes


def many_to_one(
    rows: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join where any share of `rows` may carry one key and `dim` has unique keys.

    A `dim` is broadcast if its counted rows and widths are below `broadcast_bytes`; stage
    one that is costly to compute, as it is read for that first. Beyond that the hot keys,
    those with over a thousandth of all rows, are joined against a broadcast of
    their own `dim` rows; there are fewer than a thousand of them by division. Rows
    with a null key match nothing and are not joined at all. Only the remaining,
    evenly spread rows are shuffled. The result is whole either way.
    """
    on = list(on)
    if fits_broadcast(dim, broadcast_bytes):
        return rows.join(F.broadcast(dim), on, how)
    keyed = reduce(and_, [F.col(k).isNotNull() for k in on])
    full = rows.filter(keyed)
    per_key = full.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    floor = per_key.agg(F.sum("_n") / _HOT_SHARE).scalar()
    hot = F.broadcast(stage(per_key.filter(F.col("_n") > floor).select(*on), "hot-keys"))
    hot_dim = F.broadcast(dim.join(hot, on, "left_semi"))
    hot_part = full.join(hot, on, "left_semi").join(hot_dim, on, how)
    whole = hot_part.unionByName(full.join(hot, on, "left_anti").join(dim, on, how))
    if how in ("left", "left_anti"):
        whole = whole.unionByName(rows.filter(~keyed), allowMissingColumns=True)
    return whole


def join_details(
    postings: DataFrame,
    details: DataFrame,
    keys: Sequence[str],
    detail_order: Sequence[str | Column],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each posting with its one detail; extra landed copies of a detail are ignored.

    `postings` has unique keys. `detail_order` are plain values, of which the least comes first
    (nulls before all others); rows that are equal in them count as copies, and any one is taken.

    Details are cut to the postings' keys before any of their bodies is shuffled. Postings
    beyond the broadcast bound take two reads of `details`: one writes keys and order values,
    from which each key's row is chosen, the other joins the bodies to the chosen rows, in at
    most one shuffle.
    """
    keys = list(keys)
    wanted = postings.select(*keys)
    if fits_broadcast(wanted, broadcast_bytes):
        near = details.join(F.broadcast(wanted), keys, "left_semi")
        return postings.join(first_per_key(near, keys, detail_order), keys)
    order = {f"_order_{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(detail_order)}
    version = F.md5(F.to_json(F.struct(*[o.cast("string").alias(name) for name, o in order.items()])))
    narrow = details.select(*keys, *[o.alias(name) for name, o in order.items()], version.alias("_version"))
    near = many_to_one(stage(narrow, "detail-keys"), wanted, keys, "left_semi", broadcast_bytes)
    chosen = first_per_key(near, keys, list(order)).select(*keys, "_version")
    chosen = stage(postings.join(chosen, keys), "chosen-details")
    on = [*keys, "_version"]
    small = F.broadcast(chosen) if fits_broadcast(chosen, broadcast_bytes) else chosen
    both = details.withColumn("_version", version).alias("d").join(
        small.alias("p"), reduce(and_, [F.col(f"d.{k}") == F.col(f"p.{k}") for k in on])
    )
    one = first_per_key(both, [f"d.{k}" for k in on], ["d._version"])
    rest = [f"{side}.{k}" for side, df in (("p", postings), ("d", details)) for k in df.columns if k not in keys]
    return one.select(*[f"p.{k}" for k in keys], *rest)


def jobs_with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with their company's name."""
    names = companies.select(
        F.col("id").alias("company_id"), F.col("company_name").alias("company")
    )
    return many_to_one(jobs, names, ["company_id"])


def job_by_id(jobs: DataFrame, companies: DataFrame, job_id: int) -> DataFrame:
    """The job of that id with its company's name; a job of an unknown company has none."""
    one = jobs.filter(F.col("id") == job_id)
    names = companies.select(F.col("id").alias("company_id"), F.col("company_name").alias("company"))
    return many_to_one(one, names, ["company_id"], "left").select(*jobs.columns, "company")


def decided_with_analysis(jobs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Decision and match lists of every decided job that was analysed."""
    decided = jobs.filter(F.col("user_decision").isNotNull())
    return decided.select(F.col("id").alias("job_id"), "user_decision").join(
        analysis.select("job_id", "positive_matches", "negative_matches"), "job_id"
    )
