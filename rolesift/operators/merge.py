"""Insert once, upsert, update by id, and delete with children."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.operators.joins import many_to_one
from rolesift.operators.numbering import assign_ids
from rolesift.operators.ordered import first_per_key
from rolesift.session import stage


def null_key(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def unseen(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    collation: str | None = None,
) -> DataFrame:
    """Batch rows whose key is neither in the target nor on an earlier batch row.

    Rows with a null key are left out. The target is first cut to the batch's keys:
    with a small batch Spark broadcasts them and never shuffles the target; with a
    large one the second join reuses the first one's partitioning.
    """

    def keyed(df: DataFrame) -> DataFrame:
        key = (lambda k: F.collate(k, collation)) if collation else F.col
        return df.select("*", *[key(k).alias(f"_key_{k}") for k in keys])

    on = [f"_key_{k}" for k in keys]
    first = first_per_key(keyed(batch.filter(~null_key(keys))), on, order)
    present = keyed(target.select(*keys)).select(*on).join(first.select(*on), on, "left_semi")
    return first.join(present, on, "left_anti").drop(*on)


def insert_new(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_col: str | None = "id",
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Insert-if-absent. Returns the rows really inserted and the new target.

    One key set is enough for jobs: the global key on the posting id implies the
    one on (company, posting id). Columns the batch lacks are null.
    """
    fresh = unseen(target, batch, keys, order, collation)
    if id_col:
        start = target.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
        fresh = assign_ids(fresh, [*order, *keys], start, id_col)
    inserted = fresh.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            if f.name in fresh.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )
    return inserted, target.unionByName(inserted)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    touched: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Insert or replace `cols` by key; keys not in the batch stay as they are.

    Both sides hold a key at most once. A `touched` column moves to `now` on insert
    and where a value changed.
    """
    new = batch.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, list(keys), "full")
    hit = F.col("_new").isNotNull()
    out = [F.col(k) for k in keys]
    for field in target.schema.fields:
        name = field.name
        if name in keys:
            continue
        if name in cols:
            value = F.when(hit, F.col(f"_b_{name}").cast(field.dataType)).otherwise(F.col(name))
        elif name == touched:
            changed = F.col("_old").isNull()
            for f in target.schema.fields:
                if f.name in cols:
                    changed = changed | ~F.col(f.name).eqNullSafe(
                        F.col(f"_b_{f.name}").cast(f.dataType)
                    )
            value = F.when(hit & changed, now).otherwise(F.col(name))
        else:
            value = F.col(name)
        out.append(value.alias(name))
    return both.select(*out).select(*target.columns)


def apply_decisions(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set `user_decision` by job id; `decisions` holds a job at most once."""
    new = decisions.select(F.col("job_id").alias("id"), F.col("decision").alias("_decision"))
    out = jobs.join(new, "id", "left")
    decision = F.coalesce("_decision", "user_decision")
    return out.withColumn("user_decision", decision).select(*jobs.columns)


def decisions_matched(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(job_id, matched) per row of `decisions`: whether `apply_decisions` meets a job.

    Job ids are cut to those decided before anything is shuffled. A null id matches nothing.
    """
    wanted = decisions.select(F.col("job_id").alias("id")).distinct()
    met = stage(many_to_one(jobs.select("id"), wanted, ["id"], "left_semi").distinct(), "matched")
    marked = many_to_one(
        decisions.select("job_id"), met.select(F.col("id").alias("job_id"), F.lit(True).alias("matched")), ["job_id"], "left"
    )
    return marked.select("job_id", F.coalesce("matched", F.lit(False)).alias("matched"))


def delete_where(
    parent: DataFrame,
    predicate: Column,
    key: str,
    children: dict[str, tuple[DataFrame, str]],
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete parents by predicate and their children by parent key.

    `children` maps a name to (table, its parent-key column). Returns what is left
    of every table (the parent under `parent`) and the deleted counts per table.
    """
    hit = F.coalesce(predicate, F.lit(False))
    doomed = stage(parent.filter(hit).select(key), "doomed")
    left = {"parent": parent.filter(~hit)}
    counts = [doomed.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("parent").alias("table"), "deleted")]
    for name, (child, fk) in children.items():
        gone = doomed.select(F.col(key).alias(fk))
        left[name] = many_to_one(child, gone, [fk], "left_anti")
        hits = many_to_one(child.select(fk), gone, [fk], "left_semi")
        counts.append(hits.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted"))
    return left, reduce(DataFrame.unionByName, counts)
