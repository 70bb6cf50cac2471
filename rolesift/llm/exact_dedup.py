"""Exact duplicates by an extendible-hash index on shared files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.operators.joins import many_to_one
from rolesift.session import stage

BUCKET_KEYS = 4096
MAX_DEPTH = 20
_HOT_SHARE = 1000


def squeeze_spaces(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as ''.

    The pattern matches only runs that are not one space already.
    """
    runs = r"(?: [ \x09-\x0D]|[\x09-\x0D])[ \x09-\x0D]*"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


@dataclass(frozen=True)
class ExactIndex:
    """`directory`, and tables on shared files.

    `entries`: one row per different text, by bucket: bucket, key, chain (its place among
    texts of an equal key), text_sha256, keep_id, group_size. `rows`: every document's id,
    key and digest.
    """

    directory: Directory
    entries: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class Directory:
    """`depth`: leading bits of a key that pick a slot; `slots`: slot, depth of its bucket, bucket."""

    depth: int
    slots: DataFrame

    def slot(self, key: Column) -> Column:
        return F.shiftrightunsigned(key, 64 - self.depth)


def directory_of(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> Directory:
    """The directory after all splits of buckets with over `bucket_keys` different keys.

    A split sends a bucket's keys by one more leading bit, and doubles the directory when
    the bucket's depth was the directory's. So the final buckets are the widest key ranges
    that fit (or have `max_depth`) inside ranges that do not. The sizes of all possible
    buckets are counted together, from at most 2**max_depth cells, in place of one job per
    doubling. `bucket` is the first cell of its range.
    """
    cell = F.shiftrightunsigned(F.col("key"), 64 - max_depth).alias("cell")
    cells = keys.select("key").distinct().groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(max_depth) - F.col("depth"))
    tried = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    sizes = stage(
        tried.groupBy("depth", (F.col("cell") - F.pmod("cell", width)).alias("bucket")).agg(F.sum("n").alias("held")),
        "dedup-sizes",
    )
    over = sizes.filter((F.col("held") > bucket_keys) & (F.col("depth") < max_depth))
    halves = over.select(
        (F.col("depth") + 1).alias("depth"),
        F.explode(F.array("bucket", F.col("bucket") + F.shiftright(width, 1))).alias("bucket"),
    )
    fit = sizes.join(over.select("depth", "bucket"), ["depth", "bucket"], "left_anti")
    whole = fit.filter(F.col("depth") == 0).select("depth", "bucket")
    leaves = stage(whole.unionByName(fit.select("depth", "bucket").join(halves, ["depth", "bucket"])), "dedup-buckets")
    depth = max(1, leaves.agg(F.max("depth")).first()[0] or 0)
    spread = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(depth) - F.col("depth"), F.lit(0)))
    first = F.shiftright("bucket", max_depth - depth)
    slots = leaves.select(F.explode(F.sequence(first, first + spread - 1)).alias("slot"), "depth", "bucket")
    return Directory(depth, stage(slots, "dedup-directory"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> ExactIndex:
    """Index every document's squeezed text by XXH64 key.

    Each bucket is a range of keys and belongs to one task, which groups its rows by key
    and then by the bytes of the whole text. Keys with over a thousandth of all rows, of
    which there are fewer than a thousand by division, are grouped apart: their rows are
    combined in each task before any text is shuffled, so a text that a third of all rows
    share moves once per task.
    """
    text = squeeze_spaces(F.col(text_col))
    full = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("key", F.xxhash64("_text"))
    rows = stage(full.select("_id", "key", F.sha2("_text", 256).alias("text_sha256")), "dedup-keys")
    directory = directory_of(rows, bucket_keys, max_depth)

    per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    floor = F.lit(rows.count() / _HOT_SHARE)
    hot = F.broadcast(stage(per_key.filter(F.col("_n") > F.greatest(floor, F.lit(1))).select("key"), "dedup-hot"))

    kept = [F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # At most 2**max_depth slots of two numbers: a proven bound for the broadcast
    slots = F.broadcast(directory.slots.select(F.col("slot").alias("_slot"), "bucket"))
    placed = full.withColumn("_slot", directory.slot(F.col("key"))).join(slots, "_slot").drop("_slot")
    owned = placed.join(hot, "key", "left_anti").repartition("bucket")
    common = owned.groupBy("bucket", "key", "_text").agg(*kept)
    copied = placed.join(hot, "key", "left_semi").groupBy("bucket", "key", "_text").agg(*kept)
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("_text")).alias("chain")
    columns = ["bucket", "key", chain, F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"]
    entries = common.select(*columns).unionByName(copied.select(*columns))
    return ExactIndex(directory, stage(entries, "dedup-index"), rows)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after `squeeze_spaces`; the row with the least id stays.
    A null text counts as ''. A null id never wins over another id; a group of null ids
    only has a null keep_id, and all its rows are kept. Rows that repeat the least id of
    their group are all kept, as no id tells them apart. Other columns are not read; an
    empty table gives an empty result.
    """
    index = build_index(docs, id_col, text_col, bucket_keys, max_depth)
    entries = index.entries.select("key", "text_sha256", "keep_id", "group_size")
    found = many_to_one(index.rows, entries, ["key", "text_sha256"])
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
