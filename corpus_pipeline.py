"""A corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs`, and returns a
DataFrame. All but the last return the columns of `docs`.

Stages work on numbered columns and bring the names back at the end, so a column of `docs`
stays as it is whatever its name, also one with a dot or one that differs from another in
case only. Null texts are empty, an empty table gives an empty one, and of rows that nothing
tells apart but their copies one stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm import decontamination, exact_dedup, packing, simhash, toxicity
from rolesift.llm.columns import numbered, place_of, take
from rolesift.operators.joins import many_to_one
from rolesift.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return take(spark.read.parquet(f"{sf_dir}/{name}.parquet"), **{c: c for c in columns})


def _working(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with numbered columns, and which of them are the id and the text."""
    return numbered(docs), *(f"_{place_of(docs, name)}" for name in ("doc_id", "text"))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The numbered columns of `rows` under the names of `docs`."""
    return rows.select(*(f"_{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def _one_of_each(rows: DataFrame, keys: Sequence[str], repeated: DataFrame) -> DataFrame:
    """`rows` with one row only of each key that is in `repeated`, a written table of unique keys."""
    if repeated.isEmpty():
        return rows
    marked = many_to_one(rows, repeated.withColumn("repeated", F.lit(True)), keys, "left")
    # Partial aggregates: a task sends one row of each key, however many it has
    firsts = marked.filter("repeated").groupBy(*keys).agg(F.first(F.struct(*rows.columns)).alias("one"))
    return marked.filter("repeated is null").select(*rows.columns).unionByName(firsts.select("one.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. The model learns as in the toxicity query.

    A null or empty text has the score of no features; a null id is never learned from.
    """
    rows, ident, text = _working(docs)
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(take(docs, doc_id="doc_id", text="text"), labels, toxicity.not_held_out)
    scored = toxicity.score_texts(rows, model, text, "score")
    return _named(scored.filter(F.col("score") < 0.5), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least id. Only the groups of several rows are joined.

    Where rows repeat the least id of their group, or all ids are null, one of them stays.
    """
    rows, ident, text = _working(docs)
    groups = exact_dedup.exact_groups(rows.select(ident, text), ident, text).filter(F.col("group_size") > 1)
    groups = stage(groups.groupBy(F.col("text_sha256").alias("digest")).agg(
        F.min("keep_id").alias("keep"), F.count_if("kept").alias("n"), F.lit(True).alias("several")), "copies")
    digest = F.sha2(exact_dedup.squeeze_spaces(F.col(text)), 256)
    marked = many_to_one(rows.withColumn("digest", digest), groups.drop("n"), ["digest"], "left")
    least = marked.filter(F.col("several").isNull() | F.col(ident).eqNullSafe(F.col("keep")))
    tied = stage(groups.filter(F.col("n") > 1).select("digest"), "tied")
    return _named(_one_of_each(least.drop("keep", "several"), ["digest"], tied), docs)


def _row_key(ident: str, text: str) -> Column:
    """Orders rows by id, null ids last, and tells rows of one id apart by their text."""
    ident, text = F.col(ident), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return F.struct(ident.isNull().alias("no_id"), F.coalesce(ident, F.lit(0)).alias("id"), text.alias("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the least id; of its copies one."""
    rows, ident, text = _working(docs)
    rows = rows.withColumn("row", _row_key(ident, text))
    groups = simhash.near_groups(rows.select("row", text), id_col="row", text_col=text)
    groups = stage(groups.select("row", (F.col("row") != F.col("component_id")).alias("away")), "near-groups")
    per_row = groups.groupBy("row").agg(F.first("away").alias("away"), F.count(F.lit(1)).alias("n"))
    marks = stage(per_row.filter(F.col("away") | (F.col("n") > 1)), "near-copies")
    least = many_to_one(rows, marks.filter("away").select("row"), ["row"], "left_anti")
    return _named(_one_of_each(least, ["row"], stage(marks.filter("not away").select("row"), "tied")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are under a twentieth of the words. Null texts have no words."""
    rows, ident, text = _working(docs)
    found = decontamination.find_contamination(rows, _table(spark, sf_dir, "benchmark", "item_id", "text"), text)
    return _named(found.filter(~decontamination.is_contaminated()), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins of permitted lengths; other columns are not read."""
    return packing.pack(take(docs, doc_id="doc_id", text="text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

# Fingerprints, the fitted model and the packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
