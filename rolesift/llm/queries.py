"""Named queries of this subpackage on whole tables, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolesift.llm import (
    decontamination,
    exact_dedup,
    filter_audit,
    licenses,
    lm_scoring,
    packing,
    quality,
    simhash,
    spelling,
    toxicity,
    training_order,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The rules of the URL query
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

TOKENIZERS = "/opt/tokenizers"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query
def op2_toxicity(spark, d):
    return toxicity.toxicity_digest(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op3_warc_bundles(spark, d):
    return warc.archive_digest(table(spark, d, "pages"))


@query
def op4_training_order(spark, d):
    vocabulary = training_order.Vocabulary.from_file(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    return training_order.materialise(table(spark, d, "documents"), vocabulary).rows


@query
def op5_decontamination(spark, d):
    return decontamination.contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op6_lm_scoring(spark, d):
    return lm_scoring.lm_digest(table(spark, d, "documents"))


@query
def op7_exact_dedup(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents"))


@query
def op8_simhash(spark, d):
    return simhash.near_groups(table(spark, d, "documents"))


@query
def op9_license_scan(spark, d):
    return licenses.scan_licenses(table(spark, d, "documents"))


@query
def op10_url_filter(spark, d):
    return url_filter.judge_urls(table(spark, d, "pages"), url_filter.rule_table(spark, URL_RULES))


@query
def op11_filter_audit(spark, d):
    return filter_audit.audit_digest(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op12_spelling_variants(spark, d):
    return spelling.spelling_digest(table(spark, d, "documents"))


@query
def op13_quality_rules(spark, d):
    return quality.quality_digest(table(spark, d, "documents"), table(spark, d, "labels"))
