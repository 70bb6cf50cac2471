"""URL filter lists: digests of host-suffix and path-prefix expressions against rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.columns import ascii_lower
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else ''."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else ''."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame for `judge_urls`."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digests(rules: DataFrame) -> DataFrame:
    """One row per short digest prefix, with the full digests, rules and verdicts behind it."""
    host = ascii_lower(F.coalesce(F.col("host"), F.lit("")))
    path = F.coalesce(F.col("path"), F.lit(""))
    one = rules.select(host.alias("host"), path.alias("path"), "verdict").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict")  # of two verdicts for one rule, block wins
    )
    digest = F.sha2(F.concat("host", "path"), 256)
    return (
        one.select(
            F.substring(digest, 1, PREFIX_HEX).alias("prefix"),
            F.struct(
                digest.alias("digest"),
                (F.length("host") + F.length("path")).alias("length"),
                F.length("host").alias("host_length"),
                F.concat("host", "path").alias("rule"),
                "verdict",
            ).alias("entry"),
        )
        .groupBy("prefix")
        .agg(F.collect_list("entry").alias("entries"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdict on every url: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's;
    the longest rule text wins, of equally long ones that with the longer host. Each
    distinct (host, path) is expanded into its host suffixes times its path prefixes,
    joined to the rules on a short prefix of the expression's SHA-256, and confirmed by
    the full digest. Only suffixes of as many labels and prefixes of as many characters
    as some rule has can match, so only these are made.

    A null url, or one without `://`, has an empty host and path and gets `default`, as
    does every url without rules. Repeated rows and null ids are judged row by row; other
    columns of `pages` and `rules` are not read. Empty input gives an empty result.
    """
    rules = rules.select("host", "path", "verdict").filter(F.col("verdict").isNotNull())
    spark = pages.sparkSession
    # Distinct lengths: no more of them than the longest rule has labels and characters
    shape = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split(F.coalesce("host", F.lit("")), r"\.")))).alias("labels"),
        F.array_sort(F.collect_set(F.length(F.coalesce("path", F.lit(""))))).alias("lengths"),
    ).first()
    parts = pages.select(
        F.col(id_col).alias(id_col),
        F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col(url_col)), F.lit("")).alias("path"),
    )
    no_numbers = F.array().cast("array<int>")
    labels = F.array(*map(F.lit, shape.labels)) if shape.labels else no_numbers
    lengths = F.array(*map(F.lit, shape.lengths)) if shape.lengths else no_numbers
    suffixes = F.transform(
        F.filter(labels, lambda n: n <= F.size(F.split("host", r"\."))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n)
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    tried = (
        parts.select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    near = many_to_one(tried, stage(_digests(rules), "url-rules"), ["prefix"])
    hit = near.select("host", "path", "digest", F.explode("entries").alias("entry")).filter(
        F.col("entry.digest") == F.col("digest")
    )
    order = F.struct("entry.length", "entry.host_length")
    best = hit.groupBy("host", "path").agg(F.max_by("entry", order).alias("best"))
    best = stage(best.select("host", "path", "best.rule", "best.verdict"), "url-verdicts")
    judged = many_to_one(parts, best, ["host", "path"], "left")
    return judged.select(id_col, "host", "path", "rule",
                         F.coalesce("verdict", F.lit(default)).alias("verdict"))
