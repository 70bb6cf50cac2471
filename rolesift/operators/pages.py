"""Landed list pages: where reading stops, and the postings on the pages read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.operators.joins import many_to_one
from rolesift.session import stage


def series_ends(
    pages: DataFrame,
    series: Sequence[str],
    page_no: str,
    size: Column,
    limit: Column,
    bad: Column,
    max_pages: int,
) -> DataFrame:
    """Per series: `last` page a reader would fetch, why it `stop`s, and the landed pages seen.

    `stop` is `bad` or `short` where a page says so, `cap` at `max_pages`, and `missing` where
    the next page never landed; `last` is -1 if nothing is read. A series has at most
    `max_pages` different numbers that count, so they are kept as a list.
    """
    number = F.col(page_no)
    unusable = bad | (F.coalesce(size, F.lit(0)) == 0)
    counted = (number >= 0) & (number < max_pages)
    numbers = F.array_sort(F.collect_set(F.when(counted, number))).alias("_numbers")
    ends = pages.groupBy(*series).agg(
        F.min(F.when(counted & unusable, number)).alias("_unusable"),
        F.min(F.when(counted & ~unusable & (size < limit), number)).alias("_short"),
        numbers,
    )
    # Pages 0, 1, 2... stand at their own place in the list up to the first gap
    unbroken = F.size(F.filter("_numbers", lambda n, i: n == i))
    before_gap = (unbroken - 1).alias("_before_gap")
    ends = ends.select(*series, "_unusable", "_short", before_gap)
    last = F.least(F.col("_unusable") - 1, F.col("_short"), F.col("_before_gap"))
    return ends.withColumn("last", last).select(
        *series,
        "last",
        F.when(F.col("_unusable") == F.col("last") + 1, "bad")
        .when(F.col("_short") == F.col("last"), "short")
        .when(F.col("last") == max_pages - 1, "cap")
        .otherwise("missing")
        .alias("stop"),
    )


def pages_until_stop(
    pages: DataFrame,
    company: str = "company_id",
    page_no: str = "page_no",
    size: str | Column = "size",
    limit: str | Column = "limit",
    bad: str | Column = "bad",
    max_pages: int = rules.MAX_PAGES,
    run: Sequence[str] = (),
) -> DataFrame:
    """The pages a reader would have fetched, going from page 0 of each company.

    Reading stops before a missing, bad or empty page, after a page shorter than
    `limit`, and at `max_pages`. With `run`, each run of a company is a series of its
    own. Each series' last page is found from page numbers and sizes alone, so page
    bodies are not shuffled.
    """
    size, limit, bad = (F.col(c) if isinstance(c, str) else c for c in (size, limit, bad))
    series = [company, *run]
    ends = series_ends(pages, series, page_no, size, limit, bad, max_pages)
    last = ends.filter("last >= 0").withColumnRenamed("last", "_last").drop("stop")
    return read_to(pages, stage(last, "last-pages"), series, page_no).select(*pages.columns)


def read_to(pages: DataFrame, last: DataFrame, series: Sequence[str], page_no: str) -> DataFrame:
    """Pages from 0 to the `_last` of their series."""
    number = F.col(page_no)
    return many_to_one(pages, last, series).filter((number >= 0) & (number <= F.col("_last")))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Landed pages with `postings`, `size` and `bad`."""
    body = F.from_json("body", schemas.PAGE_BODY)
    return (
        pages.withColumn("_body", body)
        .withColumn("postings", F.col("_body.jobPostings"))
        .withColumn("size", F.coalesce(F.size("postings"), F.lit(0)))
        .withColumn("unreadable", F.col("_body").isNull() | F.col("_body._corrupt_record").isNotNull())
        .withColumn("bad", (F.coalesce(F.col("status_code"), F.lit(0)) != 200) | F.col("unreadable"))
        .drop("_body")
    )


def explode_postings(pages: DataFrame) -> DataFrame:
    """One row per posting, with its place on the page and what else `pages` tells of its run."""
    own = ["company_id", "page_no", *(c for c in ("run_id", "landed_at") if c in pages.columns)]
    # Outer, as a plain explode adds a size filter that would parse every body twice
    each = pages.select(*own, F.posexplode_outer("postings").alias("pos", "p"))
    return each.filter(F.col("p").isNotNull()).select(
        *own,
        "pos",
        F.col("p.externalPath").alias("external_path"),
        F.col("p.postedOn").alias("posted_on"),
        F.col("p.locationsText").alias("locations_text"),
    )


def parse_boards(boards: DataFrame) -> DataFrame:
    """Landed boards with `unreadable` and, where the board answered, `jobs`."""
    body = F.from_json("body", schemas.BOARD_BODY)
    return (
        boards.withColumn("_body", body)
        .withColumn("unreadable", F.col("_body").isNull() | F.col("_body._corrupt_record").isNotNull())
        .withColumn("jobs", F.when((F.col("status_code") == 200) & ~F.col("unreadable"), F.col("_body.jobs")))
        .drop("_body")
    )


def explode_board(boards: DataFrame) -> DataFrame:
    """One row per posting of the boards that answered."""
    each = boards.select("company_id", F.posexplode_outer("jobs").alias("pos", "j"))
    return each.filter(F.col("j").isNotNull()).select(
        "company_id",
        "pos",
        F.col("j.id").alias("job_id"),
        F.col("j.title").alias("title"),
        F.col("j.updated_at").alias("updated_at"),
        F.col("j.location.name").alias("location_name"),
        F.col("j.offices").alias("offices"),
    )
