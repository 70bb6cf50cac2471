"""One ingest run: landed files to new jobs, analyses, messages, rejects and counts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolesift import rules as fixed
from rolesift import schemas
from rolesift.functions import messages, urls
from rolesift.functions.html import strip_html
from rolesift.functions.lists import encode_list
from rolesift.functions.predicates import (
    contains_any,
    fits,
    location_ok,
    recent_text,
    recent_ts,
    title_ok,
)
from rolesift.operators import metrics, records
from rolesift.operators.joins import join_details, many_to_one
from rolesift.operators.merge import unseen
from rolesift.operators.numbering import assign_ids
from rolesift.operators.ordered import first_per_key
from rolesift.operators.pages import (
    explode_board,
    explode_postings,
    parse_boards,
    parse_pages,
    series_ends,
)
from rolesift.operators.scoring import relevance, stored_score
from rolesift.rules import RuleSet
from rolesift.session import stage
from rolesift.sources.landed import BROKEN, broken_lines, whole_lines

_JOB = ["company_id", "ats_job_id", "title", "location", "application_link"]
_MATCHES = ["positive_matches", "negative_matches", "experience_matches"]


@dataclass(frozen=True)
class IngestResult:
    """What one run adds. All parts read tables written during the run."""

    jobs: DataFrame
    analysis: DataFrame
    outbox: DataFrame
    rejects: DataFrame
    funnel: DataFrame
    held: DataFrame | None = None


def _parsed_once(parsed: DataFrame, bad: str) -> DataFrame:
    """Parsed files as a table: JSON is parsed once, and each later pass reads only
    the columns it needs. The raw body is kept where it has to be reported."""
    report = F.col(bad) | F.coalesce(F.col("status_code") != 200, F.lit(True))
    return stage(parsed.withColumn("body", F.when(report, F.col("body"))), "parsed")


def job_rejects(title_needed: bool = True) -> Column:
    """Why a scored row cannot be inserted, or null."""
    return (
        F.when(F.col("ats_job_id").isNull(), "null posting id")
        .when(F.lit(title_needed) & F.col("title").isNull(), "null title")
        .when(~fits(schemas.JOB_WIDTHS), "value too long")
    )


def _judge(
    detailed: DataFrame, keep: list[str], rules: RuleSet, overrides: DataFrame | None
) -> DataFrame:
    """Score the rows that passed the title rule, and write all rows with their flags."""
    text = F.when(F.col("after_title"), strip_html(F.col("description")))
    scored = relevance(detailed.withColumn("_text", text), "_text", rules, overrides)
    passed = F.col("after_title") & (F.col("score") >= rules.threshold)
    return stage(
        scored.withColumn("passed", passed).select(
            *keep, *_JOB, "company", "detail_ok", "after_title", "passed", "score", *_MATCHES
        ),
        "judged",
    )


def _admit(
    candidates: DataFrame,
    judged: DataFrame,
    keys: list[str],
    order: list[str],
    source: str,
    jobs: DataFrame,
    analysis: DataFrame,
    now: Column,
    pages: DataFrame,
    early_rejects: list[DataFrame],
    collation: str | None = None,
    title_needed: bool = True,
) -> IngestResult:
    """Insert what is new, and derive the other outputs from the inserted rows."""
    reason = job_rejects(title_needed)
    good = judged.filter(F.col("passed") & reason.isNull())
    last_job = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    last_analysis = analysis.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    # One analysis and one message per inserted job: `i` numbers all three
    fresh = stage(
        assign_ids(unseen(jobs, good, ["ats_job_id"], order, collation), [*order, "ats_job_id"], id_col="i")
        .withColumn("job_id", F.col("i") + last_job)
        .withColumn("analysis_id", F.col("i") + last_analysis),
        "fresh",
    )
    new_jobs = fresh.select(
        F.col("job_id").alias("id"),
        *_JOB,
        now.alias("created_ts"),
        F.lit(None).cast("string").alias("user_decision"),
    )
    new_analysis = fresh.select(
        F.col("analysis_id").alias("id"),
        "job_id",
        stored_score(F.col("score")).alias("relevance_score"),
        *[encode_list(F.col(m)).alias(m) for m in _MATCHES],
        now.alias("analyzed_at"),
    )
    count = fresh.agg(F.max("i")).scalar()
    outbox = announce(fresh, source, F.col("i"), count)
    undetailed = candidates.join(judged.filter("detail_ok").select(*keys), keys, "left_anti")
    late = [
        metrics.rejects(
            undetailed, source, "detail", F.lit("missing or empty detail"), F.col(keys[-1])
        ),
        metrics.rejects(
            judged.filter("passed"), source, "insert", reason, F.col("ats_job_id")
        ),
    ]
    flags = metrics.funnel(
        judged,
        ["company_id"],
        {
            "detailed": F.col("detail_ok"),
            "after_title": F.col("after_title"),
            "discarded": F.col("after_title") & ~F.col("passed"),
        },
    )
    parts = [
        pages.groupBy("company_id").agg(F.count(F.lit(1)).alias("pages")),
        candidates.groupBy("company_id").agg(F.count(F.lit(1)).alias("candidates")),
        flags,
        fresh.groupBy("company_id").agg(F.count(F.lit(1)).alias("saved")),
    ]
    names = ["pages", "candidates", "detailed", "after_title", "saved", "discarded"]
    counted = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    funnel = counted.groupBy(F.lit(source).alias("source"), "company_id").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    )
    return IngestResult(
        jobs=new_jobs,
        analysis=new_analysis,
        outbox=outbox,
        rejects=reduce(DataFrame.unionByName, [*early_rejects, *late]),
        funnel=funnel,
    )


def announce(fresh: DataFrame, source: str, index: Column, total: Column) -> DataFrame:
    """One outbox row per inserted posting."""
    c = F.col
    return fresh.withColumn("_n", total).select(
        index.alias("seq"),
        F.lit("new").alias("kind"),
        "job_id",
        messages.job_message(
            c("company"), c("title"), c("location"), c("positive_matches"), c("application_link"),
            F.lit(source), index, c("_n"),
        ).alias("text"),
        messages.keyboard(c("job_id")).alias("keyboard"),
        F.lit(None).cast("bigint").alias("reply_to"),
    )


_SERIES = ["company_id", "run_id"]


def ingest_pages(
    pages: DataFrame,
    details: DataFrame,
    companies: DataFrame,
    jobs: DataFrame,
    analysis: DataFrame,
    now: Column,
    rules: RuleSet = RuleSet(),
    overrides: DataFrame | None = None,
    source: str = fixed.SOURCE_A,
    held: DataFrame | None = None,
    hold_batches: int = 0,
    collation: str | None = None,
    reported: DataFrame | None = None,
) -> IngestResult:
    """A run over a paged source. `companies` has id, name and url.

    Pages of one company and run are a series. It is read up to its stop, filtered by
    recency and place, cut to the first row per path, joined to details, then judged by
    title and score. Every landed page is read, lies after a stop of its series, is
    rejected with a reason, or is held.

    A series whose next page is missing may still be landing. With `hold_batches` it is
    handed back in `held` for that many batches, to be given again as `held`; after
    that, or without it, it is read up to the gap and the pages beyond are rejected.

    Lines of landed files that cannot be read are rejected as they are. Details are read
    again by later runs: `reported` are the rejects written so far, and lines of files
    that are among them are not rejected again.
    """
    links = companies.select(
        F.col("id").alias("company_id"),
        F.col("name").alias("company"),
        F.col("url").alias("company_url"),
        urls.page_endpoints(F.col("url"))["org"].isNotNull().alias("_usable"),
    )
    landed = pages.select(*_as_columns(pages, _with_line(schemas.PAGES)), F.lit(0).alias("held"))
    if held is not None:
        landed = landed.unionByName(held, allowMissingColumns=True)
    landed = landed.withColumn("run_id", F.coalesce("run_id", F.lit("")))
    if hold_batches:
        landed = stage(landed, "landed")
    usable = links.filter("_usable").select("company_id")
    parsed, lines = _split_lines(_parsed_once(parse_pages(landed), "bad"))
    details, detail_lines = _detail_lines(details)
    ends = series_ends(parsed, _SERIES, "page_no", F.col("size"), F.col("limit"), F.col("bad"), rules.max_pages)
    ends = ends.withColumnRenamed("last", "_last").withColumn("_open", F.lit(False))
    still = None
    if hold_batches:
        waited = parsed.groupBy(*_SERIES).agg(F.max("held").alias("_waited"))
        open_ = (F.col("stop") == "missing") & (F.col("_waited") < hold_batches)
        ends = ends.join(waited, _SERIES).withColumn("_open", open_)
    ends = stage(ends, "series")
    if hold_batches:
        waiting = ends.filter("_open").select(*_SERIES)
        whole = whole_lines(landed).select(*schemas.HELD_PAGES.names)
        still = many_to_one(whole, waiting, _SERIES, "left_semi").withColumn("held", F.col("held") + 1)
        still = stage(still, "held")
    closed = ends.filter("not _open").select(*_SERIES, "_last", "stop")
    judged_pages = many_to_one(parsed, closed, _SERIES)
    mine = many_to_one(judged_pages, usable, ["company_id"], "left_semi")
    number = F.col("page_no")
    read = mine.filter((number >= 0) & (number <= F.col("_last")))
    candidates = explode_postings(read).filter(
        recent_text(F.col("posted_on"))
        & contains_any(F.col("locations_text"), rules.locations)
        & (F.coalesce(F.col("external_path"), F.lit("")) != "")
    )
    keys = ["company_id", "external_path"]
    place = ["landed_at", "run_id", "page_no", "pos"]
    once = stage(first_per_key(candidates, keys, place).drop("landed_at"), "candidates")
    detailed = records.normalize_a(join_details(once, details, keys, _detail_order(details)))
    detailed = many_to_one(detailed, links.drop("_usable"), ["company_id"])
    detailed = detailed.withColumn(
        "application_link", urls.application_link(F.col("company_url"), F.col("external_path"))
    ).withColumn(
        "after_title",
        F.col("detail_ok") & title_ok(F.col("title"), rules.title_include, rules.title_exclude),
    )
    judged = _judge(detailed, ["external_path", "run_id", "page_no", "pos"], rules, overrides)
    body = F.col("body")
    first_capped = (F.col("stop") == "cap") & (number == F.col("_last"))
    known = many_to_one(judged_pages, links.select("company_id", F.lit(True).alias("_known")), ["company_id"], "left")
    early = [
        metrics.rejects(
            links.filter(~F.col("_usable")), source, "company",
            F.lit("no path segment in url"), F.col("company_url"),
        ),
        metrics.rejects(
            known, source, "page",
            F.when(F.col("_known").isNull(), "unknown company")
            .when(number.isNull() | (number < 0), "no page number")
            .when((F.col("stop") == "missing") & (number > F.col("_last")), "page before it missing")
            .when(first_capped, "page cap reached")
            .when(number >= rules.max_pages, None)
            .when(F.col("status_code").isNull() | (F.col("status_code") != 200), "not 200")
            .when(F.col("unreadable"), "unreadable body"),
            body,
        ),
        metrics.rejects(parsed, source, "page", F.when(F.col("company_id").isNull(), "no company"), body),
        metrics.rejects(
            judged.filter("detail_ok"), source, "title",
            F.when(F.col("title").isNull(), "null title"), F.col("external_path"),
        ),
        metrics.line_rejects(lines, source, "page"),
        *_detail_rejects(detail_lines, source, reported),
    ]
    order = ["company_id", "run_id", "page_no", "pos"]
    result = _admit(once, judged, keys, order, source, jobs, analysis, now, read, early, collation)
    return replace(result, held=still)


def ingest_boards(
    boards: DataFrame,
    details: DataFrame,
    companies: DataFrame,
    jobs: DataFrame,
    analysis: DataFrame,
    now: Column,
    as_of: Column,
    rules: RuleSet = RuleSet(),
    overrides: DataFrame | None = None,
    source: str = fixed.SOURCE_B,
    collation: str | None = None,
    reported: DataFrame | None = None,
) -> IngestResult:
    """A run over boards: recency, title and place are judged before the detail join.

    Lines that cannot be read are rejected as in `ingest_pages`.
    """
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    rows = boards.select(*_as_columns(boards, _with_line(schemas.BOARDS)))
    landed, lines = _split_lines(_parsed_once(parse_boards(rows), "unreadable"))
    details, detail_lines = _detail_lines(details)
    parsed = many_to_one(landed, names.select("company_id"), ["company_id"], "left_semi")
    candidates = explode_board(parsed).filter(
        recent_ts(F.col("updated_at"), as_of, rules.fresh_hours)
        & title_ok(F.col("title"), rules.title_include, rules.title_exclude)
        & location_ok(F.col("location_name"), F.col("offices"), rules.locations)
    )
    keys = ["company_id", "job_id"]
    once = first_per_key(candidates.select(*keys, "pos"), keys, ["pos"])
    once = stage(once, "candidates")
    detailed = records.normalize_b(join_details(once, details, keys, _detail_order(details)))
    detailed = many_to_one(detailed, names, ["company_id"])
    detailed = detailed.withColumn("after_title", F.col("detail_ok"))
    judged = _judge(detailed, ["job_id", "pos"], rules, overrides)
    known = many_to_one(landed, names.select("company_id", F.lit(True).alias("_known")), ["company_id"], "left")
    early = [
        metrics.rejects(
            known, source, "board",
            F.when(F.col("_known").isNull(), "unknown company")
            .when(F.col("status_code").isNull(), "no answer")
            .when(~F.col("status_code").isin(200, 404), "not 200")
            .when((F.col("status_code") == 200) & F.col("unreadable"), "unreadable body"),
            F.col("body"),
        ),
        # Without a list title the rule cannot be applied; the row alone is rejected
        metrics.rejects(
            explode_board(parsed).filter(recent_ts(F.col("updated_at"), as_of, rules.fresh_hours)),
            source, "title", F.when(F.col("title").isNull(), "null title"), F.col("job_id"),
        ),
        metrics.line_rejects(lines, source, "board"),
        *_detail_rejects(detail_lines, source, reported),
    ]
    read = parsed.filter((F.col("status_code") == 200) & ~F.col("unreadable"))
    order = ["company_id", "pos", "job_id"]
    return _admit(
        once, judged, keys, order, source, jobs, analysis, now, read, early, collation, title_needed=False
    )


def _with_line(schema: StructType) -> StructType:
    return StructType([*schema.fields, *schemas.LINE.fields])


def _split_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of whole lines, and the broken lines; `parsed` is a written table."""
    return whole_lines(parsed), parsed.filter(F.col(BROKEN).isNotNull())


def _detail_lines(details: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    lines = broken_lines(details) if BROKEN in details.columns else None
    return whole_lines(details), lines


def _detail_rejects(lines: DataFrame | None, source: str, reported: DataFrame | None) -> list[DataFrame]:
    if lines is None:
        return []
    return [metrics.not_reported(metrics.line_rejects(lines, source, "detail"), reported)]


def _as_columns(df: DataFrame, schema: StructType) -> list[Column]:
    """The columns of `schema`, null where `df` lacks one."""
    have = set(df.columns)
    return [(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]


def _detail_order(details: DataFrame) -> list[Column]:
    """Among landed copies of one detail a usable one comes first, then the newest.

    Copies that landed together are told apart by a digest, so no body is a sort key.
    """
    age = -F.unix_micros("landed_at") if "landed_at" in details.columns else F.lit(0)
    unusable = F.coalesce(F.col("status_code"), F.lit(0)) != 200
    return [unusable, age.isNull(), age, F.md5("body")]


def combine(results: list[IngestResult]) -> IngestResult:
    """What several runs of one batch add, each run after the one before; messages are numbered on."""
    both = lambda name: reduce(DataFrame.unionByName, [getattr(r, name) for r in results])
    outboxes, sent = [], F.lit(0)
    for r in results:
        outboxes.append(r.outbox.withColumn("seq", F.col("seq") + sent))
        sent = sent + r.jobs.agg(F.count(F.lit(1))).scalar()
    return IngestResult(
        jobs=both("jobs"),
        analysis=both("analysis"),
        outbox=reduce(DataFrame.unionByName, outboxes),
        rejects=both("rejects"),
        funnel=both("funnel"),
        held=next((r.held for r in results if r.held is not None), None),
    )


def union_sources(**by_source: DataFrame) -> DataFrame:
    """Rows of all sources in one table with a `source` column."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in by_source.items()]
    return reduce(DataFrame.unionByName, tagged)
