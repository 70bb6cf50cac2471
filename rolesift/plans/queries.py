"""Named queries: every operator on whole tables, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift import rules as fixed
from rolesift import schemas
from rolesift.functions import html, lists, messages, predicates, urls
from rolesift.operators import decisions, learner, merge, metrics, numbering, ordered, pages, records, scoring
from rolesift.operators.joins import decided_with_analysis, job_by_id as job_by_id_, join_details, jobs_with_company
from rolesift.plans import fixtures as fx
from rolesift.plans.fixtures import table
from rolesift.plans.ingest import ingest_boards, ingest_pages, job_rejects, union_sources
from rolesift.plans.recalibrate import run_recalibration
from rolesift.session import fresh_path, stage
from rolesift.sources import landed, registry, tables
from rolesift.streaming.decisions import decision_stream
from rolesift.streaming.ingest import Feed, ingest_feeds, ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing `_` keeps an import's name free."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def _joined(name: str):
    return F.array_join(name, "|").alias(name)


_MATCHES = ("positive_matches", "negative_matches", "experience_matches")


def _plain_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("plain"))


# ---- Scoring ----


@query
def keyword_score(spark, d):
    scored = scoring.relevance(_plain_documents(spark, d), "plain", fx.DOC_RULES)
    kept = scoring.score_filter(scored, fx.DOC_RULES.threshold)
    return kept.select("doc_id", F.round("score", 4).alias("score"), *map(_joined, _MATCHES))


def _shipped_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", fx.shipped_text(c("doc_id"), c("text")).alias("plain"))


@query
def keyword_score_shipped(spark, d):
    """The shipped lists, weights and patterns on every document."""
    scored = scoring.relevance(_shipped_documents(spark, d), "plain", fx.SHIPPED)
    return scored.select("doc_id", F.round("score", 4).alias("score"), *map(_joined, _MATCHES))


@query
def patterns_shipped(spark, d):
    hits = scoring.pattern_hits(c("plain"), [p for p, _ in fx.SHIPPED.patterns])
    found = _shipped_documents(spark, d).select("doc_id", hits.alias("hits"))
    return found.select(
        "doc_id", F.array_join("hits", "|").alias("matches"),
        scoring.pattern_bonus(c("hits"), fx.SHIPPED.patterns).alias("bonus"),
    )


@query
def title_filter_shipped(spark, d):
    title = fx.shipped_title(c("p_partkey"), c("p_name"))
    good = predicates.title_ok(title, fx.SHIPPED.title_include, fx.SHIPPED.title_exclude)
    return table(spark, d, "part").filter(good).select("p_partkey", title.alias("title"))


@query
def keyword_matches_long(spark, d):
    scored = scoring.relevance(_plain_documents(spark, d), "plain", fx.DOC_RULES)
    both = F.concat("positive_matches", "negative_matches")
    return scored.select("doc_id", F.explode(both).alias("keyword"))


@query
def keyword_matches_table(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    keywords = table(spark, d, "benchmark").select(F.explode(words).alias("keyword"))
    keywords = keywords.filter(F.length("keyword") >= 6).distinct()
    found = scoring.match_keyword_table(_plain_documents(spark, d), "doc_id", "plain", keywords, 1)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("doc_sum"))


@query
def keyword_matches_phrases(spark, d):
    """Phrases of the benchmark items, of 1 to 6 words and with marks at their ends."""
    phrases = F.concat(*[F.regexp_extract_all(F.lower("text"), F.lit(p), 1) for p in fx.PHRASES])
    keywords = table(spark, d, "benchmark").select(F.explode(phrases).alias("keyword"))
    found = scoring.match_keyword_phrases(_plain_documents(spark, d), "doc_id", "plain", keywords)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("doc_sum"))


@query
def pattern_first_match(spark, d):
    patterns = [p for p, _ in fx.DOC_RULES.patterns]
    found = _plain_documents(spark, d).select(
        "doc_id", scoring.pattern_hits(c("plain"), patterns).alias("hits")
    )
    return found.select(
        "doc_id",
        F.array_join("hits", "|").alias("matches"),
        scoring.pattern_bonus(c("hits"), fx.DOC_RULES.patterns).alias("bonus"),
    )


@query
def stored_score(spark, d):
    scored = scoring.relevance(_plain_documents(spark, d), "plain", fx.DOC_RULES)
    return scored.groupBy(
        scoring.stored_score(c("score") * 1.25).alias("relevance_score")
    ).agg(F.count(F.lit(1)).alias("docs"))


def _decided_documents(spark, d) -> DataFrame:
    """Labelled documents as decided jobs, their match lists stored as JSON first."""
    labels = table(spark, d, "labels").select(
        "doc_id", F.when(c("toxic") == 1, "applied").otherwise("rejected").alias("user_decision")
    )
    text = _plain_documents(spark, d).join(labels, "doc_id")
    scored = scoring.relevance(text, "plain", fx.LEARN_RULES)
    stored = scored.select(
        "doc_id",
        "user_decision",
        *[lists.encode_list(c(m)).alias(m) for m in _MATCHES[:2]],
    )
    return stage(stored, "decided")


def _learned(spark, d) -> DataFrame:
    return learner.keyword_lift(learner.decode_matches(_decided_documents(spark, d)))


@query
def decision_totals(spark, d):
    return learner.decision_totals(_decided_documents(spark, d))


@query
def keyword_counts(spark, d):
    return learner.keyword_counts(learner.decode_matches(_decided_documents(spark, d)))


@query
def keyword_lift(spark, d):
    return _learned(spark, d).select(
        "keyword", "accept_count", "reject_count", "sample_count",
        F.round("lift", 4).alias("lift"), F.round("multiplier", 4).alias("multiplier"),
    )


@query
def effective_weights(spark, d):
    weights = scoring.effective_weights(
        scoring.keyword_table(spark, fx.LEARN_RULES), _learned(spark, d)
    )
    return weights.select("ordinal", "polarity", "keyword", "weight", F.round("multiplier", 4).alias("multiplier"))


@query
def keyword_score_weighted(spark, d):
    scored = scoring.relevance(
        _plain_documents(spark, d), "plain", fx.LEARN_RULES, _learned(spark, d)
    )
    return scored.filter("score > 0").select("doc_id", F.round("score", 4).alias("score"))


@query
def recalibrate(spark, d):
    """Overrides already hold every keyword; those learned again are replaced."""
    decided = learner.decode_matches(_decided_documents(spark, d))
    old = learner.keyword_counts(decided).select(
        F.concat(c("keyword"), F.when(c("accept_count") > 10, "").otherwise("-old")).alias("keyword"),
        F.lit(9.0).cast("float").alias("multiplier"),
        *[F.lit(0).alias(n) for n in ("accept_count", "reject_count", "sample_count")],
        F.lit(1.0).cast("float").alias("lift"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    now = F.to_timestamp(F.lit(fx.DECIDED_ON))
    new, _ = learner.recalibrate(decided, old, now)
    return new.select(
        "keyword", F.round(c("multiplier").cast("double"), 4).alias("multiplier"),
        c("accept_count").cast("bigint").alias("accept_count"),
        c("sample_count").cast("bigint").alias("sample_count"),
        F.round(c("lift").cast("double"), 4).alias("lift"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"),
    )


@query
def recalibrate_incremental(spark, d):
    """Decisions in three batches with a recalibration after each one."""
    root = fresh_path(spark, "learning")
    decided = _decided_documents(spark, d)
    analysis = decided.withColumn("job_id", c("doc_id")).withColumn("id", c("doc_id"))
    lists = [c(n).cast(t).alias(n) if n in analysis.columns else F.lit(None).cast(t).alias(n)
             for n, t in ((f.name, f.dataType) for f in schemas.JOB_ANALYSIS.fields)]
    tables.append_batch(analysis.select(*lists), root, "job_analysis", "feed", 0)
    for batch in range(3):
        some = decided.filter(F.pmod(F.hash("doc_id"), F.lit(3)) == batch)
        tables.append_batch(some.select(c("doc_id").alias("job_id"), c("user_decision").alias("decision")), root, "decisions", "events", batch)
        run_recalibration(spark, root, batch + 1, F.to_timestamp(F.lit(fx.DECIDED_ON)))
    return tables.read_overrides(spark, root).select(
        "keyword", F.round(c("multiplier").cast("double"), 4).alias("multiplier"),
        *[c(n).cast("bigint").alias(n) for n in ("accept_count", "reject_count", "sample_count")],
        F.round(c("lift").cast("double"), 4).alias("lift"),
    )


@query
def overrides_scan(spark, d):
    """The learned multipliers, written as two versions and read back: the newest counts."""
    root = fresh_path(spark, "overrides")
    learned = _learned(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    fitted = learned.select(*[c(f.name).cast(f.dataType) for f in schemas.OVERRIDES.fields])
    tables.write_overrides(fitted.withColumn("multiplier", F.lit(9.0).cast("float")), root, 1)
    tables.write_overrides(fitted, root, 2)
    rows = tables.read_overrides(spark, root)
    return rows.select("keyword", F.round(c("multiplier").cast("double"), 4).alias("multiplier"))


# ---- HTML ----


@query
def html_text(spark, d):
    text = html.strip_html(fx.hard_markup(c("html")))
    return table(spark, d, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("chars"))


@query
def html_lines(spark, d):
    text = html.html_text(fx.hard_markup(c("html")))
    return table(spark, d, "pages").select("page_id", F.md5(text).alias("text_md5"))


@query
def double_strip(spark, d):
    text = html.strip_html(html.html_text(fx.hard_markup(c("html"))))
    return table(spark, d, "pages").select("page_id", F.md5(text).alias("text_md5"))


# ---- URLs ----


@query
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_parts(c("url")).alias("u")).select("page_id", "u.*")


@query
def url_endpoints(spark, d):
    pages_ = table(spark, d, "pages").select(
        "page_id",
        urls.page_endpoints(c("url")).alias("e"),
        F.array_join(urls.clean_segments(urls.url_parts(c("url"))["path"]), "|").alias("segments"),
    )
    return pages_.select("page_id", "segments", "e.*")


@query
def url_slug(spark, d):
    boards = F.replace(c("url"), F.lit("/en/"), F.lit("/v1/boards/"))
    return table(spark, d, "pages").select("page_id", urls.board_slug(boards).alias("slug"))


@query
def url_link(spark, d):
    path = F.concat(F.lit("/job/"), c("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", urls.application_link(c("url"), path).alias("link"))


@query
def search_url(spark, d):
    name = F.concat("s_name", F.lit(" & Söhne/"), "n_name")
    joined = table(spark, d, "supplier").join(
        F.broadcast(table(spark, d, "nation")), c("s_nationkey") == c("n_nationkey")
    )
    return joined.select("s_suppkey", urls.search_url(name).alias("url"))


# ---- Predicates ----


@query
def title_filter(spark, d):
    title = F.concat_ws(" ", "p_name", "p_type")
    include, exclude = ("ring", "gizmo", "bolt"), ("promo", "old", "red r")
    return table(spark, d, "part").filter(predicates.title_ok(title, include, exclude)).select(
        "p_partkey", title.alias("title")
    )


@query
def contains_any(spark, d):
    hit = predicates.contains_any(c("text"), ("être", "license", "ation the"))
    return table(spark, d, "documents").select("doc_id", hit.alias("hit"))


@query
def recent_text(spark, d):
    posted = F.concat(F.lit("Posted "), c("o_orderpriority"), F.lit(" Days Ago"))
    return table(spark, d, "orders").filter(predicates.recent_text(posted)).select("o_orderkey", "o_orderpriority")


@query
def recent_ts(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(c("event_type") == "click", iso).when(
        c("event_type") == "view", F.concat(iso, F.lit("-05:00"))
    ).otherwise(F.concat(iso, F.lit("Z")))
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00+00:00"))
    return table(spark, d, "events").filter(predicates.recent_ts(text, as_of, 24)).select("event_id", "event_type")


@query
def fresh_only(spark, d):
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00+00:00"))
    return table(spark, d, "events").filter(predicates.fresh_instant(c("ts"), as_of, 48)).select("event_id")


@query
def location_filter(spark, d):
    offices = F.transform(
        F.split("text", r"\. "), lambda s: F.struct(F.struct(s.alias("name")).alias("location"))
    )
    hit = predicates.location_ok(c("lang"), offices, ("de", "that the", "eaux."))
    return table(spark, d, "documents").filter(hit).select("doc_id", "lang")


@query
def width_check(spark, d):
    rows = table(spark, d, "documents").select("doc_id", c("text").alias("title"))
    return rows.select("doc_id", predicates.fits({"title": 500}).alias("fits"))


# ---- Ordered operators ----


@query
def first_per_key(spark, d):
    wanted = predicates.fresh_instant(c("ts"), F.to_timestamp(F.lit("2024-01-20 00:00:00+00:00")), 240)
    events = table(spark, d, "events").filter(wanted & predicates.contains_any(c("event_type"), ("e",)))
    first = ordered.first_per_key(events, ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id")


def _turns_as_pages(spark, d, max_pages: int):
    chars = F.length("text")
    landed_pages = table(spark, d, "conversations").select(
        "conv_id", fx.gapped("conv_id", "turn").alias("page"), "turn", "role", chars.alias("size"),
        (chars > 1400).alias("bad"), F.lit(100).alias("limit"),
    )
    read = pages.pages_until_stop(landed_pages, "conv_id", "page", max_pages=max_pages)
    return read.select("conv_id", "turn", "role")


@query
def pages_until_stop(spark, d):
    """Turns are pages; some series have a gap."""
    return _turns_as_pages(spark, d, 100)


@query
def pages_until_cap(spark, d):
    return _turns_as_pages(spark, d, 3)


@query
def explode_postings(spark, d):
    """Pages written as JSON files, read back with their schema, and exploded."""
    path = fresh_path(spark, "pages")
    fx.pages(table(spark, d, "conversations")).write.json(path)
    rows = pages.explode_postings(pages.parse_pages(landed.read_pages(spark, path)))
    return rows.select("company_id", "page_no", "pos", "external_path", "posted_on", F.md5("locations_text").alias("place_md5"))


@query
def explode_board(spark, d):
    path = fresh_path(spark, "boards")
    fx.boards(table(spark, d, "documents")).write.json(path)
    rows = pages.explode_board(pages.parse_boards(landed.read_boards(spark, path)))
    return rows.select(
        "company_id", "job_id", F.md5("title").alias("title_md5"), "updated_at", "location_name",
        c("offices")[0]["location"]["name"].alias("office"),
    )


@query
def assign_ids(spark, d):
    start = table(spark, d, "nation").agg(F.max("n_nationkey")).scalar()
    ids = numbering.assign_ids(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey", "s_suppkey"], start
    )
    return ids.select("id", "s_suppkey")


@query
def number_messages(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    return numbering.number_messages(rows, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "i", "n")


# ---- Joins and records ----


@query
def join_details_(spark, d):
    """Orders with their one detail, the first line of each."""
    details = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    joined = join_details(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), details, ["o_orderkey"], order)
    return joined.select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey", "l_suppkey")


@query
def decided_scan(spark, d):
    jobs = table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), F.nullif(c("o_orderstatus"), F.lit("O")).alias("user_decision")
    )
    analysis = ordered.first_per_key(
        table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    ).select(
        c("l_orderkey").alias("job_id"), c("l_returnflag").alias("positive_matches"),
        c("l_linestatus").alias("negative_matches"),
    )
    return decided_with_analysis(jobs, analysis)


@query
def jobs_with_company_(spark, d):
    companies = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("company_name"))
    jobs = table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("company_id"))
    return jobs_with_company(jobs, companies).select("o_orderkey", "company_id", "company")


@query
def normalize_a(spark, d):
    path = fresh_path(spark, "details")
    fx.page_details(table(spark, d, "conversations")).write.json(path)
    rows = records.normalize_a(landed.read_details(spark, path, fixed.SOURCE_A))
    return rows.filter("detail_ok").groupBy("ats_job_id", "location", "posted").agg(
        F.min(F.md5("description")).alias("text_md5"), F.count(F.lit(1)).alias("copies")
    )


@query
def normalize_b(spark, d):
    path = fresh_path(spark, "details")
    fx.board_details(table(spark, d, "documents")).write.json(path)
    rows = records.normalize_b(landed.read_details(spark, path, fixed.SOURCE_B))
    return rows.filter("detail_ok").select(
        "job_id", "ats_job_id", "location", "posted", "application_link", F.md5("description").alias("text_md5")
    )


# ---- Merges ----


def _orders_as_jobs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        c("o_custkey").alias("company_id"),
        F.concat_ws("/", c("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")).alias("ats_job_id"),
        c("o_orderkey").alias("line"),
        c("o_orderstatus").alias("status"),
    )


def _existing_jobs(spark, d) -> DataFrame:
    finished = ordered.first_per_key(_orders_as_jobs(spark, d).filter("status = 'F'"), ["ats_job_id"], ["line"])
    return numbering.assign_ids(finished, ["line"]).select("id", "company_id", "ats_job_id", "line")


@query
def insert_new(spark, d):
    inserted, _ = merge.insert_new(_existing_jobs(spark, d), _orders_as_jobs(spark, d), ["ats_job_id"], ["line"])
    return inserted


@query
def insert_new_target(spark, d):
    _, target = merge.insert_new(_existing_jobs(spark, d), _orders_as_jobs(spark, d), ["ats_job_id"], ["line"])
    return target.groupBy("company_id").agg(F.count(F.lit(1)).alias("jobs"), F.max("id").alias("last_id"))


@query
def insert_new_nocase(spark, d):
    """Keys compared without case: the target holds them upper, the batch as is."""
    parts = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), "p_partkey")
    held = parts.filter("name like 'red%'").select(F.upper("name").alias("name"), "p_partkey")
    held = ordered.first_per_key(held, ["name"], ["p_partkey"])
    inserted, _ = merge.insert_new(held, parts, ["name"], ["p_partkey"], id_col=None, collation="UTF8_LCASE")
    return inserted


@query
def upsert(spark, d):
    """Statistics by part: those of returned lines replace those of the others."""
    def stats(flag):
        rows = table(spark, d, "lineitem").filter(flag)
        return rows.groupBy("l_partkey").agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity")
        )

    returned = stats(c("l_returnflag") == "R").filter("lines >= 3")
    return merge.upsert(stats(c("l_returnflag") == "A"), returned, ["l_partkey"], ["lines", "quantity"])


def _order_decisions(spark, d) -> tuple[DataFrame, DataFrame]:
    jobs = table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), F.nullif(c("o_orderstatus"), F.lit("P")).alias("user_decision")
    )
    events = table(spark, d, "events").filter(c("event_type").isin("purchase", "error"))
    new = ordered.first_per_key(events, ["user_id"], ["ts", "event_id"]).select(
        c("user_id").alias("job_id"), c("event_type").alias("decision")
    )
    return jobs, new


@query
def update_by_id(spark, d):
    return merge.apply_decisions(*_order_decisions(spark, d))


@query
def update_matched(spark, d):
    """Which of the decisions meet a job."""
    return merge.decisions_matched(*_order_decisions(spark, d))


@query
def job_by_id(spark, d):
    jobs, companies = fx.supplier_jobs(table(spark, d, "supplier")), fx.nation_companies(table(spark, d, "nation"))
    return job_by_id_(jobs, companies, 7).select("id", "company_id", "company", "title", "location", "application_link")


def _deleted(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return merge.delete_where(
        orders.select("o_orderkey", "o_orderpriority"), c("o_orderpriority").like("1-%"), "o_orderkey",
        {"lineitem": (lines, "l_orderkey")},
    )


@query
def delete_cascade(spark, d):
    return _deleted(spark, d)[1]


@query
def delete_cascade_kept(spark, d):
    left = _deleted(spark, d)[0]
    return left["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query
def json_list_roundtrip(spark, d):
    """Match lists through stored JSON and back; every third form is not a list."""
    scored = scoring.relevance(_plain_documents(spark, d), "plain", fx.DOC_RULES)
    text = (
        F.when(c("score") == 0, "not json")
        .when(c("score") < 3, F.to_json(F.struct("score")))
        .otherwise(lists.encode_list(c("positive_matches")))
    )
    stored = scored.select("doc_id", text.alias("stored"), lists.encode_list(c("negative_matches")).alias("neg"))
    both = F.concat(lists.decode_list(c("stored")), lists.decode_list(c("neg")))
    return stored.select("doc_id", F.array_join(both, "|").alias("keywords"))


# ---- Decisions ----

_ARRIVAL = ["received_at", "callback_id"]


def _parsed(spark, d):
    return decisions.parse_decision(fx.decision_events(table(spark, d, "events")))


@query
def parse_decision(spark, d):
    return _parsed(spark, d).select(
        c("callback_id").cast("bigint").alias("event_id"), "verdict", "job_id",
        decisions.decision_label(c("verb")).alias("label"),
    )


def _verdicts(spark, d):
    known = fx.supplier_jobs(table(spark, d, "supplier")).select(
        c("id").alias("job_id"), F.when(c("company_id") < 3, "applied").alias("decision")
    )
    # Written once, as the stream does: the events are read three times
    return decisions.decide(stage(_parsed(spark, d), "events"), known, _ARRIVAL)


@query
def first_decision(spark, d):
    return _verdicts(spark, d).select(c("callback_id").cast("bigint").alias("event_id"), "job_id", "verdict")


def _effects(spark, d):
    jobs = jobs_with_company(fx.supplier_jobs(table(spark, d, "supplier")), fx.nation_companies(table(spark, d, "nation")))
    new = decisions.new_decisions(_verdicts(spark, d))
    return decisions.decision_effects(new, jobs, F.to_timestamp(F.lit(fx.DECIDED_ON)))


@query
def decision_outbox(spark, d):
    """Messages of the decisions, through the outbox table."""
    root = fresh_path(spark, "state")
    tables.write_outbox(_effects(spark, d)[0], root, "decisions", 0)
    rows = tables.read_table(spark, root, "outbox", schemas.OUTBOX)
    return rows.select("kind", "job_id", "text", "reply_to")


@query
def decision_applications(spark, d):
    status = spark.createDataFrame([], schemas.APPLICATION_STATUS)
    inserted, _ = merge.insert_new(status, _effects(spark, d)[1], ["job_id"], ["job_id"])
    return inserted.select("id", "company_id", "job_id", "applied_on", "status")


@query
def decision_answers(spark, d):
    """What the sender of each callback is told."""
    rows = decisions.callback_answers(_verdicts(spark, d))
    return rows.select(c("keyboard").cast("bigint").alias("event_id"), "kind", "text")


_FILE_ROWS = 50_000


def _land_in_order(df: DataFrame, order: Column, path: str, parts: int) -> int:
    """Land rows in `parts` parts, one after the other in `order`; the files of each part.

    A stream that reads so many files at a time reads one part as a batch.
    """
    placed = stage(df.withColumn("_part", order), "landing")
    files = 1 + placed.count() // (parts * _FILE_ROWS)
    for part in range(parts):
        rows = placed.filter(c("_part") == part).drop("_part", "_batch")
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").json(path)
    return files


def _again_after(root: str, name: str, start: Callable) -> None:
    """Run a stream that is lost in its second batch before a table is written, and restart it."""
    with tables.interrupted_before(root, name, 1):
        try:
            start().awaitTermination()
        except StreamingQueryException as e:
            if "Interrupted" not in str(e):
                raise
    start().awaitTermination()


def _decision_run(spark, d, lost_before: str | None = None) -> str:
    """The stream over events landed in three files, a batch each; some jobs are decided before."""
    root, events = fresh_path(spark, "state"), fresh_path(spark, "events")
    rows = table(spark, d, "events")
    micros = lambda name: F.unix_micros(c(name).cast("timestamp"))
    first, second = rows.select(F.percentile(micros("ts"), F.array(F.lit(0.3), F.lit(0.6)))).first()[0]
    at = micros("received_at")
    third = F.when(at <= first, 0).when(at <= second, 1).otherwise(2)
    files = _land_in_order(fx.decision_events(rows), third, events, 3)
    jobs = fx.supplier_jobs(table(spark, d, "supplier"))
    tables.append_batch(jobs, root, "job_info", "seed", 0)
    before = jobs.filter("company_id < 3").select(c("id").alias("job_id"), F.lit("applied").alias("decision"))
    tables.append_batch(before, root, "decisions", "seed", 0)
    companies = fx.nation_companies(table(spark, d, "nation"))
    offsets = fresh_path(spark, "offsets")

    def start():
        return decision_stream(spark, events, companies, root, offsets, as_of=fx.DECIDED_ON, max_files=files)

    if lost_before:
        _again_after(root, lost_before, start)
    else:
        start().awaitTermination()
    return root


def _stored_verdicts(spark, root) -> DataFrame:
    rows = tables.read_table(spark, root, "verdicts", schemas.VERDICTS)
    return rows.select(c("callback_id").cast("bigint").alias("event_id"), "job_id", "verdict")


@query
def decision_stream_verdicts(spark, d):
    return _stored_verdicts(spark, _decision_run(spark, d))


@query
def decision_replay(spark, d):
    """The stream lost after its outbox is written and before its decisions are: each answered once."""
    root = _decision_run(spark, d, lost_before="decisions")
    outbox = tables.read_table(spark, root, "outbox", schemas.OUTBOX).filter("kind = 'answer'")
    answers = outbox.groupBy(c("keyboard").cast("bigint").alias("event_id")).agg(F.count(F.lit(1)).alias("answers"))
    rows = _stored_verdicts(spark, root).join(answers, "event_id", "left")
    return rows.select("event_id", "job_id", "verdict", F.coalesce("answers", F.lit(0)).alias("answers"))


# ---- Messages ----


@query
def job_message(spark, d):
    jobs = jobs_with_company(fx.supplier_jobs(table(spark, d, "supplier")), fx.nation_companies(table(spark, d, "nation")))
    words = F.when(c("id") % 2 == 0, F.split("title", " ")).otherwise(F.array().cast("array<string>"))
    rows = numbering.number_messages(jobs.withColumn("words", words), ["id"], ["company_id"])
    text = messages.job_message(
        c("company"), c("title"), F.nullif(c("location"), F.lit("Site 3")), c("words"), c("application_link"), F.lit("feed"), c("i"), c("n")
    )
    return rows.select("id", text.alias("message"), messages.keyboard(c("id")).alias("keyboard"))


@query
def decided_message(spark, d):
    jobs = jobs_with_company(fx.supplier_jobs(table(spark, d, "supplier")), fx.nation_companies(table(spark, d, "nation")))
    decision = F.when(c("company_id") < 12, "applied").otherwise("rejected")
    text = messages.decided_message(
        c("company"), c("title"), c("location"), c("application_link"), decision, urls.search_url(c("company"))
    )
    return jobs.select("id", text.alias("message"))


@query
def fill_template(spark, d):
    title = F.when(c("p_size") < 10, F.concat(c("p_name"), F.lit(" <<Company>>"))).otherwise(c("p_name"))
    template = "Re: <<TITLE>>\n---\n  at <<Company>> \n---\n \n---\n<<JOB-ID>>"
    text = messages.fill_template(title, c("p_brand"), c("p_partkey").cast("string"), template)
    return table(spark, d, "part").select("p_partkey", text.alias("note"))


# ---- Counts, registry, sources ----


@query
def funnel(spark, d):
    return metrics.funnel(
        table(spark, d, "documents"), ["source"],
        {
            "pages": F.lit(True),
            "candidates": c("lang") == "en",
            "detailed": (c("lang") == "en") & (c("n_chars") > 500),
            "saved": (c("lang") == "en") & (c("n_chars") > 500) & c("text").contains("with"),
        },
    )


def _two_sources(spark, d) -> DataFrame:
    return union_sources(
        workday=table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")),
        greenhouse=table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name")),
    )


@query
def union_sources_(spark, d):
    return _two_sources(spark, d)


@query
def run_summary(spark, d):
    return metrics.run_summary(_two_sources(spark, d))


@query
def run_csv(spark, d):
    path = tables.write_run_csv(_two_sources(spark, d), fresh_path(spark, "runs"), "feed", "20240201_000000")
    return spark.read.schema("id BIGINT, name STRING, source STRING").csv(path, header=True)


def _customer_csv(spark, d) -> str:
    """Customers as a company CSV of several files: two segments have links, one of each source."""
    path = fresh_path(spark, "companies")
    link = F.concat(F.lit(" https://x.example.com/"), c("c_custkey").cast("string"), F.lit(" "))
    column = dict(fixed.LINK_COLUMNS)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customers = table(spark, d, "customer").repartitionByRange(files, "c_custkey").sortWithinPartitions("c_custkey")
    customers.select(
        F.concat(F.lit(" Company "), (c("c_custkey") / 2).cast("bigint").cast("string"), F.lit(" ")).alias(fixed.NAME_COLUMN),
        F.when(c("c_mktsegment") == "BUILDING", link).alias(column[fixed.SOURCE_A]),
        F.when(c("c_mktsegment") == "MACHINERY", link).alias(column[fixed.SOURCE_B]),
    ).write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


@query
def registry_csv(spark, d):
    return registry.read_registry(spark, _customer_csv(spark, d), dict(fixed.LINK_COLUMNS)[fixed.SOURCE_A])


@query
def registry_build(spark, d):
    rows = registry.scan_csv(spark, _customer_csv(spark, d))
    built = registry.build_registry(rows)
    return built.select("id", "company_name", "ats", "ats_link")


@query
def registry_for(spark, d):
    rows = table(spark, d, "customer").select(
        c("c_custkey").alias("id"), c("c_name").alias("company_name"), c("c_mktsegment").alias("ats"),
        F.when(c("c_acctbal") > 5000, "").when(c("c_acctbal") > 0, F.concat(F.lit("https://x/"), c("c_name"))).alias("ats_link"),
    )
    return registry.companies_for(rows, "BUILDING")


@query
def company_id(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("company_name"))
    return registry.company_id(rows, "Customer#000000042")


@query
def rejects(spark, d):
    rows = table(spark, d, "documents").select(
        F.substring_index("source", "src", -1).cast("int").alias("company_id"),
        F.when(c("lang") != "de", c("doc_id").cast("string")).alias("ats_job_id"),
        F.when(c("lang") != "fr", c("text")).alias("title"),
        F.repeat(c("lang"), (c("n_chars") / 4).cast("int")).alias("location"),
        F.lit("").alias("application_link"),
    )
    return metrics.rejects(rows, "feed", "insert", job_rejects(), c("ats_job_id")).drop("file")


# ---- Whole runs ----


def _now():
    return F.to_timestamp(F.lit(fx.BOARD_AS_OF))


def _run_boards(spark, d):
    docs = table(spark, d, "documents")
    return ingest_boards(
        fx.boards(docs), fx.board_details(docs), fx.board_companies(docs),
        spark.createDataFrame([], schemas.JOB_INFO), spark.createDataFrame([], schemas.JOB_ANALYSIS),
        _now(), _now(), fx.BOARD_RULES,
    )


def _job_rows(jobs: DataFrame, analysis: DataFrame) -> DataFrame:
    return jobs.join(analysis.drop("id").withColumnRenamed("job_id", "id"), "id").select(
        "id", "company_id", "ats_job_id", F.md5("title").alias("title_md5"), "location", "application_link",
        "relevance_score", *_MATCHES,
    )


@query
def ingest_boards_jobs(spark, d):
    run = _run_boards(spark, d)
    return _job_rows(run.jobs, run.analysis)


@query
def ingest_boards_outbox(spark, d):
    return _run_boards(spark, d).outbox.select("seq", "job_id", F.md5("text").alias("text_md5"), "keyboard")


@query
def ingest_boards_rejects(spark, d):
    return _run_boards(spark, d).rejects.groupBy("company_id", "stage", "reason").agg(F.count(F.lit(1)).alias("rows"))


def _held_jobs(spark, d) -> DataFrame:
    talks = table(spark, d, "conversations")
    held = fx.page_details(talks).select(F.substring_index("external_path", "/", -1).alias("ats_job_id"))
    held = numbering.assign_ids(held.filter("ats_job_id like 'a%'").distinct(), ["ats_job_id"])
    return held.select(
        *[(c(f.name) if f.name in held.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.JOB_INFO.fields]
    )


def _run_pages(spark, d, rules=fx.PAGE_RULES, known="true"):
    talks = table(spark, d, "conversations")
    return ingest_pages(
        fx.pages(talks), fx.page_details(talks), fx.page_companies(talks).filter(known), _held_jobs(spark, d),
        spark.createDataFrame([], schemas.JOB_ANALYSIS), _now(), rules,
    )


@query
def ingest_pages_jobs(spark, d):
    run = _run_pages(spark, d)
    return _job_rows(run.jobs, run.analysis)


@query
def ingest_pages_funnel(spark, d):
    return _run_pages(spark, d).funnel


@query
def ingest_stream_jobs(spark, d):
    """The board run as a stream over landed files."""
    docs, root = table(spark, d, "documents"), fresh_path(spark, "state")
    lists_path, details_path = fresh_path(spark, "boards"), fresh_path(spark, "details")
    fx.boards(docs).write.json(lists_path)
    fx.board_details(docs).write.json(details_path)
    run = ingest_stream(
        spark, lists_path, details_path, fx.board_companies(docs), root, fresh_path(spark, "offsets"),
        fixed.SOURCE_B, fx.BOARD_RULES, as_of=fx.BOARD_AS_OF,
    )
    run.awaitTermination()
    jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO)
    return _job_rows(jobs, tables.read_table(spark, root, "job_analysis", schemas.JOB_ANALYSIS))


@query
def ingest_pages_rejects(spark, d):
    """A run that reaches its page cap and does not know every company."""
    run = _run_pages(spark, d, replace(fx.PAGE_RULES, max_pages=3), "id % 7 <> 3")
    return run.rejects.groupBy("company_id", "stage", "reason").agg(F.count(F.lit(1)).alias("rows"))


def _pages_run(spark, d, lost_before: str | None = None) -> DataFrame:
    """The paged run as a stream: each series comes in three batches, some pages twice.

    A third of the series have no page that ends them; they are closed at the end.
    """
    talks, root = table(spark, d, "conversations"), fresh_path(spark, "state")
    lists_path, details_path = fresh_path(spark, "pages"), fresh_path(spark, "details")
    landed_pages = fx.pages(talks)
    last = landed_pages.groupBy("company_id").agg(F.max("page_no").alias("page_no"))
    end = last.filter("company_id % 3 <> 0").select(
        "company_id", (c("page_no") + 1).alias("page_no"), F.lit(0).alias("offset"), F.lit(fx.PAGE_LIMIT).alias("limit"),
        F.lit(200).alias("status_code"), F.lit('{"jobPostings":[]}').alias("body"),
    )
    batch = F.least(F.floor(c("page_no") / 2), F.lit(2)).cast("int")
    again = landed_pages.filter("page_no = 1").withColumn("_batch", F.lit(2))
    whole = landed_pages.withColumn("_batch", batch).unionByName(end.withColumn("_batch", F.lit(2))).unionByName(again)
    files = _land_in_order(whole, c("_batch"), lists_path, 3)
    fx.page_details(talks).write.json(details_path)
    tables.append_batch(_held_jobs(spark, d), root, "job_info", "seed", 0)
    offsets = fresh_path(spark, "offsets")

    def start():
        return ingest_stream(
            spark, lists_path, details_path, fx.page_companies(talks), root, offsets, fixed.SOURCE_A, fx.PAGE_RULES,
            as_of=fx.BOARD_AS_OF, hold_batches=3, max_files=files, close_at_end=True,
        )

    if lost_before:
        _again_after(root, lost_before, start)
    else:
        start().awaitTermination()
    jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO).filter("title is not null")
    scores = tables.read_table(spark, root, "job_analysis", schemas.JOB_ANALYSIS).select(c("job_id").alias("id"), "relevance_score")
    return jobs.join(scores, "id").select("ats_job_id", F.md5("title").alias("title_md5"), "location", "relevance_score")


@query
def ingest_pages_stream_jobs(spark, d):
    return _pages_run(spark, d)


@query
def ingest_replay(spark, d):
    """The paged stream lost after its messages and scores are written and before its jobs are."""
    return _pages_run(spark, d, lost_before="job_info")


@query
def ingest_both_stream_jobs(spark, d):
    """Both sources as one stream of three batches; boards list postings that pages list too."""
    talks, root = table(spark, d, "conversations"), fresh_path(spark, "state")
    third = (c("conv_id") % 3).cast("int")
    feeds, files = [], 1
    for source, lists, details, companies, rules in (
        (fixed.SOURCE_A, fx.pages, fx.page_details, fx.page_companies, fx.PAGE_RULES),
        (fixed.SOURCE_B, fx.turn_boards, fx.turn_details, fx.turn_companies, fx.BOARD_RULES),
    ):
        lists_path, details_path = fresh_path(spark, "lists"), fresh_path(spark, "details")
        placed = [lists(talks.filter(third == k)).withColumn("_batch", F.lit(k)) for k in range(3)]
        files = _land_in_order(reduce(DataFrame.unionByName, placed), c("_batch"), lists_path, 3)
        details(talks).write.json(details_path)
        feeds.append(Feed(source, lists_path, details_path, companies(talks), rules))
    run = ingest_feeds(
        spark, feeds, root, fresh_path(spark, "offsets"), as_of=fx.BOARD_AS_OF, hold_batches=0, max_files=files
    )
    run.awaitTermination()
    jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO)
    scores = tables.read_table(spark, root, "job_analysis", schemas.JOB_ANALYSIS).select(c("job_id").alias("id"), "relevance_score")
    return jobs.join(scores, "id").select("id", "company_id", "ats_job_id", F.md5("title").alias("title_md5"), "relevance_score")


@query
def landed_line_rejects(spark, d):
    """Landed files of all four kinds, in which each row has a line that is cut off beside its whole one.

    Pages have lines too whose company is no number.
    """
    talks, docs, events = (table(spark, d, t) for t in ("conversations", "documents", "events"))
    number = lambda name: c(name).cast("string")

    def cut(rows, head, ident, field, text):
        return rows.select(fx.cut_line(F.concat(F.lit(head), number(ident), F.lit(field)), c(text)).alias("value"))

    odd = talks.select(F.concat(F.lit('{"company_id":"c'), number("conv_id"), F.lit('","page_no":'), number("turn"), F.lit("}")))
    kinds = [
        (landed.read_pages, fixed.SOURCE_A, "page", fx.pages(talks),
         cut(talks, '{"status_code":200,"page_no":', "turn", ',"body":{"jobPostings":[{"externalPath":"', "text").union(odd)),
        (landed.read_boards, fixed.SOURCE_B, "board", fx.boards(docs),
         cut(docs, '{"status_code":200,"company_id":', "doc_id", ',"body":"', "text")),
        (lambda s, path: landed.read_details(s, path, fixed.SOURCE_B), fixed.SOURCE_B, "detail", fx.board_details(docs),
         cut(docs, '{"status_code":200,"job_id":', "doc_id", ',"body":{"content":"', "text")),
        (landed.read_decisions, "decisions", "event", fx.decision_events(events),
         cut(events, '{"callback_query":{"id":"', "event_id", '","data":"', "event_type")),
    ]
    found = []
    for read, source, kind, whole, broken in kinds:
        path = fresh_path(spark, kind)
        whole.select(F.to_json(F.struct("*")).alias("value")).union(broken).write.text(path)
        lines = metrics.line_rejects(landed.broken_lines(read(spark, path)), source, kind)
        found.append(lines.withColumn("in_folder", c("file").contains(path.rsplit("/", 1)[1])))
    return reduce(DataFrame.unionByName, found).select("source", "stage", "reason", F.md5("raw").alias("raw_md5"), "in_folder")
