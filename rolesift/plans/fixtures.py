"""Posting-shaped inputs derived by Spark from the analytics tables.

The tables hold no postings, so the named queries read pages, boards, details and
decision events made from `conversations`, `documents` and `events`, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.rules import RuleSet

DOC_RULES = RuleSet(
    positive=(
        ("that", 2), ("with", 3), ("this", 2), ("from", 3), ("la", 1), ("de la", 2), ("que", 2),
    ),
    negative=(("orre", 3), ("en", 1)),
    patterns=((r"(?i)licen[cs]e[a-z]*", 4), (r"[0-9]{4,}", 2)),
    threshold=5,
)

PAGE_RULES = RuleSet(
    title_include=("la", "the", "en"),
    title_exclude=("###", "que"),
    locations=("an", "os"),
    positive=(("java", 2), ("the", 3), ("de la", 2), ("le", 1), ("for", 2)),
    negative=(("of", 3), ("un", 2)),
    patterns=((r"[0-9]{3,}", 2),),
    threshold=3,
)

BOARD_RULES = RuleSet(
    title_include=("an", "er", "or"),
    title_exclude=("###", "que "),
    locations=("de", "en", "src1"),
    positive=(*DOC_RULES.positive, ("der", 4)),
    negative=DOC_RULES.negative,
    patterns=DOC_RULES.patterns,
    threshold=4,
)

LEARN_RULES = RuleSet(
    positive=(("ndor", 2), ("hest", 2), ("that", 1), ("with", 1), ("heed", 3)),
    negative=(("heti", 1), ("aner", 1)),
    patterns=(),
    threshold=0,
)

BOARD_AS_OF = "2024-01-02 12:00:00+00:00"
DECIDED_ON = "2024-02-01 00:00:00+00:00"
PAGE_LIMIT = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Markup that is easily taken apart wrongly; its text is `Quoted` and `R`
HARD_MARKUP = (
    '<body><p title="a > b">Quoted</p><ruby>R<rp>(</rp><rt>no</rt></ruby>'
    '<script>var t = "<p>"; a > b</script>'
)
EASY_MARKUP = "<body><p>Quoted</p><i>R</i>"
LOST_END = "<!-- never closed <p>lost</p>"


def hard_markup(html: Column) -> Column:
    """Pages with hard markup put in at the start of their bodies and an open comment at the end."""
    return F.concat(F.replace(html, F.lit("<body>"), F.lit(HARD_MARKUP)), F.lit(LOST_END))


SHIPPED = RuleSet()
YEARS = ("7+ years", "12 years", "Senior", "backend", "4 years")


def shipped_text(doc_id: Column, text: Column) -> Column:
    """The text with two words of the shipped lists and a phrase of a shipped pattern."""
    words = F.array(*(F.lit(k) for k, _ in (*SHIPPED.positive, *SHIPPED.negative)))
    phrases = F.array(*map(F.lit, YEARS))
    pick = lambda items, n: F.get(items, F.pmod(n, F.size(items)).cast("int"))
    return F.concat_ws(" ", F.lower(text), pick(words, doc_id), pick(words, doc_id * 7), F.lower(pick(phrases, doc_id)))


def shipped_title(part: Column, name: Column) -> Column:
    """The name with a word that titles need, and for some one that they must not have."""
    need = F.array(*map(F.lit, SHIPPED.title_include))
    never = F.array(*map(F.lit, SHIPPED.title_exclude))
    return F.concat_ws(
        " ", name, F.get(need, F.pmod(part, F.size(need)).cast("int")),
        F.get(never, F.pmod(part, 2 * F.size(never)).cast("int")),
    )


def gapped(conv: str, turn: str) -> Column:
    """Page numbers with a page missing before turn 4 of every third conversation."""
    return F.col(turn) + F.when((F.col(conv) % 3 == 0) & (F.col(turn) >= 4), 1).otherwise(0)


def _sentences(text: Column) -> Column:
    return F.split(text, r"\. ")


def pages(conversations: DataFrame) -> DataFrame:
    """One landed list page per turn; its sentences are the postings on it."""

    def posting(s: Column) -> Column:
        recent = F.when(s.contains("a"), "Posted Today").otherwise("Posted 30+ Days Ago")
        return F.struct(
            F.concat(F.lit("/job/"), F.md5(s)).alias("externalPath"),
            recent.alias("postedOn"),
            s.alias("locationsText"),
        )

    body = F.struct(F.transform(_sentences(F.col("text")), posting).alias("jobPostings"))
    return conversations.select(
        F.col("conv_id").cast("int").alias("company_id"),
        F.col("turn").cast("int").alias("page_no"),
        (F.col("turn") * PAGE_LIMIT).cast("int").alias("offset"),
        F.lit(PAGE_LIMIT).alias("limit"),
        F.when(F.col("role") == "system", 503).otherwise(200).alias("status_code"),
        F.to_json(body).alias("body"),
    )


def page_details(conversations: DataFrame) -> DataFrame:
    """One landed detail per sentence, with copies where a sentence is repeated."""
    s = F.col("s")
    info = F.struct(
        s.alias("title"),
        F.md5(s).alias("jobReqId"),
        F.concat(F.lit("L"), F.length(s).cast("string")).alias("location"),
        F.lit("Posted Today").alias("postedOn"),
        F.concat(F.lit("<p>"), s, F.lit("</p><b>Java</b>")).alias("jobDescription"),
    )
    lost = s.contains("tion") & s.contains("er")
    return conversations.select(
        F.col("conv_id").cast("int").alias("company_id"), F.explode(_sentences(F.col("text"))).alias("s")
    ).select(
        "company_id",
        F.concat(F.lit("/job/"), F.md5(s)).alias("external_path"),
        F.when(lost, 404).otherwise(200).alias("status_code"),
        F.to_json(F.struct(info.alias("jobPostingInfo"))).alias("body"),
    )


def page_companies(conversations: DataFrame) -> DataFrame:
    ident = F.col("id").cast("string")
    return conversations.select(F.col("conv_id").cast("int").alias("id")).distinct().select(
        "id",
        F.concat(F.lit("Company "), ident).alias("name"),
        F.concat(F.lit("https://t"), ident, F.lit(".example.com/en-US/careers/x")).alias("url"),
    )


def _company(source: Column) -> Column:
    return F.substring_index(source, "src", -1).cast("int")


def _updated(n_chars: Column) -> Column:
    hour = F.lpad((n_chars % 24).cast("string"), 2, "0")
    return F.concat(F.lit("2024-01-01T"), hour, F.lit(":00:00Z"))


def boards(documents: DataFrame) -> DataFrame:
    """One landed board answer per document, holding one posting."""
    job = F.struct(
        F.col("doc_id").alias("id"),
        F.substring_index("text", ".", 1).alias("title"),
        _updated(F.col("n_chars")).alias("updated_at"),
        F.struct(F.col("lang").alias("name")).alias("location"),
        F.array(F.struct(F.struct(F.col("source").alias("name")).alias("location"))).alias("offices"),
    )
    return documents.select(
        _company(F.col("source")).alias("company_id"),
        F.lit(200).alias("status_code"),
        F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"),
    )


def board_details(documents: DataFrame) -> DataFrame:
    """Details in three forms: requisition id missing (en), null (de), or present."""
    detail = F.struct(
        F.substring_index("text", ".", 1).alias("title"),
        F.when(F.col("lang") == "en", None)
        .when(F.col("lang") == "de", "null-marker")
        .otherwise(F.concat(F.lit("R"), F.md5("text")))
        .alias("requisition_id"),
        _updated(F.col("n_chars")).alias("updated_at"),
        F.concat(F.lit("&lt;p&gt;"), F.col("text"), F.lit("&lt;/p&gt;")).alias("content"),
        F.concat(F.lit("https://b.example.com/"), F.col("doc_id").cast("string")).alias("absolute_url"),
        F.struct(F.col("lang").alias("name")).alias("location"),
    )
    body = F.replace(F.to_json(detail), F.lit('"null-marker"'), F.lit("null"))
    return documents.select(
        _company(F.col("source")).alias("company_id"),
        F.col("doc_id").alias("job_id"),
        F.lit(200).alias("status_code"),
        body.alias("body"),
    )


def board_companies(documents: DataFrame) -> DataFrame:
    return documents.select(_company(F.col("source")).alias("id"), F.col("source").alias("name")).distinct().select(
        "id", "name", F.concat(F.lit("https://x.example.com/boards/"), F.col("name")).alias("url")
    )


def decision_events(events: DataFrame) -> DataFrame:
    """Callbacks: purchases apply and errors reject a job; other types are faulty."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    data = (
        F.when(kind == "purchase", F.concat(F.lit("apply:"), user))
        .when(kind == "error", F.concat(F.lit("reject:"), user))
        .when(kind == "click", F.concat(F.lit("like:"), user))
        .when(kind == "signup", F.concat(F.lit("apply:x"), user))
    )
    return events.select(
        F.col("ts").alias("received_at"),
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            data.alias("data"),
            F.struct((F.col("event_id") + 1).alias("message_id")).alias("message"),
        ).alias("callback_query"),
    )


def supplier_jobs(supplier: DataFrame) -> DataFrame:
    """job_info rows: suppliers are jobs, nations their companies."""
    return supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("company_id"),
        F.col("s_name").alias("ats_job_id"),
        F.concat(F.lit("Senior "), F.col("s_name")).alias("title"),
        F.concat(F.lit("Site "), F.col("s_nationkey").cast("string")).alias("location"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("https://j.example.com/"), F.col("s_suppkey").cast("string")))
        .otherwise("")
        .alias("application_link"),
        F.lit(None).cast("timestamp").alias("created_ts"),
        F.lit(None).cast("string").alias("user_decision"),
    )


def nation_companies(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("company_name"),
        F.lit("").alias("base_country"),
        F.lit("").alias("target_location"),
        F.lit("").alias("ats"),
        F.lit("").alias("ats_link"),
    )


# Characters that would end a landed line or the text in it, and what they become
LINE_ENDS, LINE_SIGNS = '"\\\n\r', "''  "


def cut_line(head: Column, text: Column) -> Column:
    """A landed line that ends inside its last text."""
    return F.concat(head, F.translate(F.coalesce(text, F.lit("")), LINE_ENDS, LINE_SIGNS))


def turn_boards(conversations: DataFrame) -> DataFrame:
    """One board answer per turn, of twenty companies that list no pages."""
    job = F.struct(
        _turn_job().alias("id"), _turn_title().alias("title"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"),
        F.struct(F.lit("en").alias("name")).alias("location"),
    )
    return conversations.select(
        _turn_company().alias("company_id"), F.lit(200).alias("status_code"),
        F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"),
    )


def turn_details(conversations: DataFrame) -> DataFrame:
    """Their details: the whole turn, under the posting id that its first sentence has as a page's posting."""
    detail = F.struct(
        _turn_title().alias("title"), F.md5(_sentences(F.col("text"))[0]).alias("requisition_id"),
        F.concat(F.lit("&lt;p&gt;"), F.col("text"), F.lit("&lt;/p&gt;")).alias("content"),
    )
    return conversations.select(
        _turn_company().alias("company_id"), _turn_job().alias("job_id"), F.lit(200).alias("status_code"),
        F.to_json(detail).alias("body"),
    )


def turn_companies(conversations: DataFrame) -> DataFrame:
    return conversations.select(_turn_company().alias("id")).distinct().select(
        "id", F.concat(F.lit("Board "), F.col("id").cast("string")).alias("name"),
        F.lit("https://x.example.com/boards/b").alias("url"),
    )


def _turn_company() -> Column:
    return (F.col("conv_id") % 20 + 1_000_000).cast("int")


def _turn_job() -> Column:
    return (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint")


def _turn_title() -> Column:
    return F.concat_ws(" ", F.lit("Engineer"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))


# Cut out of a text: runs of 1 to 6 words, runs that marks open or close, and marks alone
PHRASES = tuple(p.replace("W", r"[\p{L}\p{N}_]") for p in (r"(W+(?: W+){0,5})", r"([,.] W+(?: W+){0,3})", r"(W+(?: W+){0,2}[,.] )", r"([,.] )"))
