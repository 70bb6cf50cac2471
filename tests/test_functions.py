"""Column functions on hand-worked cases."""

import html as stdlib_html
import json

import pytest
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions import html, lists, messages, predicates, urls


@pytest.mark.parametrize(
    ("title", "keep"),
    [
        ("Senior Software Engineer, Backend", True),
        ("Senior Engineer, Internal Tools", False),
        ("Lead Software Engineer", False),
        ("", False),
        (None, False),
        ("SOFTWARE DEVELOPER", True),
    ],
)
def test_title_rule(one, title, keep):
    assert one(lambda c: predicates.title_ok(c, rules.TITLE_INCLUDE, rules.TITLE_EXCLUDE), title) is keep


@pytest.mark.parametrize(
    ("text", "recent"),
    [
        ("Posted Today", True), ("Posted Yesterday", True), ("Posted 1 Day Ago", True),
        ("Posted 30+ Days Ago", False), ("Posted recently", False), (None, False),
        ("1 Month Ago", True), ("Posted 99999999999999999999 Days Ago", False), ("Posted 01 Day Ago", True),
    ],
)
def test_recent_text(one, text, recent):
    assert one(predicates.recent_text, text) is recent


@pytest.mark.parametrize(
    ("text", "recent"),
    [
        ("2024-01-01T00:00:00Z", True), ("2023-12-31T23:59:59Z", False), ("2024-01-01T23:00:00", False),
        ("2030-01-01T00:00:00Z", True), ("2024-01-01T19:00:00-05:00", True), ("soon", False),
        ("2024-01-01", False), (None, False),
    ],
)
def test_recent_ts(one, text, recent):
    as_of = F.to_timestamp(F.lit("2024-01-02 00:00:00+00:00"))
    assert one(lambda c: predicates.recent_ts(c, as_of, 24), text) is recent


def test_location_falls_back_to_any_office(spark):
    rows = spark.createDataFrame(
        [(1, "Remote", [(("Pune",),)]), (2, "Remote", [(("Oslo",),), (None,)]), (3, None, None),
         (4, "Bengaluru, IN", None)],
        "id int, name string, offices array<struct<location: struct<name: string>>>",
    )
    hit = predicates.location_ok(F.col("name"), F.col("offices"), rules.LOCATIONS)
    assert {r.id for r in rows.filter(hit).collect()} == {1, 4}


@pytest.mark.parametrize(
    ("path", "segments"),
    [("/en-US/search/job/x", ["search", "job", "x"]), ("/", [""]), ("/en-US", []), ("", [""])],
)
def test_clean_segments(one, path, segments):
    assert one(urls.clean_segments, path) == segments


def test_page_endpoints(one):
    got = one(urls.page_endpoints, "https://citi.wd5.myworkdayjobs.com/2/1/refreshFacet/318c")
    assert (got.tenant, got.org) == ("citi", "2")
    assert got.list_url == "https://citi.wd5.myworkdayjobs.com/wday/cxs/citi/2/jobs"
    assert one(urls.page_endpoints, "https://h.example.com/en-US").list_url is None


@pytest.mark.parametrize(
    ("url", "slug"),
    [
        ("https://b.example.com/v1/boards/DoorDashIndia/jobs/", "DoorDashIndia"),
        ("https://b.example.com/boards", "boards"),
        ("https://b.example.com/acme", "acme"),
        ("https://b.example.com/", "https://b.example.com/"),
        ("acme", "acme"),
    ],
)
def test_board_slug(one, url, slug):
    assert one(urls.board_slug, url) == slug


def test_application_link_keeps_locale(one):
    got = one(urls.application_link, "https://p.example.com:81/en-US/jobs-and-careers/x?y#z", "/job/a_R1")
    assert got == "https://p.example.com:81/en-US/jobs-and-careers/job/a_R1"


def test_url_parts_survive_odd_text(one):
    got = one(urls.url_parts, "https://h.example.com/a b;v=1?q=1")
    assert tuple(got) == ("https", "h.example.com", "/a b")


def test_search_url(one):
    assert "?keywords=software%20engineer%20A/B%20%26%20Co%20bangalore&" in one(urls.search_url, "A/B & Co")
    assert one(urls.percent_encode, "a*b~c+d") == "a%2Ab~c%2Bd"


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("&lt;p&gt;Java&amp;nbsp;&lt;b&gt;API&lt;/b&gt;&lt;/p&gt;", "java api"),
        ("a < b and c > d", "a < b and c > d"),
        ("Ja<!-- x -->va", "ja va"),
        ("1 &lt; 2 and R&amp;D", "1 < 2 and r&d"),
        ("<p>x<SCRIPT>var t='</p>';</SCRIPT ><style>p{}</style>y", "x y"),
        ("<!DOCTYPE html><p>a  b\x1fc</p>", "a b c"),
        ("", ""), (None, ""),
    ],
)
def test_strip_html(one, markup, text):
    assert one(html.strip_html, markup) == text


def test_html_text_joins_nodes_by_one_separator(one):
    assert one(html.html_text, "<p><b>x</b></p><p>y</p> <p>z&eacute;</p>") == "x\ny\n \nzé"


def test_long_tag_runs_do_not_overflow(one):
    assert one(html.strip_html, "a" + "<b></b>" * 50_000 + "c") == "a c"


@pytest.mark.parametrize(
    "text",
    [
        "&eacute;&#233;&#xe9;&am&amp;amp &ampfoo &hearts; &#0; &#x1F600; &bogus; &notit; &",
        "&amp;lt; &lt&gt &#55296; &#1114112; &#xZ; &;", "plain", "&copy &copy;x &NotEqualTilde;",
    ],
)
def test_unescape_equals_the_standard_library(one, text):
    assert one(html.unescape, text) == stdlib_html.unescape(text)


def test_decode_list(one):
    for text, items in (('["a","b"]', ["a", "b"]), ('{"x":1}', []), ("bad", []), (None, []), ("[]", [])):
        assert one(lists.decode_list, text) == items


def test_json_field_tells_missing_from_null(spark):
    rows = spark.createDataFrame([(1, '{"a":null}'), (2, "{}"), (3, '{"a":"v"}')], "id int, j string")
    field = lists.json_field(F.from_json("j", "map<string,string>"), "a", F.lit("default"))
    assert {r.id: r.v for r in rows.select("id", field.alias("v")).collect()} == {1: None, 2: "default", 3: "v"}


def test_template_fills_in_order(one):
    got = one(
        lambda t, c, j: messages.fill_template(t, c, j, "<<TITLE>> at <<Company>>\n---\n\n---\n <<JOB-ID>> "),
        "<<Company>>", "X", "R1",
    )
    assert got == "X at X\n\nR1"


def test_job_message_without_keywords_and_link(spark):
    row = spark.range(1).select(
        messages.job_message(
            F.lit("Acme"), F.lit("Engineer"), F.lit(None).cast("string"),
            F.array().cast("array<string>"), F.lit(""),
        ).alias("m"),
        messages.keyboard(F.lit(7)).alias("k"),
    ).collect()[0]
    assert row.m == "🏢 <b>Acme</b>\n📌 Engineer\n📍 Unknown\n🏷 none"
    buttons = json.loads(row.k)["inline_keyboard"][0]
    assert [b["callback_data"] for b in buttons] == ["apply:7", "reject:7"]


def test_job_message_header_and_decided_message(spark):
    words = F.array(F.lit("java"), F.lit("kafka"))
    row = spark.range(1).select(
        messages.job_message(
            F.lit("Acme"), F.lit("T"), F.lit("Pune"), words, F.lit("https://l"), F.lit("workday"), F.lit(1), F.lit(2)
        ).alias("m"),
        messages.decided_message(
            F.lit("Acme"), F.lit("T"), F.lit("Pune"), F.lit("https://l"), F.lit("rejected"), F.lit("u")
        ).alias("d"),
    ).collect()[0]
    assert row.m.startswith("🔎 <b>Workday</b> | 1 of 2\n\n🏢 <b>Acme</b>\n")
    assert row.m.endswith('🏷 java, kafka\n🔗 <a href="https://l">Apply</a>')
    assert row.d == "<b>❌ REJECTED</b>\n\n🏢 <b>Acme</b>\n📌 T\n📍 Pune"
