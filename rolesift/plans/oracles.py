"""The named queries again, as SQL for an independent engine (DuckDB's dialect)."""

from __future__ import annotations

from dataclasses import replace

from rolesift.functions.messages import ANSWERS
from rolesift.plans import fixtures as fx
from rolesift.rules import RuleSet

_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"
_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
_BREAK = ". "


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_q(w) for w in words)


def _hit(text: str, keyword: str) -> str:
    return f"regexp_matches({text}, {_q(f'(^|{_N})' + chr(92) + 'Q' + keyword + chr(92) + 'E' + f'($|{_N})')})"


def _any(text: str, words) -> str:
    hits = " OR ".join(f"contains(lower({text}), {_q(w)})" for w in words)
    return f"coalesce({hits}, false)"


def _matches(text: str, words) -> str:
    items = ", ".join(f"CASE WHEN {_hit(text, w)} THEN {_q(w)} END" for w in words)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)" if words else "[]::VARCHAR[]"


def _patterns(text: str, patterns) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches({text}, {_q(p)}) THEN regexp_extract({text}, {_q(p)}) END"
        for p, _ in patterns
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)" if patterns else "[]::VARCHAR[]"


def _sum(text: str, weights) -> str:
    return " + ".join(
        ["0.0::DOUBLE", *[f"CASE WHEN {_hit(text, k)} THEN {w} ELSE 0 END" for k, w in weights]]
    )


def _score(text: str, rules: RuleSet) -> str:
    bonus = " + ".join(
        ["0.0::DOUBLE"]
        + [f"CASE WHEN regexp_matches({text}, {_q(p)}) THEN {b} ELSE 0 END" for p, b in rules.patterns]
    )
    raw = f"({_sum(text, rules.positive)}) - ({_sum(text, rules.negative)}) + ({bonus})"
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {raw}))"


def _scored(rel: str, text: str, rules: RuleSet, keep: str) -> str:
    return (
        f"SELECT {keep}, {_score(text, rules)} AS score, "
        f"{_matches(text, [k for k, _ in rules.positive])} AS positive_matches, "
        f"{_matches(text, [k for k, _ in rules.negative])} AS negative_matches, "
        f"{_patterns(text, rules.patterns)} AS experience_matches FROM {rel}"
    )


_JOINED = ", ".join(
    f"array_to_string({m}, '|') AS {m}"
    for m in ("positive_matches", "negative_matches", "experience_matches")
)
_PLAIN = "(SELECT doc_id, lower(text) AS plain FROM documents)"
_DOCS = _scored(_PLAIN, "plain", fx.DOC_RULES, "doc_id")

# ---- HTML ----

_ENTITIES = (
    ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&nbsp;?", " "),
    ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&"),
)


def _decode(expr: str) -> str:
    for entity, char in _ENTITIES:
        expr = f"regexp_replace({expr}, '{entity}', '{char}', 'g')"
    return expr


def _no_markup(expr: str, sep: str) -> str:
    silent = r"(?is)<(?:script|style|template)\b[^>]*>.*?</(?:script|style|template)\s*>|<!--.*?-->"
    tags = r"(?:</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>)+"
    expr = f"regexp_replace({expr}, {_q(silent)}, '<i>', 'g')"
    return _decode(f"regexp_replace({expr}, {_q(tags)}, {sep}, 'g')")


def _lines(expr: str) -> str:
    return f"regexp_replace({_no_markup(expr, 'chr(10)')}, {_q(f'^{_WS}|{_WS}$')}, '', 'g')"


def _strip(expr: str) -> str:
    return f"lower(trim(regexp_replace({_no_markup(_decode(expr), _q(' '))}, {_q(_WS)}, ' ', 'g')))"


# Pages as they read once the hard markup put into them is replaced by plain markup
_EASY = f"replace(html, '<body>', {_q(fx.EASY_MARKUP)})"

# ---- Shipped rules ----

_SHIPPED = replace(fx.SHIPPED, patterns=tuple((p.replace("(?iU)", "(?i)"), b) for p, b in fx.SHIPPED.patterns))
_ALL_WORDS = f"[{_list([k for k, _ in (*fx.SHIPPED.positive, *fx.SHIPPED.negative)])}]"
_YEARS = f"[{_list(w.lower() for w in fx.YEARS)}]"
_SHIPPED_TEXT = f"""(SELECT doc_id, lower(text) || ' ' || w[doc_id % len(w) + 1] || ' ' || w[doc_id * 7 % len(w) + 1] || ' ' || y[doc_id % len(y) + 1] AS plain
    FROM (SELECT *, {_ALL_WORDS} AS w, {_YEARS} AS y FROM documents))"""
_SHIPPED_ROWS = _scored(_SHIPPED_TEXT, "plain", _SHIPPED, "doc_id")

# ---- Learner ----

def _marked(text: str) -> str:
    return f"regexp_replace({text}, '({_W}+)', chr(1) || '\\1' || chr(2), 'g')"


_DECIDED = f"""
WITH decided AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'applied' ELSE 'rejected' END AS user_decision,
         positive_matches || negative_matches AS keywords
  FROM ({_scored(_PLAIN, "plain", fx.LEARN_RULES, "doc_id")}) JOIN labels USING (doc_id)),
totals AS (SELECT count(*) AS total, count(*) FILTER (WHERE user_decision = 'applied') AS accepted FROM decided),
counts AS (
  SELECT keyword, count(*) FILTER (WHERE user_decision = 'applied') AS accept_count,
         count(*) FILTER (WHERE user_decision <> 'applied') AS reject_count, count(*) AS sample_count
  FROM (SELECT user_decision, unnest(keywords) AS keyword FROM decided) GROUP BY keyword),
lifted AS (
  SELECT *, (accept_count::DOUBLE / sample_count) / ((SELECT accepted FROM totals)::DOUBLE / (SELECT total FROM totals)) AS lift
  FROM counts
  WHERE sample_count >= 3 AND (SELECT total FROM totals) >= 10 AND (SELECT accepted FROM totals) > 0),
learned AS (
  SELECT *, CASE WHEN lift > 1.3 THEN least(2.0, 1.0 + (lift - 1.0) * 0.5)
                 WHEN lift < 0.7 THEN greatest(0.25, lift) ELSE 1.0 END AS multiplier FROM lifted)
"""
_RULE_ROWS = ", ".join(
    f"({i}, '{p}', {_q(k)}, {float(w)}::DOUBLE)"
    for p, words in (("pos", fx.LEARN_RULES.positive), ("neg", fx.LEARN_RULES.negative))
    for i, (k, w) in enumerate(words)
)

# ---- Events and decisions ----

_PARSED = """
WITH parsed AS (
  SELECT event_id, ts, event_type,
         CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'ok' WHEN 'click' THEN 'unknown_action'
              WHEN 'signup' THEN 'invalid_id' ELSE 'invalid_request' END AS parsed_verdict,
         CASE WHEN event_type IN ('purchase', 'error') THEN user_id END AS job_id,
         CASE event_type WHEN 'purchase' THEN 'applied' ELSE 'rejected' END AS label
  FROM events)
"""


def _verdict_sql(known: str) -> str:
    return (
        _PARSED
        + f""", held AS ({known}),
ranked AS (
  SELECT *, first_value(label) OVER w AS first_label, row_number() OVER w AS place
  FROM parsed WHERE parsed_verdict = 'ok'
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id::VARCHAR)),
verdicts AS (
  SELECT event_id, r.job_id, CASE WHEN held.job_id IS NULL THEN 'job_not_found'
         WHEN held.decision IS NOT NULL THEN 'already_' || held.decision
         WHEN place = 1 THEN label ELSE 'already_' || first_label END AS verdict
  FROM ranked r LEFT JOIN held ON held.job_id = r.job_id
  UNION ALL SELECT event_id, NULL, parsed_verdict FROM parsed WHERE parsed_verdict <> 'ok')
"""
    )


_HELD = "SELECT s_suppkey AS job_id, CASE WHEN s_nationkey < 3 THEN 'applied' END AS decision FROM supplier"
_JOBS = """
  SELECT s_suppkey AS id, s_nationkey AS company_id, s_name AS ats_job_id, 'Senior ' || s_name AS title,
         'Site ' || s_nationkey AS location, n_name AS company,
         CASE WHEN s_acctbal > 0 THEN 'https://j.example.com/' || s_suppkey ELSE '' END AS link
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
_SEARCH_HEAD = "https://www.linkedin.com/search/results/people/?keywords="
_SEARCH_TAIL = "&origin=FACETED_SEARCH&pastCompany=%5B%229390173%22%5D"


def _search(company: str) -> str:
    words = f"replace(url_encode('software engineer ' || {company} || ' bangalore'), '%2F', '/')"
    return f"'{_SEARCH_HEAD}' || {words} || '{_SEARCH_TAIL}'"


def _decided_text(decision: str) -> str:
    return (
        f"concat_ws(chr(10), '<b>' || CASE WHEN {decision} = 'applied' THEN '✅ APPLIED' ELSE '❌ REJECTED' END || '</b>' || chr(10), "
        "'🏢 <b>' || company || '</b>', '📌 ' || title, '📍 ' || location, "
        f"CASE WHEN {decision} = 'applied' AND link <> '' THEN '🔗 <a href=\"' || link || '\">Apply</a>' END, "
        f"CASE WHEN {decision} = 'applied' THEN '🔍 <a href=\"' || {_search('company')} || '\">Find referrers at ' || company || ' on LinkedIn</a>' END)"
    )


_NOTE = (
    "'I came across a recent posting for ' || title || ' role at ' || company || '. I’ve already applied and wanted "
    "to check if you’d be open to referring me. I’ve attached my resume for context.' || chr(10) || chr(10) || 'Job ID: ' || ats_job_id"
)
_KEYBOARD = (
    "'{{\"inline_keyboard\":[[{{\"text\":\"✅ Apply\",\"callback_data\":\"apply:' || {0} || '\"}},"
    "{{\"text\":\"❌ Reject\",\"callback_data\":\"reject:' || {0} || '\"}}]]}}'"
)

# ---- URLs ----

_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
_PATH = f"regexp_extract(url, '{_URL}', 3)"
_HOST = f"regexp_extract(url, '{_URL}', 2)"
_SPLIT = f"string_split(trim({_PATH}, '/'), '/')"
_CLEAN = f"list_filter({_SPLIT}, lambda s: NOT regexp_matches(s, '^[a-z]{{2}}-[A-Z]{{2}}$'))"

# ---- Merges ----

_ORDER_JOBS = (
    "SELECT o_custkey AS company_id, o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS ats_job_id, "
    "o_orderkey AS line, o_orderstatus AS status FROM orders"
)
_INSERT = f"""
WITH batch AS ({_ORDER_JOBS}),
old AS (SELECT row_number() OVER (ORDER BY line) AS id, company_id, ats_job_id, line FROM (
  SELECT *, row_number() OVER (PARTITION BY ats_job_id ORDER BY line) AS place FROM batch WHERE status = 'F')
  WHERE place = 1),
fresh AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ats_job_id ORDER BY line) AS place FROM batch)
  WHERE place = 1 AND ats_job_id NOT IN (SELECT ats_job_id FROM old)),
inserted AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY line) AS id, company_id, ats_job_id, line FROM fresh)
"""

_STATS = "SELECT l_partkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1"
_FIRST_LINE = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
  FROM lineitem) WHERE place = 1
"""

# ---- Whole runs ----

_B = fx.BOARD_RULES
_BOARD_ROWS = f"""
  SELECT doc_id AS job_id, split_part(source, 'src', 2)::INT AS company_id, source AS company, lang,
         split_part(text, '.', 1) AS title,
         '2024-01-01T' || lpad((n_chars % 24)::VARCHAR, 2, '0') || ':00:00Z' AS updated_at, n_chars, text, source
  FROM documents
"""
_BOARD_TEXT = _strip("'&lt;p&gt;' || text || '&lt;/p&gt;'")
_BOARD_RUN = f"""
WITH postings AS (
  SELECT * FROM ({_BOARD_ROWS})
  WHERE n_chars % 24 >= 12
    AND {_any("title", _B.title_include)} AND NOT {_any("title", _B.title_exclude)}
    AND ({_any("lang", _B.locations)} OR {_any("source", _B.locations)})),
plain AS (SELECT *, {_BOARD_TEXT} AS plain,
  CASE lang WHEN 'en' THEN job_id::VARCHAR WHEN 'de' THEN NULL ELSE 'R' || md5(text) END AS ats_job_id FROM postings),
scored AS ({_scored("plain", "plain", _B, "plain.*")}),
kept AS (SELECT *, row_number() OVER (PARTITION BY ats_job_id ORDER BY company_id, job_id) AS place FROM scored
  WHERE score >= {_B.threshold} AND ats_job_id IS NOT NULL AND length(title) <= 500),
fresh AS (SELECT *, row_number() OVER (ORDER BY company_id, job_id) AS id FROM kept WHERE place = 1)
"""
_JOB_ROWS = """
SELECT id, company_id, ats_job_id, md5(title) AS title_md5, location, application_link,
       round(score)::INT AS relevance_score, to_json(positive_matches)::VARCHAR AS positive_matches,
       to_json(negative_matches)::VARCHAR AS negative_matches, to_json(experience_matches)::VARCHAR AS experience_matches
"""
_BOARD_JOBS = (
    _BOARD_RUN
    + _JOB_ROWS.replace("location,", "lang AS location,").replace(
        "application_link,", "'https://b.example.com/' || job_id AS application_link,"
    )
    + " FROM fresh"
)

_P = fx.PAGE_RULES
_PAGE_TEXT = f"lower(trim(regexp_replace(s || ' Java', {_q(_WS)}, ' ', 'g')))"
_PAGE_RUN = f"""
WITH landed AS (
  SELECT conv_id::INT AS company_id, turn::INT AS page_no, role = 'system' AS bad, string_split(text, '{_BREAK}') AS parts FROM conversations),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY page_no) - 1 AS nth,
         max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY page_no) AS bad_before,
         max(CASE WHEN len(parts) < {fx.PAGE_LIMIT} THEN 1 ELSE 0 END) OVER
           (PARTITION BY company_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS short_before
  FROM landed),
read AS (SELECT * FROM flagged WHERE nth = page_no AND bad_before = 0 AND coalesce(short_before, 0) = 0 AND page_no < 20),
postings AS (SELECT company_id, page_no, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS pos FROM read),
wanted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, md5(s) ORDER BY page_no, pos) AS place FROM postings
  WHERE contains(s, 'a') AND {_any("s", _P.locations)}) WHERE place = 1),
judged AS (
  SELECT *, NOT (contains(s, 'tion') AND contains(s, 'er')) AS detail_ok,
         {_any("s", _P.title_include)} AND NOT {_any("s", _P.title_exclude)} AS good_title, {_PAGE_TEXT} AS plain FROM wanted),
scored AS ({_scored("judged", "plain", _P, "judged.*")}),
passed AS (SELECT * FROM scored WHERE detail_ok AND good_title AND score >= {_P.threshold}),
held AS (SELECT DISTINCT md5(s) AS k FROM (SELECT unnest(parts) AS s FROM landed) WHERE md5(s) LIKE 'a%'),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY md5(s) ORDER BY company_id, page_no, pos) AS nth FROM passed
  WHERE length(s) <= 500 AND md5(s) NOT IN (SELECT k FROM held)),
fresh AS (
  SELECT *, (SELECT count(*) FROM held) + row_number() OVER (ORDER BY company_id, page_no, pos) AS id,
         md5(s) AS ats_job_id, s AS title, 'L' || length(s) AS location,
         'https://t' || company_id || '.example.com/en-US/careers/job/' || md5(s) AS application_link
  FROM kept WHERE nth = 1)
"""

_LINE = f"translate(coalesce(text, ''), {_q(fx.LINE_ENDS)}, {_q(fx.LINE_SIGNS)})"

_TURNS = """
        WITH landed AS (SELECT conv_id, turn, role, length(text) AS size, length(text) > 1400 AS bad,
            turn + CASE WHEN conv_id % 3 = 0 AND turn >= 4 THEN 1 ELSE 0 END AS page FROM conversations),
        flagged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS nth,
            max(CASE WHEN bad OR size = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY page) AS bad_before,
            max(CASE WHEN size < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS short_before
            FROM landed)
        SELECT conv_id, turn, role FROM flagged WHERE nth = page AND page < {cap} AND bad_before = 0 AND coalesce(short_before, 0) = 0"""

ORACLES: dict[str, str] = {
    "keyword_score": f"SELECT doc_id, round(score, 4) AS score, {_JOINED} FROM ({_DOCS}) WHERE score >= {fx.DOC_RULES.threshold}",
    "keyword_score_shipped": f"SELECT doc_id, round(score, 4) AS score, {_JOINED} FROM ({_SHIPPED_ROWS})",
    "patterns_shipped": f"""
        SELECT doc_id, array_to_string({_patterns("plain", _SHIPPED.patterns)}, '|') AS matches,
               {" + ".join(f"CASE WHEN regexp_matches(plain, {_q(p)}) THEN {b}.0::DOUBLE ELSE 0 END" for p, b in _SHIPPED.patterns)} AS bonus
        FROM {_SHIPPED_TEXT}""",
    "title_filter_shipped": f"""
        SELECT p_partkey, title FROM (SELECT p_partkey, concat_ws(' ', p_name, need[p_partkey % len(need) + 1], never[p_partkey % (2 * len(never)) + 1]) AS title
            FROM (SELECT *, [{_list(fx.SHIPPED.title_include)}] AS need, [{_list(fx.SHIPPED.title_exclude)}] AS never FROM part))
        WHERE NOT {_any("title", fx.SHIPPED.title_exclude)} AND {_any("title", fx.SHIPPED.title_include)}""",
    "keyword_matches_long": f"SELECT doc_id, unnest(positive_matches || negative_matches) AS keyword FROM ({_DOCS})",
    "keyword_matches_phrases": rf"""
        WITH keywords AS (
          SELECT DISTINCT unnest({" || ".join(f"regexp_extract_all(lower(text), {_q(p)}, 1)" for p in fx.PHRASES)}) AS keyword
          FROM benchmark),
        -- Every word between marks of its own, so that a plain search finds whole words only
        marked AS (
          SELECT keyword, CASE WHEN regexp_matches(keyword, '^{_N}') THEN chr(2) ELSE '' END || {_marked("keyword")}
            || CASE WHEN regexp_matches(keyword, '{_N}$') THEN chr(1) ELSE '' END AS m FROM keywords),
        texts AS (SELECT doc_id, {_marked("plain")} AS t FROM {_PLAIN})
        SELECT keyword, count(*) AS docs, sum(doc_id) AS doc_sum FROM texts JOIN marked ON contains(t, m) GROUP BY keyword""",
    "keyword_matches_table": rf"""
        WITH kw AS (SELECT DISTINCT k FROM (SELECT unnest(regexp_extract_all(lower(text), '{_W}+')) AS k FROM benchmark) WHERE length(k) >= 6),
        words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_W}+')) AS k FROM documents)
        SELECT k AS keyword, count(*) AS docs, sum(doc_id)::BIGINT AS doc_sum FROM words JOIN kw USING (k) GROUP BY 1""",
    "pattern_first_match": f"""
        SELECT doc_id, array_to_string({_patterns("plain", fx.DOC_RULES.patterns)}, '|') AS matches,
               {" + ".join(f"CASE WHEN regexp_matches(plain, {_q(p)}) THEN {b}.0::DOUBLE ELSE 0 END" for p, b in fx.DOC_RULES.patterns)} AS bonus
        FROM {_PLAIN}""",
    "stored_score": f"SELECT round(score * 1.25)::INT AS relevance_score, count(*) AS docs FROM ({_DOCS}) GROUP BY 1",
    "decision_totals": _DECIDED + "SELECT total, accepted, total - accepted AS rejected FROM totals",
    "keyword_counts": _DECIDED + "SELECT * FROM counts",
    "keyword_lift": _DECIDED
    + "SELECT keyword, accept_count, reject_count, sample_count, round(lift, 4) AS lift, round(multiplier, 4) AS multiplier FROM learned",
    "effective_weights": _DECIDED
    + f"""SELECT ordinal, polarity, k.keyword, weight, round(coalesce(multiplier, 1.0), 4) AS multiplier
        FROM (VALUES {_RULE_ROWS}) k(ordinal, polarity, keyword, weight) LEFT JOIN learned ON learned.keyword = k.keyword""",
    "keyword_score_weighted": _DECIDED
    + f""", m AS (SELECT k.keyword, polarity, weight * coalesce(multiplier, 1.0) * CASE polarity WHEN 'pos' THEN 1 ELSE -1 END AS worth
        FROM (VALUES {_RULE_ROWS}) k(ordinal, polarity, keyword, weight) LEFT JOIN learned ON learned.keyword = k.keyword),
        found AS (SELECT doc_id, unnest(positive_matches || negative_matches) AS keyword FROM ({_scored(_PLAIN, "plain", fx.LEARN_RULES, "doc_id")}))
        SELECT doc_id, round(greatest(0.0, least(100.0, sum(worth))), 4) AS score FROM found JOIN m USING (keyword) GROUP BY 1 HAVING sum(worth) > 0""",
    "recalibrate_incremental": _DECIDED
    + """SELECT keyword, round(multiplier::FLOAT::DOUBLE, 4) AS multiplier, accept_count, reject_count, sample_count,
               round(round(lift, 4)::FLOAT::DOUBLE, 4) AS lift FROM learned""",
    "recalibrate": _DECIDED
    + """, old AS (SELECT keyword || CASE WHEN accept_count > 10 THEN '' ELSE '-old' END AS keyword FROM counts)
        SELECT coalesce(l.keyword, old.keyword) AS keyword, coalesce(round(multiplier::FLOAT::DOUBLE, 4), 9.0) AS multiplier,
               coalesce(accept_count, 0) AS accept_count, coalesce(sample_count, 0) AS sample_count,
               coalesce(round(round(lift, 4)::FLOAT::DOUBLE, 4), 1.0) AS lift,
               CASE WHEN l.keyword IS NOT NULL THEN '2024-02-01' END AS updated_on
        FROM learned l FULL JOIN old ON l.keyword = old.keyword""",
    "overrides_scan": _DECIDED + "SELECT keyword, round(multiplier::FLOAT::DOUBLE, 4) AS multiplier FROM learned",
    "html_text": f"SELECT page_id, md5(t) AS text_md5, length(t)::INT AS chars FROM (SELECT page_id, {_strip(_EASY)} AS t FROM pages)",
    "html_lines": f"SELECT page_id, md5({_lines(_EASY)}) AS text_md5 FROM pages",
    "double_strip": f"SELECT page_id, md5({_strip(_lines(_EASY))}) AS text_md5 FROM pages",
    "url_parts": f"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, {_HOST} AS netloc, {_PATH} AS path FROM pages",
    "url_endpoints": f"""
        SELECT page_id, array_to_string(segments, '|') AS segments, split_part(host, '.', 1) AS tenant, segments[1] AS org,
               'https://' || host || '/wday/cxs/' || split_part(host, '.', 1) || '/' || segments[1] AS detail_url,
               'https://' || host || '/wday/cxs/' || split_part(host, '.', 1) || '/' || segments[1] || '/jobs' AS list_url
        FROM (SELECT page_id, {_HOST} AS host, {_CLEAN} AS segments FROM pages)""",
    "url_slug": f"""
        SELECT page_id, CASE WHEN list_position(p, 'boards') > 0 AND len(p) > list_position(p, 'boards') THEN p[list_position(p, 'boards') + 1]
               WHEN len(p) > 0 THEN p[len(p)] ELSE url END AS slug
        FROM (SELECT page_id, url, list_filter({_SPLIT}, lambda s: s <> '') AS p FROM (SELECT page_id, replace(url, '/en/', '/v1/boards/') AS url FROM pages))""",
    "url_link": f"""
        SELECT page_id, regexp_extract(url, '{_URL}', 1) || '://' || {_HOST} || '/' || array_to_string(list_filter({_SPLIT}, lambda s: s <> '')[1:2], '/')
               || '/job/' || page_id AS link FROM pages""",
    "search_url": f"""
        SELECT s_suppkey, {_search("s_name || ' & Söhne/' || n_name")} AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "title_filter": f"""
        SELECT p_partkey, title FROM (SELECT p_partkey, p_name || ' ' || p_type AS title FROM part)
        WHERE NOT {_any("title", ("promo", "old", "red r"))} AND {_any("title", ("ring", "gizmo", "bolt"))}""",
    "contains_any": f"SELECT doc_id, {_any('text', ('être', 'license', 'ation the'))} AS hit FROM documents",
    "recent_text": r"SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_extract(o_orderpriority, '(\d+)', 1)::INT <= 1",
    "recent_ts": """
        SELECT event_id, event_type FROM (SELECT *, date_trunc('second', ts) + CASE WHEN event_type = 'view' THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS t
        FROM events) WHERE event_type <> 'click' AND t >= TIMESTAMP '2024-01-19 00:00:00'""",
    "fresh_only": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'",
    "location_filter": f"""
        SELECT doc_id, lang FROM documents WHERE {_any("lang", ("de", "that the", "eaux."))}
        OR len(list_filter(string_split(text, '{_BREAK}'), lambda s: {_any("s", ("de", "that the", "eaux."))})) > 0""",
    "width_check": "SELECT doc_id, length(text) <= 500 AS fits FROM documents",
    "first_per_key": """
        SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place
        FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND contains(event_type, 'e')) WHERE place = 1""",
    "pages_until_stop": _TURNS.format(cap=100),
    "pages_until_cap": _TURNS.format(cap=3),
    "explode_postings": f"""
        SELECT company_id, page_no, pos, '/job/' || md5(s) AS external_path,
               CASE WHEN contains(s, 'a') THEN 'Posted Today' ELSE 'Posted 30+ Days Ago' END AS posted_on, md5(s) AS place_md5
        FROM (SELECT conv_id::INT AS company_id, turn::INT AS page_no, unnest(string_split(text, '{_BREAK}')) AS s,
              (generate_subscripts(string_split(text, '{_BREAK}'), 1) - 1)::INT AS pos FROM conversations)""",
    "explode_board": f"SELECT company_id, job_id, md5(title) AS title_md5, updated_at, lang AS location_name, source AS office FROM ({_BOARD_ROWS})",
    "assign_ids": "SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS id, s_suppkey FROM supplier",
    "number_messages": """
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders""",
    "join_details": f"""
        SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_suppkey FROM orders JOIN ({_FIRST_LINE}) ON l_orderkey = o_orderkey""",
    "decided_scan": f"""
        SELECT o_orderkey AS job_id, o_orderstatus AS user_decision, l_returnflag AS positive_matches, l_linestatus AS negative_matches
        FROM orders JOIN ({_FIRST_LINE}) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'""",
    "jobs_with_company": "SELECT o_orderkey, o_custkey AS company_id, c_name AS company FROM orders JOIN customer ON o_custkey = c_custkey",
    "normalize_a": f"""
        SELECT md5(s) AS ats_job_id, 'L' || length(s) AS location, 'Posted Today' AS posted,
               md5({_lines("'<p>' || any_value(s) || '</p><b>Java</b>'")}) AS text_md5, count(*) AS copies
        FROM (SELECT unnest(string_split(text, '{_BREAK}')) AS s FROM conversations)
        WHERE NOT (contains(s, 'tion') AND contains(s, 'er')) GROUP BY 1, 2, 3""",
    "normalize_b": f"""
        SELECT job_id, CASE lang WHEN 'en' THEN job_id::VARCHAR WHEN 'de' THEN NULL ELSE 'R' || md5(text) END AS ats_job_id, lang AS location,
               updated_at AS posted, 'https://b.example.com/' || job_id AS application_link, md5('&lt;p&gt;' || text || '&lt;/p&gt;') AS text_md5
        FROM ({_BOARD_ROWS})""",
    "insert_new": _INSERT + "SELECT * FROM inserted",
    "insert_new_target": _INSERT
    + "SELECT company_id, count(*) AS jobs, max(id) AS last_id FROM (SELECT * FROM old UNION ALL SELECT * FROM inserted) GROUP BY 1",
    "insert_new_nocase": """
        SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS p_partkey FROM part WHERE NOT p_name LIKE 'red%' GROUP BY 1""",
    "upsert": f"""
        WITH a AS ({_STATS.format("A")}), r AS (SELECT * FROM ({_STATS.format("R")}) WHERE lines >= 3)
        SELECT coalesce(r.l_partkey, a.l_partkey) AS l_partkey, coalesce(r.lines, a.lines) AS lines, coalesce(r.quantity, a.quantity) AS quantity
        FROM a FULL JOIN r ON a.l_partkey = r.l_partkey""",
    "update_by_id": """
        WITH e AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS decision FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
        SELECT o_orderkey AS id, coalesce(decision, nullif(o_orderstatus, 'P')) AS user_decision FROM orders LEFT JOIN e ON user_id = o_orderkey""",
    "update_matched": """
        SELECT user_id AS job_id, user_id IN (SELECT o_orderkey FROM orders) AS matched
        FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'error'))""",
    "job_by_id": """
        SELECT s_suppkey AS id, s_nationkey AS company_id, n_name AS company, 'Senior ' || s_name AS title, 'Site ' || s_nationkey AS location,
               CASE WHEN s_acctbal > 0 THEN 'https://j.example.com/' || s_suppkey ELSE '' END AS application_link
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 7""",
    "delete_cascade": """
        SELECT 'parent' AS "table", count(*) AS deleted FROM orders WHERE o_orderpriority LIKE '1-%'
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%')""",
    "delete_cascade_kept": """
        SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%') GROUP BY 1""",
    "json_list_roundtrip": f"""
        SELECT doc_id, array_to_string(CASE WHEN score < 3 THEN [] ELSE positive_matches END || negative_matches, '|') AS keywords FROM ({_DOCS})""",
    "parse_decision": _PARSED + "SELECT event_id, parsed_verdict AS verdict, job_id, label FROM parsed",
    "first_decision": _verdict_sql(_HELD) + "SELECT * FROM verdicts",
    "decision_outbox": _verdict_sql(_HELD)
    + f""", now AS (SELECT v.event_id, v.verdict, j.* FROM verdicts v JOIN ({_JOBS}) j ON j.id = v.job_id WHERE v.verdict IN ('applied', 'rejected'))
        SELECT 'edit' AS kind, id AS job_id, {_decided_text("verdict")} AS text, event_id + 1 AS reply_to FROM now
        UNION ALL SELECT 'referral', id, {_NOTE}, event_id + 1 FROM now WHERE verdict = 'applied'""",
    "decision_applications": _verdict_sql(_HELD)
    + f"""SELECT row_number() OVER (ORDER BY job_id) AS id, j.company_id, job_id, '2024-02-01' AS applied_on, 'applied' AS status
        FROM verdicts v JOIN ({_JOBS}) j ON j.id = v.job_id WHERE verdict = 'applied'""",
    "decision_stream_verdicts": _verdict_sql(_HELD) + "SELECT * FROM verdicts",
    "decision_replay": _verdict_sql(_HELD)
    + "SELECT event_id, job_id, verdict, count(*) FILTER (WHERE verdict <> 'ignored') OVER (PARTITION BY event_id) AS answers FROM verdicts",
    "decision_answers": _verdict_sql(_HELD)
    + f"""SELECT event_id, 'answer' AS kind, CASE verdict {" ".join(f"WHEN '{v}' THEN {_q(t)}" for v, t in ANSWERS.items())} END AS text
        FROM verdicts WHERE verdict <> 'ignored'""",
    "job_message": f"""
        SELECT id, '🔎 <b>Feed</b> | ' || row_number() OVER (PARTITION BY company_id ORDER BY id) || ' of ' || count(*) OVER (PARTITION BY company_id) || chr(10) || chr(10)
               || concat_ws(chr(10), '🏢 <b>' || company || '</b>', '📌 ' || title, '📍 ' || CASE WHEN location = 'Site 3' THEN 'Unknown' ELSE location END,
               '🏷 ' || CASE WHEN id % 2 = 0 THEN 'Senior, ' || ats_job_id ELSE 'none' END,
               CASE WHEN link <> '' THEN '🔗 <a href="' || link || '">Apply</a>' END) AS message,
               {_KEYBOARD.format("id")} AS keyboard
        FROM ({_JOBS})""",
    "decided_message": f"SELECT id, {_decided_text('d')} AS message FROM (SELECT *, CASE WHEN company_id < 12 THEN 'applied' ELSE 'rejected' END AS d FROM ({_JOBS}))",
    "fill_template": """
        SELECT p_partkey, 'Re: ' || p_name || CASE WHEN p_size < 10 THEN ' ' || p_brand ELSE '' END || chr(10) || chr(10) || 'at ' || p_brand
               || chr(10) || chr(10) || p_partkey AS note FROM part""",
    "funnel": """
        SELECT source, count(*) AS pages, count(*) FILTER (WHERE lang = 'en') AS candidates, count(*) FILTER (WHERE lang = 'en' AND n_chars > 500) AS detailed,
               count(*) FILTER (WHERE lang = 'en' AND n_chars > 500 AND contains(text, 'with')) AS saved FROM documents GROUP BY 1""",
    "union_sources": """
        SELECT c_custkey AS id, c_name AS name, 'workday' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 'greenhouse' FROM supplier""",
    "run_summary": """
        SELECT 'workday' AS source, count(*) AS new_jobs FROM customer UNION ALL SELECT 'greenhouse', count(*) FROM supplier""",
    "run_csv": """
        SELECT c_custkey AS id, c_name AS name, 'workday' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 'greenhouse' FROM supplier""",
    "registry_csv": """
        SELECT 'Company ' || (c_custkey // 2) AS name, 'https://x.example.com/' || c_custkey AS url FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "registry_build": """
        WITH r AS (SELECT c_custkey AS line, 'Company ' || (c_custkey // 2) AS company_name,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'workday' WHEN 'MACHINERY' THEN 'greenhouse' ELSE '' END AS ats,
            CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'https://x.example.com/' || c_custkey ELSE '' END AS ats_link FROM customer),
        f AS (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY line) AS place FROM r)
        SELECT row_number() OVER (ORDER BY line)::INT AS id, company_name, ats, ats_link FROM f WHERE place = 1""",
    "registry_for": """
        SELECT c_custkey AS id, c_name AS name, 'https://x/' || c_name AS url FROM customer
        WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_acctbal <= 5000""",
    "company_id": "SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000042'",
    "rejects": """
        SELECT 'feed' AS source, company_id, 'insert' AS stage, reason, ats_job_id AS raw FROM (
            SELECT split_part(source, 'src', 2)::INT AS company_id, CASE WHEN lang <> 'de' THEN doc_id::VARCHAR END AS ats_job_id,
                   CASE WHEN lang = 'de' THEN 'null posting id' WHEN lang = 'fr' THEN 'null title'
                        WHEN length(text) > 500 OR 2 * (n_chars // 4) > 500 THEN 'value too long' END AS reason FROM documents)
        WHERE reason IS NOT NULL""",
    "ingest_boards_jobs": _BOARD_JOBS,
    "ingest_boards_outbox": _BOARD_RUN
    + f"""SELECT id AS seq, id AS job_id, md5('🔎 <b>Greenhouse</b> | ' || id || ' of ' || (SELECT count(*) FROM fresh) || chr(10) || chr(10)
               || concat_ws(chr(10), '🏢 <b>' || company || '</b>', '📌 ' || title, '📍 ' || lang,
               '🏷 ' || CASE WHEN len(positive_matches) > 0 THEN array_to_string(positive_matches, ', ') ELSE 'none' END,
               '🔗 <a href="https://b.example.com/' || job_id || '">Apply</a>')) AS text_md5, {_KEYBOARD.format("id")} AS keyboard FROM fresh""",
    "ingest_boards_rejects": _BOARD_RUN
    + f"""SELECT company_id, 'insert' AS stage, CASE WHEN ats_job_id IS NULL THEN 'null posting id' ELSE 'value too long' END AS reason, count(*) AS rows
        FROM scored WHERE score >= {_B.threshold} AND (ats_job_id IS NULL OR length(title) > 500) GROUP BY ALL""",
    "ingest_pages_jobs": _PAGE_RUN + _JOB_ROWS + " FROM fresh",
    "ingest_pages_funnel": _PAGE_RUN
    + f"""SELECT 'workday' AS source, company_id, sum(pages)::BIGINT AS pages, sum(candidates)::BIGINT AS candidates, sum(detailed)::BIGINT AS detailed,
               sum(after_title)::BIGINT AS after_title, sum(saved)::BIGINT AS saved, sum(discarded)::BIGINT AS discarded FROM (
        SELECT company_id, 1 AS pages, 0 AS candidates, 0 AS detailed, 0 AS after_title, 0 AS saved, 0 AS discarded FROM read
        UNION ALL SELECT company_id, 0, 1, detail_ok::INT, (detail_ok AND good_title)::INT, 0, (detail_ok AND good_title AND score < {_P.threshold})::INT FROM scored
        UNION ALL SELECT company_id, 0, 0, 0, 0, 1, 0 FROM fresh) GROUP BY company_id""",
    "ingest_stream_jobs": _BOARD_JOBS,
    "ingest_pages_stream_jobs": _PAGE_RUN
    + "SELECT ats_job_id, md5(title) AS title_md5, location, round(score)::INT AS relevance_score FROM fresh",
    "ingest_replay": _PAGE_RUN
    + "SELECT ats_job_id, md5(title) AS title_md5, location, round(score)::INT AS relevance_score FROM fresh",
    "ingest_pages_rejects": _PAGE_RUN.replace("FROM conversations),", "FROM conversations WHERE conv_id % 7 <> 3),", 1).replace("page_no < 20", "page_no < 3")
    + f"""SELECT company_id, stage, reason, count(*) AS rows FROM (
        SELECT conv_id::INT AS company_id, 'page' AS stage, 'unknown company' AS reason FROM conversations WHERE conv_id % 7 = 3
        UNION ALL SELECT company_id, 'page', 'not 200' FROM landed WHERE bad AND page_no < 3
        UNION ALL SELECT company_id, 'page', 'page cap reached' FROM read WHERE page_no = 2 AND len(parts) >= {fx.PAGE_LIMIT}
        UNION ALL SELECT company_id, 'detail', 'missing or empty detail' FROM scored WHERE NOT detail_ok
        UNION ALL SELECT company_id, 'insert', 'value too long' FROM passed WHERE length(s) > 500) GROUP BY ALL""",
    "ingest_both_stream_jobs": _PAGE_RUN[: _PAGE_RUN.index("held AS (")]
    + f"""turns AS (
  SELECT conv_id, turn, 'Engineer ' || conv_id || ' ' || turn AS title, md5(string_split(text, '{_BREAK}')[1]) AS ats_job_id,
         {_BOARD_TEXT} AS plain FROM conversations),
boards AS ({_scored("turns", "plain", _B, "turns.*")}),
both_sources AS (
  SELECT company_id % 3 AS batch, 0 AS source, company_id, page_no AS a, pos::BIGINT AS b, md5(s) AS ats_job_id, s AS title, score
  FROM passed WHERE length(s) <= 500
  UNION ALL SELECT (conv_id % 3)::INT, 1, (1000000 + conv_id % 20)::INT, 0, conv_id * 1000 + turn, ats_job_id, title, score
  FROM boards WHERE score >= {_B.threshold}),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY ats_job_id ORDER BY batch, source, company_id, a, b) AS place FROM both_sources)
SELECT row_number() OVER (ORDER BY batch, source, company_id, a, b) AS id, company_id, ats_job_id, md5(title) AS title_md5,
       round(score)::INT AS relevance_score FROM firsts WHERE place = 1""",
    "landed_line_rejects": f"""
        WITH t AS (SELECT conv_id, turn, {_LINE} AS line FROM conversations), d AS (SELECT doc_id, {_LINE} AS line FROM documents)
        SELECT source, stage, 'unreadable line' AS reason, md5(raw) AS raw_md5, true AS in_folder FROM (
            SELECT 'workday' AS source, 'page' AS stage, '{{"status_code":200,"page_no":' || turn || ',"body":{{"jobPostings":[{{"externalPath":"' || line AS raw FROM t
            UNION ALL SELECT 'workday', 'page', '{{"company_id":"c' || conv_id || '","page_no":' || turn || '}}' FROM t
            UNION ALL SELECT 'greenhouse', 'board', '{{"status_code":200,"company_id":' || doc_id || ',"body":"' || line FROM d
            UNION ALL SELECT 'greenhouse', 'detail', '{{"status_code":200,"job_id":' || doc_id || ',"body":{{"content":"' || line FROM d
            UNION ALL SELECT 'decisions', 'event', '{{"callback_query":{{"id":"' || event_id || '","data":"' || coalesce(event_type, '') FROM events)""",
}
