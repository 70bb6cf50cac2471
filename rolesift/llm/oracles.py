"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import zlib

from rolesift.llm import licenses

ORACLES: dict[str, str] = {}

ORACLES["op7_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t
  WINDOW w AS (PARTITION BY norm)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLES["op10_url_filter"] = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), h AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM p LEFT JOIN h ON h.page_id IS NOT DISTINCT FROM p.page_id AND h.host = p.host AND h.path = p.path AND h.k = 1
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op5_decontamination"] = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark
), bs AS (
  SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM bs
), sizes AS (
  SELECT DISTINCT n FROM win
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, i, g.n, item FROM grams g JOIN win USING (n, phrase)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


def _normal(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = f"regexp_replace({lower}, '{licenses.NOT_PLAIN}', ' ', 'g')"
    return f"replace(regexp_replace({plain}, '{licenses.EDGES}', '', 'g'), 'licence', 'license')"


def _license_sql() -> str:
    """One table expression per rule, each on what the rules before it have left."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(s)})" for i, s in licenses.SENTENCES)
    steps = []
    for k, (name, ids) in enumerate(licenses.RULES):
        run = quoted("".join(f",{i}," for i in ids))
        steps.append(
            f"r{k + 1} AS (SELECT * REPLACE (replace(rest, {run}, ',-,') AS rest, "
            f"CASE WHEN contains(rest, {run}) AND NOT list_contains(names, {quoted(name)}) "
            f"THEN list_append(names, {quoted(name)}) ELSE names END AS names) FROM r{k})"
        )
    return rf"""
WITH known AS (
  SELECT DISTINCT id, {_normal("s")} AS s FROM (VALUES {known}) v(id, s)
), parts AS (
  SELECT r, doc_id, [x FOR x IN string_split(regexp_replace(regexp_replace(coalesce(text, ''),
    '{licenses.STOP}', '\1' || chr(30), 'g'), '{licenses.BLANK}', chr(30), 'g'), chr(30)) IF length(trim(x)) > 0] AS ss
  FROM (SELECT *, row_number() OVER () AS r FROM documents)
), one AS (
  SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM parts
), whole AS (
  SELECT r, i, one.s, id FROM one LEFT JOIN known ON {_normal("one.s")} = known.s
), lines AS (
  SELECT r, i, j, coalesce(known.id, '-') AS id
  FROM (SELECT r, i, unnest(string_split(s, chr(10))) AS l, generate_subscripts(string_split(s, chr(10)), 1) AS j
        FROM whole WHERE id IS NULL) LEFT JOIN known ON {_normal("l")} = known.s
), seq AS (
  SELECT r, list(id ORDER BY i, j) AS ids FROM (
    SELECT r, i, 1 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT r, i, j, id FROM lines
  ) GROUP BY r
), r0 AS (
  SELECT doc_id, len(ss) AS n_sentences, coalesce([x FOR x IN ids IF x <> '-'], []) AS known_ids,
    regexp_replace(',' || array_to_string(ids, ',,') || ',', '(,-,)+', ',-,', 'g') AS rest, CAST([] AS VARCHAR[]) AS names
  FROM parts LEFT JOIN seq USING (r)
), {", ".join(steps)}
SELECT doc_id, n_sentences, array_to_string(known_ids, ',') AS sentence_ids,
  array_to_string(names, ',') AS licenses, names[1] AS license FROM r{len(licenses.RULES)}
"""


ORACLES["op9_license_scan"] = _license_sql()

ORACLES["op3_warc_bundles"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)
    FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

ORACLES["op11_filter_audit"] = r"""
WITH marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt FROM documents
), w AS (
  SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY txt) AS first_id FROM t
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
      + 4 * CAST(100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 3 * length(txt) AS INT)
      + 8 * CAST(regexp_matches(txt, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first_id, false) AS INT) AS failed
  FROM w LEFT JOIN marks USING (doc_id)
), c AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed
), letters(x, b) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t WHERE (p.b | q.b | r.b | s.b | t.b) = 31
), steps AS (
  SELECT filter_order, step, x, b, list_sum([1 << strpos('ABCDE', filter_order[k]) >> 1 FOR k IN range(1, step)]) AS e
  FROM orders, range(1, 6) v(step), letters WHERE filter_order[step] = x
)
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(sum(CASE WHEN failed & (b | coalesce(e, 0)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN failed & b > 0 AND failed & coalesce(e, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN failed & b > 0 AND failed & coalesce(e, 0) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN failed = b THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN failed & b > 0 AND failed & coalesce(e, 0) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN failed & b > 0 AND failed & coalesce(e, 0) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN failed & b > 0 THEN n * 120 // bit_count(failed) ELSE 0 END) AS BIGINT) AS shapley
FROM c, steps GROUP BY part, filter_order, step
"""


def _crc_table() -> list[int]:
    """The crc32 remainder of each byte, from the crc32 of one byte."""
    # crc32(b) = T[0xFF ^ b] ^ 0x00FFFFFF ^ 0xFFFFFFFF
    return [zlib.crc32(bytes([0xFF ^ b])) ^ 0xFF000000 for b in range(256)]


ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), once AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) > 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || b AS BIGINT) FOR b IN
    regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..')]),
    lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]))) AS h FROM once
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
      ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), near AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY word
), best AS (
  SELECT near.word, n_near, best_n, min(other) AS best FROM near JOIN pairs ON pairs.word = near.word AND pairs.n = best_n GROUP BY ALL
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * words.n THEN best END AS form,
    CASE WHEN best_n >= 10 * words.n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT walk.word, form, k + 1 FROM walk JOIN forms ON forms.word = walk.root WHERE form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(root, k) FROM walk WHERE walk.word = forms.word) AS root, n, n_near, form_n FROM forms
"""
