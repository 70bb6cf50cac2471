"""Operators on hand-worked rows, and properties under skew, order and replay."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.operators import decisions, learner, merge, numbering, ordered, pages, scoring
from rolesift.operators.joins import join_details, many_to_one
from rolesift.rules import RuleSet


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, t string")


def scores(df):
    return {r.id: r.score for r in df.collect()}


# ---- Scoring ----


def test_score_examples(spark):
    df = texts(spark, "java kafka react senior", "sales marketing", "", None, "5-7 years", "12+ years")
    got = {r.id: r for r in scoring.relevance(df, "t", RuleSet()).collect()}
    assert [got[i].score for i in range(6)] == [5, 0, 0, 0, 3, 3]
    assert got[0].positive_matches == ["java", "kafka"] and got[0].negative_matches == ["react"]
    assert got[2].positive_matches == [] and got[3].experience_matches == []
    assert got[4].experience_matches == ["7 years"] and got[5].experience_matches == ["12+ years"]


def test_multipliers_apply_to_keywords_only(spark):
    df = texts(spark, "java kafka react senior", "java")
    learned = spark.createDataFrame([("kafka", 2.0), ("unlisted", 9.0), ("java", 1.3)], "keyword string, multiplier float")
    assert scores(scoring.relevance(df, "t", RuleSet(), learned)) == pytest.approx({0: 8.6, 1: 2.6})
    none = spark.createDataFrame([], schemas.OVERRIDES)
    assert scores(scoring.relevance(df, "t", RuleSet(), none)) == {0: 5, 1: 2}


@pytest.mark.parametrize(
    ("text", "keywords", "found"),
    [
        ("google scalability", ["go", "scala"], []),
        ("generative ai agents", ["generative ai", "ai agents"], ["generative ai", "ai agents"]),
        ("ci/cd, fine-tuning.", ["ci/cd", "fine-tuning", "cd"], ["ci/cd", "fine-tuning", "cd"]),
        ("élan lané_x", ["lan", "lané", "élan"], ["élan"]),
        ("c++x c++", ["c++"], ["c++"]),
        ("c++ only", ["c++"], []),
        ("a.net", [".net"], [".net"]),
    ],
)
def test_whole_words(spark, text, keywords, found):
    row = texts(spark, text).select(scoring.match_keywords(F.col("t"), keywords).alias("m")).collect()[0]
    assert row.m == found
    assert found == [k for k in keywords if re.search(r"\b" + re.escape(k) + r"\b", text)]


def test_score_filter_does_not_repeat_the_matching(spark):
    df = scoring.score_filter(scoring.relevance(texts(spark, "java"), "t", RuleSet()), 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("Contains(" in line or "RLIKE" in line for line in filters)


def test_score_is_monotone_in_positive_weights(spark):
    df = texts(spark, "java api rest", "java", "rest react")
    low, high = (scores(scoring.relevance(df, "t", RuleSet(positive=(("java", w), ("rest", 3))))) for w in (1, 4))
    assert all(high[i] >= low[i] for i in low)


def test_keyword_table_equals_brute_force(spark):
    random.seed(7)
    words = ["ai", "agents", "ci", "cd", "go", "é", "x1"]
    keywords = ["ai agents", "ci/cd", "go", "é", "ai  agents", "go, go", "x1 go ai"]
    rows = ["".join(random.choice(words) + random.choice([" ", "/", ", ", "  ", "-"]) for _ in range(12)) for _ in range(40)]
    df, table = texts(spark, *rows), spark.createDataFrame([(k,) for k in keywords], "keyword string")
    got = {(r.id, r.keyword) for r in scoring.match_keyword_table(df, "id", "t", table, 3).collect()}
    want = {(i, k) for i, t in enumerate(rows) for k in keywords if re.search(r"\b" + re.escape(k) + r"\b", t)}
    assert got == want and want


def test_threshold_comes_before_rounding(spark):
    df = spark.createDataFrame([(1, 19.6), (2, 20.0), (3, 20.5)], "id int, score double")
    kept = scoring.score_filter(df, 20).select("id", scoring.stored_score(F.col("score")).alias("s")).collect()
    assert {r.id: r.s for r in kept} == {2: 20, 3: 21}


# ---- Ordered ----


def test_numbers_are_dense_over_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(3000)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = numbering.number_messages(df, ["x"], ["g"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append((r.i, r.x, r.n))
    assert len(got) == len(rows)
    for members in by_group.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1] for m in members] == sorted(m[1] for m in members)
        assert {m[2] for m in members} == {len(members)}


def test_ids_go_on_from_start_and_survive_an_empty_batch(spark):
    df = spark.range(1000).withColumn("k", 999 - F.col("id")).drop("id").repartition(5)
    got = {r.k: r.id for r in numbering.assign_ids(df, ["k"], F.lit(10)).collect()}
    assert got == {k: k + 11 for k in range(1000)}
    assert numbering.assign_ids(df.filter("k < 0"), ["k"]).count() == 0


def test_first_per_key_cuts_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    first = ordered.first_per_key(df, ["k"], ["o"])
    assert {r.v for r in first.collect()} == {"a", "c"}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[.*Partial", plan)


# ---- Joins ----


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_many_to_one_is_whole_on_both_paths(spark, how):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 > 0, F.col("id") % 2500).alias("k"), "id"
    )
    dim = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    want = rows.join(dim, ["k"], how)
    for limit in (1 << 40, 0):
        got = many_to_one(rows, dim, ["k"], how, broadcast_bytes=limit)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("kept", [900, 3])
def test_join_details_chooses_alike_on_both_paths(spark, tmp_path, kept):
    path = str(tmp_path / "details")
    landed = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 11 > 0, F.col("id") % 1300).alias("k"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 4).alias("place"),
        F.concat(F.lit("body "), (F.col("id") % 6).cast("string")).alias("body"),
        F.col("id").alias("note"),
    )
    landed.unionByName(landed).repartition(3).write.json(path)
    details = spark.read.schema("k long, place long, body string, note long").json(path)
    postings = spark.range(0, 2 * kept, 2).select(F.col("id").alias("k"), F.col("id").alias("note"))
    order = ["place", F.md5("body"), "note"]
    want = ordered.first_per_key(details, ["k"], order).join(postings.drop("note"), "k").collect()
    want = sorted((r.k, r.k, r.place, r.body, r.note) for r in want)
    for limit in (1 << 40, 0):
        got = join_details(postings, details, ["k"], order, broadcast_bytes=limit)
        assert got.columns == ["k", "note", "place", "body", "note"]
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation \[[^]]*\] json", plan)) == 1
    empty = join_details(postings.limit(0), details, ["k"], order, broadcast_bytes=0)
    assert empty.columns == ["k", "note", "place", "body", "note"] and empty.collect() == []
    assert join_details(postings, details.limit(0), ["k"], order, broadcast_bytes=0).collect() == []


# ---- Pages ----


def stop_pages(spark, spec, **kwargs):
    rows = [(1, n, size, 20, bad) for n, size, bad in spec]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "company_id int, page_no int, size int, limit int, bad boolean").repartition(3)
    return sorted(r.page_no for r in pages.pages_until_stop(df, **kwargs).collect())


@pytest.mark.parametrize(
    ("spec", "read"),
    [
        ([(0, 20, False), (1, 20, False), (2, 7, False), (3, 20, False)], [0, 1, 2]),
        ([(0, 20, False), (1, 20, True), (2, 20, False)], [0]),
        ([(n, 20, False) for n in range(25)], list(range(20))),
        ([(0, 20, False), (2, 20, False)], [0]),
        ([(0, 20, False), (1, 0, False), (2, 20, False)], [0]),
        ([(1, 20, False)], []),
        ([(0, 20, True)], []),
    ],
)
def test_page_stop(spark, spec, read):
    assert stop_pages(spark, spec) == read


# ---- Merges ----


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, company_id int, ats_job_id string")


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "company_id int, ats_job_id string, pos int")


def test_insert_new(spark):
    target = jobs(spark, (7, 1, "A"))
    rows = batch(spark, (1, "A", 0), (2, "B", 0), (1, "B", 1), (1, "", 2), (3, "", 0), (1, None, 5))
    inserted, new_target = merge.insert_new(target, rows, ["ats_job_id"], ["company_id", "pos"])
    assert sorted(map(tuple, inserted.collect())) == [(8, 1, "B"), (9, 1, "")]
    assert new_target.count() == 3
    again, _ = merge.insert_new(new_target, rows, ["ats_job_id"], ["company_id", "pos"])
    assert again.count() == 0


def test_insert_new_ignoring_case(spark):
    inserted, _ = merge.insert_new(
        jobs(spark, (1, 1, "abc")), batch(spark, (1, "ABC", 0), (1, "x", 1), (1, "X", 2)),
        ["ats_job_id"], ["pos"], collation="UTF8_LCASE",
    )
    assert [tuple(r) for r in inserted.collect()] == [(2, 1, "x")]


def test_upsert_replaces_keeps_and_inserts(spark):
    old = spark.createDataFrame(
        [("a", 1.5, 1, 1, 2, 1.5, None), ("b", 0.5, 0, 3, 3, 0.5, None), ("same", 1.0, 1, 2, 3, 1.0, None)],
        schemas.OVERRIDES,
    )
    new = spark.createDataFrame(
        [("b", 2.0, 5, 1, 6, 2.2), ("c", 1.0, 1, 2, 3, 1.0), ("same", 1.0, 1, 2, 3, 1.0)],
        "keyword string, multiplier double, accept_count bigint, reject_count bigint, sample_count bigint, lift double",
    )
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    got = {r.keyword: r for r in merge.upsert(old, new, ["keyword"], learner.MEASURES, "updated_at", now).collect()}
    assert set(got) == {"a", "b", "c", "same"}
    assert (got["a"].multiplier, got["b"].multiplier, got["b"].sample_count) == (1.5, 2.0, 6)
    assert got["a"].updated_at is None and got["same"].updated_at is None
    assert got["b"].updated_at is not None and got["c"].updated_at is not None


def test_delete_cascade(spark):
    parent = jobs(spark, (1, 1, "TEST-1"), (2, 1, "R2"), (3, 1, None))
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, job_id bigint")
    left, counts = merge.delete_where(
        parent, F.col("ats_job_id").like("TEST-%"), "id", {"analysis": (child, "job_id"), "status": (child, "job_id")}
    )
    assert {r.table: r.deleted for r in counts.collect()} == {"parent": 1, "analysis": 1, "status": 1}
    assert {r.id for r in left["parent"].collect()} == {2, 3}
    assert {r.id for r in left["analysis"].collect()} == {2, 3}


# ---- Learner ----


@pytest.mark.parametrize(
    ("lift", "multiplier"), [(1.3, 1.0), (2.0, 1.5), (5.0, 2.0), (0.7, 1.0), (0.5, 0.5), (0.1, 0.25), (0.0, 0.25)]
)
def test_lift_multiplier(one, lift, multiplier):
    assert one(learner.lift_multiplier, lift) == pytest.approx(multiplier)


def decided(spark, rows):
    return spark.createDataFrame(rows, "user_decision string, positive_matches string, negative_matches string")


def test_recalibrate(spark):
    rows = [("applied", '["a"]', "[]")] * 4 + [("rejected", '["b"]', '["n"]')] * 5 + [("rejected", "bad", '["a","rare"]')]
    old = spark.createDataFrame([("rare", 1.7, 1, 1, 2, 1.7, None)], schemas.OVERRIDES)
    table, adjusted = learner.recalibrate(
        learner.decode_matches(decided(spark, rows)), old, F.current_timestamp()
    )
    got = {r.keyword: r for r in table.collect()}
    assert got["a"].accept_count == 4 and got["a"].reject_count == 1
    assert got["a"].multiplier == pytest.approx(1.5) and got["a"].lift == pytest.approx(2.0)
    assert got["b"].multiplier == 0.25 and got["n"].multiplier == 0.25
    assert got["rare"].multiplier == pytest.approx(1.7)
    assert {r.keyword for r in adjusted.collect()} == {"a", "b", "n"}


@pytest.mark.parametrize("accepted", [0, 9])
def test_recalibrate_gates(spark, accepted):
    total = 9 if accepted else 10
    rows = [("applied" if i < accepted else "rejected", '["a"]', "[]") for i in range(total)]
    assert learner.keyword_lift(learner.decode_matches(decided(spark, rows))).count() == 0


# ---- Decisions ----


CALLBACK = "struct<id: string, data: string, message: struct<message_id: bigint>>"


def events(spark, *data):
    rows = [(i, (f"c{i}", text, (i + 1,))) for i, text in enumerate(data)]
    df = spark.createDataFrame(rows, f"received_at int, callback_query {CALLBACK}")
    return decisions.parse_decision(df)


def test_parse_decision(spark):
    data = ["apply:12", "apply:1:2", "like:1", "apply:x", None, "", "apply", "reject: 7 ", "apply:"]
    got = {int(r.callback_id[1:]): (r.verdict, r.job_id) for r in events(spark, *data).collect()}
    assert [got[i][0] for i in range(9)] == [
        "ok", "invalid_id", "unknown_action", "invalid_id", "invalid_request", "invalid_request",
        "unknown_action", "ok", "invalid_id",
    ]
    assert got[0][1] == 12 and got[7][1] == 7 and got[1][1] is None
    other = spark.createDataFrame([(1, None)], f"received_at int, callback_query {CALLBACK}")
    assert decisions.parse_decision(other).collect()[0].verdict == "ignored"


def test_first_decision_wins(spark):
    known = spark.createDataFrame([(1, None), (2, "rejected")], "job_id bigint, decision string")
    got = decisions.decide(
        events(spark, "apply:1", "reject:1", "apply:2", "apply:3", "like:1"), known, ["received_at", "callback_id"]
    )
    assert [r.verdict for r in got.orderBy("received_at").collect()] == [
        "applied", "already_applied", "already_rejected", "job_not_found", "unknown_action",
    ]
    assert [tuple(r)[:2] for r in decisions.new_decisions(got).collect()] == [(1, "applied")]


def test_fixed_values():
    assert len(rules.TITLE_EXCLUDE) == len(set(rules.TITLE_EXCLUDE)) == 103
    assert (len(rules.POSITIVE), len(rules.NEGATIVE), len(rules.LOCATIONS)) == (49, 19, 13)


def test_first_match_per_pattern(spark):
    found = scoring.match_patterns(F.col("t"), [p for p, _ in rules.PATTERNS])
    row = texts(spark, "7+ YEARS or 12 years, senior").select(found.alias("m")).collect()[0]
    assert row.m == ["7+ YEARS", "12 years", "senior"]


def test_unstage_drops_the_table_only(spark):
    from rolesift.session import stage, unstage

    one, two = stage(spark.range(5), "one"), stage(spark.range(3), "two")
    folder = one.inputFiles()[0].rsplit("/", 1)[0]
    unstage(one)
    assert two.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder).count()


def test_updates_say_which_of_them_match(spark):
    jobs = spark.createDataFrame([(1, None), (2, "applied"), (None, None)], "id long, user_decision string")
    new = spark.createDataFrame([(2, "rejected"), (5, "applied"), (None, "applied")], "job_id long, decision string")
    got = {r.job_id: r.matched for r in merge.decisions_matched(jobs, new).collect()}
    assert got == {2: True, 5: False, None: False}
    assert merge.decisions_matched(jobs, new.limit(0)).count() == 0 and merge.decisions_matched(jobs.limit(0), new).filter("matched").count() == 0


def test_job_by_id(spark):
    from rolesift.operators.joins import job_by_id

    jobs = spark.createDataFrame([(1, 10, "a"), (2, 99, "b"), (3, None, "c")], "id long, company_id int, title string")
    companies = spark.createDataFrame([(10, "Ace")], "id int, company_name string")
    rows = {n: [tuple(r) for r in job_by_id(jobs, companies, n).collect()] for n in (1, 2, 3, 4)}
    assert rows == {1: [(1, 10, "a", "Ace")], 2: [(2, 99, "b", None)], 3: [(3, None, "c", None)], 4: []}
    plan = job_by_id(jobs, companies, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan


def test_match_keyword_phrases(spark):
    """Against `word_pattern` itself on every pair of text and keyword."""
    texts = [
        (1, "c++ and c++x, asp.net or .net; a b a b c"), (2, "net"), (3, ""), (4, None), (5, "a\n- b c++"),
        (None, "c--d a b"), (7, "a b c d e f g h"), (7, "b c d"), (8, "été d'été, x"), (9, "-- a -- b --"), (10, "a " * 300 + "b"),
    ]
    words = [
        "c++", ".net", "net", "a b", "b a b", "a b c d e f g h", "a\n- b", "--", " -- ", "été", "d'été", "c", "++x", "", None,
        "a b", "x y", "nowhere", ", ", "asp.net or .net", "a a a a a a a b", "net;", ".", "e f ",
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = scoring.match_keyword_phrases(df, "doc_id", "text", table).collect()
    pairs = df.select("doc_id", scoring.match_keywords(F.coalesce("text", F.lit("")), sorted({w for w in words if w})).alias("k"))
    want = {(r.doc_id, k) for r in pairs.collect() for k in r.k}
    assert len(got) == len(want) and {(r.doc_id, r.keyword) for r in got} == want
    assert scoring.match_keyword_phrases(df, "doc_id", "text", table.limit(0)).collect() == []
    assert scoring.match_keyword_phrases(df.limit(0), "doc_id", "text", table).collect() == []


def test_match_keyword_phrases_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    found = scoring.match_keyword_phrases(df, "doc_id", "text", spark.createDataFrame([("b c",)], "keyword string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in plan
