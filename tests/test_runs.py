"""Whole runs on small landed files: both sources, the streams, replay, recalibration."""

import json
import re
import subprocess
import sys
import time
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rolesift import rules as fixed
from rolesift import schemas
from rolesift.plans.ingest import IngestResult, combine, ingest_boards, ingest_pages
from rolesift.plans.recalibrate import run_recalibration
from rolesift.rules import RuleSet
from rolesift.session import shared_dir
from rolesift.sources import landed, registry, tables
from rolesift.streaming.decisions import apply_batch, decision_stream
from rolesift.streaming.ingest import Feed, ingest_feeds, ingest_stream

STRONG = "<p>java python kafka aws docker sql redis api rest senior backend</p>"
NOW = "2024-01-02 00:00:00+00:00"


def land(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    return str(folder)


def posting(path, posted="Posted Today", place="Pune, India"):
    return {"externalPath": path, "postedOn": posted, "locationsText": place}


def page(company, number, postings, status=200, body=None):
    return {
        "company_id": company, "page_no": number, "offset": 3 * number, "limit": 3,
        "status_code": status, "body": body if body is not None else {"jobPostings": postings},
    }


def detail(company, path, title="Senior Software Engineer", req=None, text=STRONG, status=200, **extra):
    info = {"title": title, "jobReqId": req or f"R{path}", "location": "Pune", "jobDescription": text, **extra}
    return {"company_id": company, "external_path": path, "status_code": status, "body": {"jobPostingInfo": info}}


@pytest.fixture
def paged(spark, tmp_path):
    pages = land(tmp_path / "pages", "p.json", [
        page(1, 0, [posting("/a"), posting("/b", "Posted 5 Days Ago"), posting("/c", place="Oslo")]),
        page(1, 1, [posting("/a"), posting("/d"), posting("/weak")]),
        page(1, 2, [posting("/e")]),
        page(1, 3, [posting("/never")]),
        page(2, 0, [posting("/f"), posting("/lost"), posting("/long")]),
        page(2, 1, [], body="not json"),
        page(2, 2, [posting("/never")]),
        page(3, 0, [posting("/x")], status=500),
    ])
    details = land(tmp_path / "details", "d.json", [
        detail(1, "/a"), detail(1, "/a"), detail(1, "/d", title="Data Engineer"),
        detail(1, "/weak", text="java"), detail(1, "/e", req="R/f"),
        detail(2, "/f"), detail(2, "/lost", status=404), detail(2, "/long", title="Senior " + "x" * 600),
        detail(1, "/never"), detail(2, "/never"),
    ])
    companies = spark.createDataFrame(
        [(1, "Acme", "https://acme.example.com/en-US/jobs"), (2, "Bolt", "https://bolt.example.com/b/x/y"),
         (3, "Cog", "https://cog.example.com/c"), (4, "Dud", "https://dud.example.com/en-US")],
        "id int, name string, url string",
    )
    return pages, details, companies


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_paged_source(spark, paged):
    pages, details, companies = paged
    run = ingest_pages(
        landed.read_pages(spark, pages), landed.read_details(spark, details, fixed.SOURCE_A), companies,
        empty(spark, schemas.JOB_INFO), empty(spark, schemas.JOB_ANALYSIS), F.to_timestamp(F.lit(NOW)),
    )
    jobs = {r.ats_job_id: r for r in run.jobs.collect()}
    assert set(jobs) == {"R/a", "R/f"}
    assert (jobs["R/a"].id, jobs["R/f"].id) == (1, 2)
    assert jobs["R/f"].company_id == 1, "the key is global, so the earlier company keeps it"
    assert jobs["R/a"].application_link == "https://acme.example.com/en-US/jobs/a"
    analysis = {r.job_id: r for r in run.analysis.collect()}
    assert analysis[1].relevance_score == 26
    assert json.loads(analysis[1].positive_matches)[:2] == ["java", "python"]
    outbox = {r.job_id: r for r in run.outbox.collect()}
    assert outbox[1].text.startswith("🔎 <b>Workday</b> | 1 of 2\n\n🏢 <b>Acme</b>")
    reasons = sorted((r.company_id, r.stage, r.reason) for r in run.rejects.collect())
    assert reasons == [
        (2, "detail", "missing or empty detail"), (2, "insert", "value too long"),
        (2, "page", "unreadable body"), (3, "page", "not 200"), (4, "company", "no path segment in url"),
    ]
    funnel = {r.company_id: r for r in run.funnel.collect()}
    assert tuple(funnel[1])[2:] == (3, 4, 4, 3, 2, 1)
    assert tuple(funnel[2])[2:] == (1, 3, 2, 2, 0, 0)


def board_job(ident, title="Senior Backend Engineer", updated="2024-01-01T12:00:00Z", place="Pune", **extra):
    return {"id": ident, "title": title, "updated_at": updated, "location": {"name": place}, **extra}


def board_detail(company, ident, **body):
    full = {"title": "Senior Backend Engineer", "updated_at": "u", "content": STRONG, "absolute_url": f"https://b/{ident}",
            "location": {"name": "Pune"}, **body}
    return {"company_id": company, "job_id": ident, "status_code": 200, "body": full}


@pytest.fixture
def board(spark, tmp_path):
    boards = land(tmp_path / "boards", "b1.json", [
        {"company_id": 1, "status_code": 200, "body": {"jobs": [
            board_job(1), board_job(2), board_job(3, place="Remote", offices=[{"location": {"name": "Delhi"}}]),
            board_job(4, updated="2023-12-30T00:00:00Z"), board_job(5, title="Sales Engineer"), board_job(6, place="Oslo"),
            board_job(7), board_job(8, title=None), board_job(9)]}},
        {"company_id": 2, "status_code": 404, "body": "gone"},
        {"company_id": 3, "status_code": 500, "body": "broken"},
        {"company_id": 4, "status_code": 200, "body": "{broken"},
    ])
    no_place = board_detail(1, 9, requisition_id="REQ-9")
    del no_place["body"]["location"]
    details = land(tmp_path / "board_details", "d.json", [
        board_detail(1, 1), board_detail(1, 2, requisition_id="REQ-2"), board_detail(1, 3, requisition_id=None),
        board_detail(1, 4), board_detail(1, 5), board_detail(1, 6),
        {"company_id": 1, "job_id": 7, "status_code": 200, "body": {}}, no_place,
    ])
    companies = spark.createDataFrame(
        [(n, f"C{n}", f"https://b.example.com/boards/c{n}") for n in range(1, 5)], "id int, name string, url string"
    )
    return boards, details, companies


def test_board_source(spark, board):
    boards, details, companies = board
    now = F.to_timestamp(F.lit(NOW))
    run = ingest_boards(
        landed.read_boards(spark, boards), landed.read_details(spark, details, fixed.SOURCE_B), companies,
        empty(spark, schemas.JOB_INFO), empty(spark, schemas.JOB_ANALYSIS), now, now,
    )
    got = {r.ats_job_id: (r.id, r.location) for r in run.jobs.collect()}
    assert got == {"1": (1, "Pune"), "REQ-2": (2, "Pune"), "REQ-9": (3, "Unknown")}
    reasons = sorted((r.company_id, r.stage, r.reason) for r in run.rejects.collect())
    assert reasons == [
        (1, "detail", "missing or empty detail"), (1, "insert", "null posting id"), (1, "title", "null title"),
        (3, "board", "not 200"), (4, "board", "unreadable body"),
    ]


def test_stream_adds_only_unseen_postings_and_replays_alike(spark, board, tmp_path):
    boards, details, companies = board
    root, offsets = str(tmp_path / "state"), str(tmp_path / "offsets")

    def cycle(checkpoint=offsets):
        ingest_stream(
            spark, boards, details, companies, root, checkpoint, fixed.SOURCE_B, as_of=NOW
        ).awaitTermination()
        return sorted((r.id, r.ats_job_id) for r in tables.read_table(spark, root, "job_info", schemas.JOB_INFO).collect())

    first = cycle()
    assert first == [(1, "1"), (2, "REQ-2"), (3, "REQ-9")]
    land(tmp_path / "boards", "b2.json", [{"company_id": 1, "status_code": 200, "body": {"jobs": [board_job(1), board_job(20)]}}])
    land(tmp_path / "board_details", "d2.json", [board_detail(1, 20)])
    second = cycle()
    assert second == [*first, (4, "20")]
    assert cycle() == second, "no new files, no new rows"
    assert cycle(str(tmp_path / "offsets2")) == second, "a new checkpoint reads all files again and adds nothing"
    folders = {p.name for p in (tmp_path / "state" / "job_info").iterdir() if p.is_dir()}
    assert len(folders) == 2 and not any("None" in f for f in folders)
    messages = tables.read_table(spark, root, "outbox", schemas.OUTBOX)
    assert messages.count() == messages.select("job_id").distinct().count() == 4


def seed_jobs(spark, root):
    rows = [(i, 1, f"R{i}", "Senior Engineer", "Pune", "https://l", None, None) for i in (1, 2, 3)]
    tables.append_batch(spark.createDataFrame(rows, schemas.JOB_INFO), root, "job_info", "seed", 0)
    return spark.createDataFrame([(1, "Acme", "", "", "", "")], schemas.COMPANY_INFO)


def event(second, data, ident="c"):
    return {"received_at": f"2024-01-01T00:00:{second:02d}Z",
            "callback_query": {"id": f"{ident}{second}", "data": data, "message": {"message_id": 100 + second}}}


def read(spark, root, table, schema):
    return tables.read_table(spark, root, table, schema)


def test_decision_stream(spark, tmp_path):
    root, offsets = str(tmp_path / "state"), str(tmp_path / "offsets")
    companies = seed_jobs(spark, root)
    folder = land(tmp_path / "events", "e1.json", [
        event(1, "apply:1"), event(2, "reject:1"), event(3, "reject:2"), event(4, "apply:9"), event(5, "oops"),
    ])
    staged = Path(shared_dir(spark)) / spark.sparkContext.applicationId
    before = set(staged.iterdir()) if staged.exists() else set()
    decision_stream(spark, folder, companies, root, offsets, as_of=NOW).awaitTermination()
    assert (set(staged.iterdir()) if staged.exists() else set()) == before, "a batch leaves no staged table"
    land(tmp_path / "events", "e2.json", [event(6, "apply:2"), event(7, "apply:3"), event(7, "apply:3")])
    decision_stream(spark, folder, companies, root, offsets, as_of=NOW).awaitTermination()
    verdicts = sorted((r.callback_id, r.verdict) for r in read(spark, root, "verdicts", schemas.VERDICTS).collect())
    assert verdicts == [
        ("c1", "applied"), ("c2", "already_applied"), ("c3", "rejected"), ("c4", "job_not_found"),
        ("c5", "unknown_action"), ("c6", "already_rejected"), ("c7", "already_applied"), ("c7", "applied"),
    ]
    applied = [(r.id, r.job_id, r.applied_on, r.status) for r in read(spark, root, "application_status", schemas.APPLICATION_STATUS).collect()]
    assert sorted(applied) == [(1, 1, "2024-01-02", "applied"), (2, 3, "2024-01-02", "applied")]
    sent = read(spark, root, "outbox", schemas.OUTBOX).collect()
    outbox = sorted((r.job_id, r.kind, r.reply_to) for r in sent if r.kind != "answer")
    assert sorted((r.keyboard, r.text) for r in sent if r.kind == "answer") == [
        ("c1", "Applied ✅"), ("c2", "Already marked as applied"), ("c3", "Rejected ❌"), ("c4", "Job not found"),
        ("c5", "Unknown action"), ("c6", "Already marked as rejected"), ("c7", "Already marked as applied"), ("c7", "Applied ✅"),
    ]
    assert outbox == [(1, "edit", 101), (1, "referral", 101), (2, "edit", 103), (3, "edit", 107), (3, "referral", 107)]
    assert {r.id: r.user_decision for r in tables.current_jobs(spark, root).collect()} == {1: "applied", 2: "rejected", 3: "applied"}


def test_decision_batch_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "state")
    companies = seed_jobs(spark, root)
    folder = land(tmp_path / "events", "e.json", [event(1, "apply:1"), event(2, "apply:2"), event(3, "reject:1")])
    events = landed.read_decisions(spark, folder)

    def state():
        return [
            sorted(map(str, read(spark, root, name, schema).collect()))
            for name, schema in (("verdicts", schemas.VERDICTS), ("decisions", schemas.DECISIONS),
                                 ("application_status", schemas.APPLICATION_STATUS), ("outbox", schemas.OUTBOX))
        ]

    apply_batch(spark, events, companies, root, "w", 0, NOW)
    before = state()
    apply_batch(spark, events, companies, root, "w", 0, NOW)
    assert state() == before
    apply_batch(spark, events, companies, root, "w", 1, NOW)
    assert len(read(spark, root, "decisions", schemas.DECISIONS).collect()) == 2


def test_recalibration_feeds_the_next_score(spark, tmp_path):
    root = str(tmp_path / "state")
    rows = [(i, 1, f"R{i}", "t", "l", "u", None, None) for i in range(12)]
    analysis = [(i, i, 30, '["kafka"]' if i < 4 else '["java"]', "[]", "[]", None) for i in range(12)]
    decided = [(i, "applied" if i < 4 else "rejected") for i in range(12)]
    tables.append_batch(spark.createDataFrame(rows, schemas.JOB_INFO), root, "job_info", "seed", 0)
    tables.append_batch(spark.createDataFrame(analysis, schemas.JOB_ANALYSIS), root, "job_analysis", "seed", 0)
    tables.append_batch(spark.createDataFrame(decided, schemas.DECISIONS), root, "decisions", "seed", 0)
    assert tables.read_overrides(spark, root).count() == 0
    adjusted = run_recalibration(spark, root, 1, F.current_timestamp())
    assert {r.keyword: r.multiplier for r in adjusted.collect()} == {"kafka": 2.0, "java": 0.25}
    run_recalibration(spark, root, 2, F.current_timestamp())
    assert {r.keyword: r.multiplier for r in tables.read_overrides(spark, root).collect()} == {"kafka": 2.0, "java": 0.25}


def test_registry_from_csv(spark, tmp_path):
    path = tmp_path / "companies.csv"
    path.write_text(
        "﻿Company Name,Workday Carrer Page,Greenhouse Carrer Page,,,,\n"
        "Zed, https://z.example.com/z ,,,,,\nAce,,https://b.example.com/boards/ace,,,,\nNone,,,,,,\nZed,,https://other,,,,\n",
        encoding="utf-8",
    )
    table = registry.build_registry(registry.scan_csv(spark, str(path)))
    got = [(r.id, r.company_name, r.ats, r.ats_link) for r in table.orderBy("id").collect()]
    assert got == [
        (1, "Zed", "workday", "https://z.example.com/z"), (2, "Ace", "greenhouse", "https://b.example.com/boards/ace"),
        (3, "None", "", ""),
    ]
    assert [tuple(r) for r in registry.companies_for(table, "greenhouse").collect()] == [(2, "Ace", "https://b.example.com/boards/ace")]
    links = registry.read_registry(spark, str(path), "Greenhouse Carrer Page").collect()
    assert sorted(map(tuple, links)) == [("Ace", "https://b.example.com/boards/ace"), ("Zed", "https://other")]
    assert registry.company_id(table, "Ace").collect()[0].id == 2 and registry.company_id(table, "ace").count() == 0
    assert registry.company_id(table, "ace", "UTF8_LCASE").collect()[0].id == 2
    assert registry.companies_for(table, "WORKDAY", "UTF8_LCASE").count() == 1


def test_details_are_pruned_by_folder_and_the_newest_counts(spark, tmp_path):
    rows = {"2024-01-01": detail(1, "/a", title="Old"), "2024-01-03": detail(1, "/a", title="New")}
    for day, row in rows.items():
        land(tmp_path / "details" / f"dt={day}", "d.json", [{**row, "landed_at": f"{day}T00:00:00Z"}])
    path = str(tmp_path / "details")
    assert landed.read_details(spark, path, fixed.SOURCE_A).count() == 2
    since = landed.read_details(spark, path, fixed.SOURCE_A, since=date(2024, 1, 2))
    assert since.count() == 1
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*dt", plan)
    pages = land(tmp_path / "pages", "p.json", [page(1, 0, [posting("/a")])])
    companies = spark.createDataFrame([(1, "C", "https://c.example.com/x")], "id int, name string, url string")
    run = ingest_pages(
        landed.read_pages(spark, pages), landed.read_details(spark, path, fixed.SOURCE_A), companies,
        empty(spark, schemas.JOB_INFO), empty(spark, schemas.JOB_ANALYSIS), F.to_timestamp(F.lit(NOW)),
        RuleSet(title_include=("new", "old"), title_exclude=()),
    )
    assert [r.title for r in run.jobs.collect()] == ["New"]


def three_pages(company, run=None, at=None, **status):
    sizes = (3, 3, 1)
    return [
        {**page(company, n, [posting(f"/{company}-{n}-{k}") for k in range(size)], **status), "run_id": run, "landed_at": at}
        for n, size in enumerate(sizes)
    ]


def stream_setup(spark, tmp_path):
    details = land(tmp_path / "details", "d.json", [
        detail(c, f"/{c}-{n}-{k}") for c in (1, 2) for n in range(3) for k in range(3)
    ])
    companies = spark.createDataFrame([(n, f"C{n}", f"https://c{n}.example.com/x") for n in (1, 2)], "id int, name string, url string")
    return details, companies, str(tmp_path / "state"), str(tmp_path / "offsets")


def test_a_split_series_waits_for_its_pages(spark, tmp_path):
    details, companies, root, offsets = stream_setup(spark, tmp_path)
    one, two = three_pages(1), three_pages(2)

    def batch(name, rows):
        pages = land(tmp_path / "pages", name, rows)
        ingest_stream(spark, pages, details, companies, root, offsets, as_of=NOW, hold_batches=2).awaitTermination()
        jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO)
        return {c: jobs.filter(F.col("company_id") == c).count() for c in (1, 2)}

    assert batch("b0.json", [one[1], two[0], {**page(7, 0, []), "run_id": None}]) == {1: 0, 2: 0}
    assert batch("b1.json", [one[0], one[2]]) == {1: 7, 2: 0}
    assert batch("b2.json", [two[2]]) == {1: 7, 2: 3}, "two batches without page 1: read to the gap"
    rejects = tables.read_table(spark, root, "rejects", schemas.REJECTS)
    reasons = sorted((r.company_id, r.reason) for r in rejects.collect())
    assert reasons == [(2, "page before it missing"), (7, "unknown company")]


def test_every_landed_posting_is_read_rejected_or_held(spark, tmp_path):
    details, companies, _, _ = stream_setup(spark, tmp_path)
    rows = [*three_pages(1, "r1", "2024-01-01T00:00:00Z"), three_pages(1, "r2")[0], three_pages(2, "r1")[1], *three_pages(9)]
    pages = landed.read_pages(spark, land(tmp_path / "pages", "p.json", rows))
    for hold in (0, 1):
        run = ingest_pages(
            pages, landed.read_details(spark, details, fixed.SOURCE_A), companies, empty(spark, schemas.JOB_INFO),
            empty(spark, schemas.JOB_ANALYSIS), F.to_timestamp(F.lit(NOW)), hold_batches=hold,
        )
        postings = lambda bodies: sum(len(json.loads(b)["jobPostings"]) for b in bodies)
        read_pages = {r.company_id: r.pages for r in run.funnel.collect()}
        rejected = run.rejects.filter("stage = 'page'").collect()
        waiting = run.held.collect() if hold else []
        assert len(rows) == sum(read_pages.values()) + len(rejected) + len(waiting)
        assert {r.reason for r in rejected} == {"unknown company"} | ({"page before it missing"} if not hold else set())
        assert postings([r.body for r in waiting]) == (6 if hold else 0)
        assert run.jobs.count() == 7


def test_runs_of_one_company_do_not_mix(spark, tmp_path):
    details, companies, _, _ = stream_setup(spark, tmp_path)
    bad = [{**r, "status_code": 503} for r in three_pages(1, "r2", "2024-01-01T01:00:00Z")[:1]]
    rows = [*three_pages(1, "r1", "2024-01-01T00:00:00Z"), *bad]
    run = ingest_pages(
        landed.read_pages(spark, land(tmp_path / "pages", "p.json", rows)), landed.read_details(spark, details, fixed.SOURCE_A),
        companies, empty(spark, schemas.JOB_INFO), empty(spark, schemas.JOB_ANALYSIS), F.to_timestamp(F.lit(NOW)),
    )
    assert run.jobs.count() == 7
    assert [(r.stage, r.reason) for r in run.rejects.collect()] == [("page", "not 200")]


def test_keys_without_case_in_a_run(spark, tmp_path):
    details = land(tmp_path / "details", "d.json", [detail(1, "/a", req="R5"), detail(1, "/b", req="r5")])
    pages = land(tmp_path / "pages", "p.json", [page(1, 0, [posting("/a"), posting("/b")])])
    companies = spark.createDataFrame([(1, "C", "https://c.example.com/x")], "id int, name string, url string")
    for collation, jobs in ((None, 2), ("UTF8_LCASE", 1)):
        run = ingest_pages(
            landed.read_pages(spark, pages), landed.read_details(spark, details, fixed.SOURCE_A), companies,
            empty(spark, schemas.JOB_INFO), empty(spark, schemas.JOB_ANALYSIS), F.to_timestamp(F.lit(NOW)), collation=collation,
        )
        assert run.jobs.count() == jobs


def test_two_streams_of_one_root_take_turns(spark, board, tmp_path):
    details, companies, root, _ = stream_setup(spark, tmp_path)
    pages = land(tmp_path / "pages", "p.json", three_pages(1))
    boards, board_details, board_companies = board
    runs = [
        ingest_stream(spark, pages, details, companies, root, str(tmp_path / "o1"), as_of=NOW),
        ingest_stream(spark, boards, board_details, board_companies, root, str(tmp_path / "o2"), fixed.SOURCE_B, as_of=NOW),
    ]
    for run in runs:
        run.awaitTermination()
    jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO).collect()
    assert len(jobs) == 10
    assert sorted(r.id for r in jobs) == list(range(1, 11)) and len({r.ats_job_id for r in jobs}) == 10


def test_a_turn_that_is_held_says_by_whom(spark, tmp_path):
    root = str(tmp_path / "state")
    with tables.turn(spark, root, "a", 1):
        with tables.turn(spark, root, "a", 1, wait_seconds=0):
            pass
    (tmp_path / "state").mkdir(exist_ok=True)
    with tables.turn(spark, root, "a", 1):
        with pytest.raises(TimeoutError, match="a/1"):
            with tables.turn(spark, root, "b", 4, wait_seconds=0):
                pass


def test_a_batch_keeps_its_time(spark, tmp_path):
    root = str(tmp_path / "state")
    first = tables.batch_time(spark, root, "w", 0)
    assert tables.batch_time(spark, root, "w", 0) == first
    assert tables.batch_time(spark, root, "w", 1) > first


def with_broken(folder, name, line):
    (Path(folder) / name).write_text(line + "\n")
    return f"{folder}/{name}"


def rejected_lines(rows):
    return sorted((r.stage, r.raw, r.file.rsplit("/", 1)[1]) for r in rows if r.reason == "unreadable line")


def test_broken_lines_are_rejected_whole(spark, tmp_path):
    details, companies, root, _ = stream_setup(spark, tmp_path)
    pages = land(tmp_path / "pages", "p.json", three_pages(1))
    cut, odd, text = '{"company_id":1,"page_no":3,"body":{"jobPostings":[{"exter', '{"company_id":"one","page_no":4}', "no json at all"
    with_broken(pages, "cut.json", f"{cut}\n{odd}\n[1, 2")
    with_broken(details, "cut.json", text)
    run = ingest_pages(
        landed.read_pages(spark, pages), landed.read_details(spark, details, fixed.SOURCE_A), companies,
        empty(spark, schemas.JOB_INFO), empty(spark, schemas.JOB_ANALYSIS), F.to_timestamp(F.lit(NOW)), hold_batches=1,
    )
    assert run.jobs.count() == 7
    want = sorted([("page", cut, "cut.json"), ("page", odd, "cut.json"), ("page", "[1, 2", "cut.json"), ("detail", text, "cut.json")])
    assert rejected_lines(run.rejects.collect()) == want and run.rejects.columns == schemas.REJECTS.names
    assert all(r.reason == "unreadable line" for r in run.rejects.collect()), "they are rejected once, not also without a company"
    assert run.held.count() == 0


def test_streams_report_a_broken_line_once(spark, board, tmp_path):
    boards, details, companies = board
    root, offsets = str(tmp_path / "state"), str(tmp_path / "offsets")
    with_broken(boards, "cut.json", '{"company_id":')
    with_broken(details, "cut.json", "{")
    for extra in ("one", "two"):
        ingest_stream(spark, boards, details, companies, root, offsets, fixed.SOURCE_B, as_of=NOW).awaitTermination()
        with_broken(boards, f"{extra}.json", f'{{"company_id":"{extra}"}}')
        with_broken(details, f"{extra}.json", extra)
    rows = tables.read_table(spark, root, "rejects", schemas.REJECTS).collect()
    assert rejected_lines(rows) == [
        ("board", '{"company_id":', "cut.json"), ("board", '{"company_id":"one"}', "one.json"),
        ("detail", "one", "one.json"), ("detail", "{", "cut.json")]
    events = land(tmp_path / "events", "e.json", [event(1, "apply:1")])
    with_broken(events, "cut.json", '{"callback_query":{"id":"c9","data":"apply:2"')
    decision_stream(spark, events, seed_jobs(spark, str(tmp_path / "s2")), str(tmp_path / "s2"), str(tmp_path / "o2"), as_of=NOW).awaitTermination()
    assert len(read(spark, str(tmp_path / "s2"), "verdicts", schemas.VERDICTS).collect()) == 1
    assert rejected_lines(read(spark, str(tmp_path / "s2"), "rejects", schemas.REJECTS).collect()) == [
        ("event", '{"callback_query":{"id":"c9","data":"apply:2"', "cut.json")]


def test_a_run_closes_its_series_at_its_end(spark, tmp_path):
    details, companies, root, offsets = stream_setup(spark, tmp_path)
    one = three_pages(1)
    pages = land(tmp_path / "pages", "p0.json", one[:1])

    def run():
        ingest_stream(spark, pages, details, companies, root, offsets, as_of=NOW).awaitTermination()
        jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO).collect()
        assert sorted(r.id for r in jobs) == list(range(1, len(jobs) + 1))
        return sorted(r.ats_job_id for r in jobs)

    first = run()
    assert len(first) == 3 and run() == first, "no next page: read up to the gap, once"
    land(tmp_path / "pages", "p1.json", three_pages(2))
    assert len(run()) == 10, "a closed series is not taken up again"
    reasons = [r.reason for r in tables.read_table(spark, root, "rejects", schemas.REJECTS).collect()]
    assert reasons == []


def test_a_closing_that_broke_off_is_finished_by_the_next_batch(spark, tmp_path, monkeypatch):
    details, companies, root, offsets = stream_setup(spark, tmp_path)
    pages = land(tmp_path / "pages", "p0.json", three_pages(1)[:1])
    append = tables.append_batch

    def broken(df, root, table, writer, batch_id):
        if table == "job_info" and writer.endswith("-close"):
            raise OSError("lost")
        append(df, root, table, writer, batch_id)

    monkeypatch.setattr(tables, "append_batch", broken)
    with pytest.raises(OSError):
        ingest_stream(spark, pages, details, companies, root, offsets, as_of=NOW).awaitTermination()
    monkeypatch.setattr(tables, "append_batch", append)
    land(tmp_path / "pages", "p1.json", three_pages(2))
    ingest_stream(spark, pages, details, companies, root, offsets, as_of=NOW).awaitTermination()
    jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO).collect()
    assert sorted(r.id for r in jobs) == list(range(1, 11)) and len({r.ats_job_id for r in jobs}) == 10
    outbox = tables.read_table(spark, root, "outbox", schemas.OUTBOX).collect()
    assert sorted(r.job_id for r in outbox) == list(range(1, 11))


def test_a_running_stream_closes_a_series_without_new_files(spark, tmp_path):
    details, companies, root, offsets = stream_setup(spark, tmp_path)
    pages = land(tmp_path / "pages", "p0.json", three_pages(1)[:1])
    run = ingest_stream(spark, pages, details, companies, root, offsets, every="1 second", as_of=NOW, hold_batches=2)
    try:
        until = time.monotonic() + 120
        while not tables.read_table(spark, root, "job_info", schemas.JOB_INFO).count():
            assert time.monotonic() < until and run.isActive
            time.sleep(1)
    finally:
        run.stop()
    assert run.awaitTermination(30)
    assert tables.read_table(spark, root, "job_info", schemas.JOB_INFO).count() == 3


def test_two_sources_in_one_stream(spark, board, tmp_path):
    details, companies, root, offsets = stream_setup(spark, tmp_path)
    boards, board_details, board_companies = board
    details = land(tmp_path / "more", "d.json", [detail(1, f"/1-0-{k}", req=f"{'R1' if k else 'X'}{k}") for k in range(3)])
    pages = land(tmp_path / "pages", "p.json", three_pages(1)[:1])
    feeds = [Feed(fixed.SOURCE_A, pages, details, companies), Feed(fixed.SOURCE_B, boards, board_details, board_companies)]
    ingest_feeds(spark, feeds, root, offsets, as_of=NOW).awaitTermination()
    alone = str(tmp_path / "alone")
    ingest_stream(spark, boards, board_details, board_companies, alone, str(tmp_path / "o2"), fixed.SOURCE_B, as_of=NOW).awaitTermination()
    jobs = tables.read_table(spark, root, "job_info", schemas.JOB_INFO).collect()
    by_board = {r.ats_job_id for r in tables.read_table(spark, alone, "job_info", schemas.JOB_INFO).collect()}
    assert {r.ats_job_id for r in jobs} == by_board | {"X0", "R11", "R12"}
    assert sorted(r.id for r in jobs) == list(range(1, len(jobs) + 1)) and len({r.ats_job_id for r in jobs}) == len(jobs)
    outbox = tables.read_table(spark, root, "outbox", schemas.OUTBOX).collect()
    assert len(outbox) == len(jobs)
    with pytest.raises(ValueError):
        ingest_feeds(spark, feeds[:1] * 2, root, offsets)


def test_messages_of_several_sources_are_numbered_on(spark):
    def result(n, text):
        rows = spark.range(1, n + 1)
        job = rows.select(*[(F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.JOB_INFO])
        sent = rows.select(F.col("id").alias("seq"), F.lit(text).alias("kind"))
        none = spark.range(0)
        return IngestResult(jobs=job, analysis=none, outbox=sent, rejects=none, funnel=none)

    got = combine([result(2, "a"), result(0, "b"), result(3, "c")]).outbox.collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "a"), (3, "c"), (4, "c"), (5, "c")]


def test_a_turn_taken_by_another_process_is_waited_for(spark, tmp_path, monkeypatch):
    root = tmp_path / "state"
    root.mkdir()
    ready = root / "ready"
    code = f"import pathlib, time; pathlib.Path({str(root / '_turn')!r}).write_bytes(b'\\x00\\x05other'); " \
           f"pathlib.Path({str(ready)!r}).touch(); time.sleep(3); pathlib.Path({str(root / '_turn')!r}).unlink()"
    other = subprocess.Popen([sys.executable, "-c", code])
    while not ready.exists():
        time.sleep(0.05)
    with pytest.raises(TimeoutError, match="other"):
        with tables.turn(spark, str(root), "me", 0, wait_seconds=0):
            pass
    with tables.turn(spark, str(root), "me", 0, wait_seconds=60):
        assert other.wait(10) == 0


def test_the_turn_of_a_dead_writer_can_be_cleared(spark, tmp_path):
    root = str(tmp_path / "state")
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "_turn").write_bytes(b"\x00\x04dead")
    assert tables.clear_turn(spark, root) and not tables.clear_turn(spark, root)
    with tables.turn(spark, root, "me", 0, wait_seconds=0):
        pass


def test_recalibration_decodes_new_decisions_only(spark, tmp_path):
    root = str(tmp_path / "state")

    def analysed(batch, keyword):
        rows = [(i, i, 30, f'["{keyword}"]', "[]", "[]", None) for i in range(12)]
        tables.append_batch(spark.createDataFrame(rows, schemas.JOB_ANALYSIS), root, "job_analysis", "seed", batch)

    def decided(batch, ids):
        rows = [(i, "applied" if i % 3 == 0 else "rejected") for i in ids]
        tables.append_batch(spark.createDataFrame(rows, schemas.DECISIONS), root, "decisions", "seed", batch)

    def counts(version):
        run_recalibration(spark, root, version, F.current_timestamp())
        return {r.keyword: (r.accept_count, r.sample_count) for r in tables.read_overrides(spark, root).collect()}

    analysed(0, "old")
    decided(0, range(6))
    assert counts(1) == {}  # too few decisions: nothing learned, counted again by the next version
    decided(1, range(6, 10))
    assert counts(2) == {"old": (4, 10)}
    analysed(0, "new")  # what is counted is not read again
    decided(2, [10, 11])
    assert counts(3) == {"old": (4, 10)} and counts(3) == {"old": (4, 10)}
    decided(3, [12])  # never analysed
    assert counts(4) == {"old": (4, 10)}
    parts = tables.read_batches(spark, root, "keyword_parts", schemas.KEYWORD_PARTS).filter("batch_id = 3").collect()
    assert {(r.of_batch, r.keyword, r.sample_count) for r in parts} == {(2, None, 2), (2, "new", 2)}


def test_registry_order_over_many_files(spark, tmp_path):
    for k in range(12):
        lines = "".join(f"Co {(k * 50 + i) // 3},,https://b.example.com/{k * 50 + i},,,,\n" for i in range(50))
        (tmp_path / f"part-{k:02}.csv").write_text("Company Name,Workday Carrer Page,Greenhouse Carrer Page,,,,\n" + lines)
    built = registry.build_registry(registry.scan_csv(spark, str(tmp_path))).orderBy("id").collect()
    assert [(r.id, r.company_name, r.ats_link) for r in built] == [
        (k + 1, f"Co {k}", f"https://b.example.com/{3 * k}") for k in range(200)
    ]
