"""Schemas of the tables and of the landed JSON. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_INT, _LONG, _TEXT = IntegerType(), LongType(), StringType()
_FLOAT, _DOUBLE, _TIME = FloatType(), DoubleType(), TimestampType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


COMPANY_INFO = _struct(
    id=_INT, company_name=_TEXT, base_country=_TEXT, target_location=_TEXT, ats=_TEXT, ats_link=_TEXT
)
JOB_INFO = _struct(
    id=_LONG,
    company_id=_INT,
    ats_job_id=_TEXT,
    title=_TEXT,
    location=_TEXT,
    application_link=_TEXT,
    created_ts=_TIME,
    user_decision=_TEXT,
)
JOB_ANALYSIS = _struct(
    id=_LONG,
    job_id=_LONG,
    relevance_score=_INT,
    positive_matches=_TEXT,
    negative_matches=_TEXT,
    experience_matches=_TEXT,
    analyzed_at=_TIME,
)
APPLICATION_STATUS = _struct(
    id=_LONG,
    company_id=_INT,
    job_id=_LONG,
    applied_on=_TEXT,
    poc=_TEXT,
    resume_link=_TEXT,
    status=_TEXT,
    next_important_date=_TEXT,
    next_important_task=_TEXT,
)
KEYWORD_PARTS = _struct(
    of_writer=_TEXT, of_batch=_LONG, keyword=_TEXT, accept_count=_LONG, reject_count=_LONG, sample_count=_LONG
)
OVERRIDES = _struct(
    keyword=_TEXT,
    multiplier=_FLOAT,
    accept_count=_INT,
    reject_count=_INT,
    sample_count=_INT,
    lift=_FLOAT,
    updated_at=_TIME,
)
KEYWORDS = _struct(ordinal=_INT, polarity=_TEXT, keyword=_TEXT, weight=_DOUBLE)
OUTBOX = _struct(
    seq=_LONG, kind=_TEXT, job_id=_LONG, text=_TEXT, keyboard=_TEXT, reply_to=_LONG
)
DECISIONS = _struct(job_id=_LONG, decision=_TEXT)
VERDICTS = _struct(callback_id=_TEXT, message_id=_LONG, job_id=_LONG, verdict=_TEXT)
# `file` is the landed file of a line that could not be read
REJECTS = _struct(source=_TEXT, company_id=_INT, stage=_TEXT, reason=_TEXT, raw=_TEXT, file=_TEXT)

# Landed files. `body` is kept as text, so that a broken body is one rejected row
# and a missing key can be told from a null one; it may be an object or a string.
# `run_id` names the run that fetched a file, `landed_at` the time; both may be missing.
PAGES = _struct(
    company_id=_INT, page_no=_INT, offset=_INT, limit=_INT, status_code=_INT, body=_TEXT,
    run_id=_TEXT, landed_at=_TIME,
)
# Pages of an unfinished series, and for how many batches they have waited
HELD_PAGES = StructType([*PAGES.fields, StructField("held", _INT)])
PAGE_BODY = _struct(
    jobPostings=ArrayType(_struct(externalPath=_TEXT, postedOn=_TEXT, locationsText=_TEXT)),
    _corrupt_record=_TEXT,
)
_PLACE = _struct(name=_TEXT)
BOARDS = _struct(company_id=_INT, status_code=_INT, body=_TEXT, run_id=_TEXT, landed_at=_TIME)
BOARD_BODY = _struct(
    jobs=ArrayType(
        _struct(
            id=_LONG,
            title=_TEXT,
            updated_at=_TEXT,
            location=_PLACE,
            offices=ArrayType(_struct(location=_PLACE)),
        )
    ),
    _corrupt_record=_TEXT,
)
LINE = _struct(broken_line=_TEXT, landed_file=_TEXT)
DETAILS_A = _struct(
    company_id=_INT, external_path=_TEXT, status_code=_INT, body=_TEXT, landed_at=_TIME
)
DETAILS_B = _struct(
    company_id=_INT, job_id=_LONG, status_code=_INT, body=_TEXT, landed_at=_TIME
)
DECISION_EVENTS = _struct(
    received_at=_TIME,
    callback_query=_struct(id=_TEXT, data=_TEXT, message=_struct(message_id=_LONG)),
)

# Partition columns that the table folders add
BATCH = _struct(writer=_TEXT, batch_id=_LONG)
BATCH_TIMES = _struct(started_at=_TIME)
VERSION = _struct(version=_LONG)

# Column widths of job_info; wider values do not fit and the row is rejected
JOB_WIDTHS = {"ats_job_id": 255, "title": 500, "location": 500, "application_link": 1024}
