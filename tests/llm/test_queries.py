"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolesift.llm import decontamination, exact_dedup, simhash
from rolesift.llm.oracles import ORACLES
from rolesift.llm.queries import QUERIES
from rolesift.session import stage
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(spark, connect(SF), SF, name, QUERIES, ORACLES) is None
    else:
        got = QUERIES[name](spark, SF)
        assert got.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.union(docs.limit(3)).unionByName(
        spark.createDataFrame([(None, None), (None, "lonely text"), (None, "lonely  text")], "doc_id long, text string"),
        allowMissingColumns=True,
    ).withColumn("found", F.lit("x"))
    at = stage(extra, "docs")
    sizes = []
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, at, SF), "step")
        if name != "best-fit packing":
            assert out.columns == at.columns
            assert out.exceptAll(at).isEmpty()
        sizes.append((at.count(), out.count()))
        if name == "exact dedup":
            groups = exact_dedup.exact_groups(out)
            assert groups.filter("group_size > 1 and doc_id is not null").select("keep_id", "doc_id").filter(
                "keep_id <> doc_id").isEmpty()
        if name == "SimHash near-dedup":
            groups = simhash.near_groups(out)
            assert groups.groupBy("component_id").agg(F.countDistinct("doc_id").alias("n")).filter("n > 1").isEmpty()
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontamination.contamination_digest(out, bench).filter("contaminated").isEmpty()
        at = out
    assert all(n > 0 for _, n in sizes) and sizes[1][0] > sizes[1][1]
    assert at.select("doc_id").distinct().count() <= sizes[-1][0]


def test_pipeline_runs_from_documents(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"


ODD_NAMES = ["doc_id", "text", "found", "FOUND", "_toxicity", "score", "_digest", "digest", "_keep", "keep", "_many", "_row", "row",
             "away", "repeated", "a.b", "TEXT", "_0", "_text"]


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES[:-1])
def test_stages_leave_all_columns_alone(spark, name, step):
    body = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, *(f"{n} {r.doc_id}" for n in ODD_NAMES[2:])) for r in body]
    docs = spark.createDataFrame(rows, ODD_NAMES)
    out = step(spark, docs, SF)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert 0 < len(got) == len(set(got)) and set(got) <= set(rows)
    assert step(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("step", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_one_row_of_each_group_stays(spark, step):
    same, other = "one two three four five six", "entirely different words in this text here"
    rows = [(3, same, "a"), (1, same, "b"), (1, same, "c"), (None, other, "d"), (None, other, "e"), (7, None, "f"), (7, "", "g"), (2, same, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = step(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (False, 7), (True, None)]
    assert all(tuple(r) in rows for r in got)
