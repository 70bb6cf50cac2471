"""Compare the named queries with their SQL oracles. Usage: oracle.py SF_DIR [NAME…]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rolesift.plans.oracles import ORACLES
from rolesift.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, values as text, in a fixed order."""
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 6))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False))


def compare(spark, con, sf_dir: str, name: str, queries=QUERIES, oracles=ORACLES) -> str | None:
    """None if both agree, else what differs."""
    got = queries[name](spark, sf_dir).toPandas()
    want = con.execute(oracles[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    mine, theirs = rows(got), rows(want)
    if mine == theirs:
        return None if mine else "both empty"
    extra = sorted(set(mine) - set(theirs))[:2]
    missing = sorted(set(theirs) - set(mine))[:2]
    return f"{len(mine)} rows against {len(theirs)}; only ours {extra}; only oracle {missing}"


if __name__ == "__main__":
    from rolesift.session import build_session

    session = build_session(**{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    folder, *names = sys.argv[1:]
    duck = connect(folder)
    for key in names or QUERIES:
        began = time.time()
        try:
            verdict = compare(session, duck, folder, key) if key in ORACLES else "no oracle"
        except Exception as e:
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{key:28} {time.time() - began:6.1f}s {verdict or 'ok'}", flush=True)
