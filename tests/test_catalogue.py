"""Every registered query with SQL is held against DuckDB on the smallest tables; the others must run."""

import glob
import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from helixframe.plans import catalogue

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df, columns):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    got = catalogue.queries()[name](spark, TABLES).toPandas()
    want = oracle.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["patscan_fuzzy", "usearch_local", "uclust_align"])
def test_other_queries_run(spark, name):
    got = catalogue.queries()[name](spark, TABLES).toPandas()
    assert len(got.columns) and not any(isinstance(v, float) and math.isinf(v) for r in got.itertuples(index=False) for v in r)


def test_maximal_matches_are_real_and_cannot_be_extended(spark):
    docs = {r["__ord"]: r.SEQ for r in catalogue.sequences(spark, TABLES).collect()}
    items = {r["__ord"]: r.SEQ for r in catalogue._items(spark, TABLES).collect()}
    for m in catalogue.queries()["maximal_exact_matches"](spark, TABLES).collect():
        q, s = items[m.q_id], docs[m.s_id]
        assert q[m.q_beg : m.q_beg + m.hit_len] == s[m.s_beg : m.s_beg + m.hit_len]
        assert not m.q_beg or not m.s_beg or q[m.q_beg - 1] != s[m.s_beg - 1]


def test_score_positions_of_long_texts(spark, tmp_path):
    docs = [(1, "ab, " * 50_402), (2, "z" * 100_001), (3, "xy"), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["mean_score_by_pos"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["mean_score_by_pos"]).df()
    assert len(want) == 100_804 and rows(got, ["mean", "n", "pos"]) == rows(want, ["mean", "n", "pos"])
