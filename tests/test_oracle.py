import os

import pytest
from oracle import compare, database
from shortlens.catalog import QUERIES, SQL
from shortlens.operators import aggregates as agg

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"i3_pca", "i4_project_2d", "i4_neighbor_map", "c14_similar_pairs_approx"}


@pytest.fixture(scope="module")
def con():
    return database(DIRECTORY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DIRECTORY)
    if name in ROWS_ONLY:
        assert df.count() > 0
    else:
        assert compare(df, con, SQL[name]) == ""


CHUNKED = sorted(n for n, sql in SQL.items() if f"// {agg.CHUNK_ROWS}" in sql)


@pytest.mark.parametrize("name", [*CHUNKED, "h30_array_size", "h31_unnest", "h36_to_jobs_parsed", "posts_table"])
def test_query_matches_sql_in_short_chunks(spark, con, name, monkeypatch):
    sql = SQL[name].replace(f"// {agg.CHUNK_ROWS}", "// 3")
    monkeypatch.setattr(agg, "CHUNK_ROWS", 3)
    assert compare(QUERIES[name](spark, DIRECTORY), con, sql) == ""


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
