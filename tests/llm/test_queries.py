"""Queries with SQL give the same rows as that SQL in another engine; the tree gives the ids of whole encoding on every document."""

import glob
import os

import duckdb
import pytest

from tidemark.llm.entry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    link = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        link.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = link.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted([r[c] for c in columns] for r in df.collect()) == sorted([r[names.index(c)] for c in columns] for r in result.fetchall())


def test_joined_ids(spark):
    rows = queries()["p7_ids_split"](spark, FOLDER).select("equal").collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and all(r["equal"] == 1 for r in rows)
