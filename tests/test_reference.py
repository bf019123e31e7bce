"""Every query with SQL gives the same rows as that SQL in another engine."""

import glob
import math
import os
import uuid

import duckdb
import pytest

from tidemark.plans.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    link = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        link.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return link


def plain(value):
    return (None if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=str)


def test_uuid5(spark):
    df = QUERIES["uuid5_ids"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/fictional_raw_records.parquet").select("rec_id", "source_system", "source_record_key"), "rec_id")
    for r in df.limit(50).collect():
        name = "|".join(x for x in ((r["source_system"] or "").strip().lower(), r["source_record_key"]) if x is not None)
        assert r["uid"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
