import sqlite3

from pyspark.sql import functions as F

from tidemark.sources import readers, sinks


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("姓名,数\n\"李,四\",1\n王,x\n".encode("gb18030"))
    got = {(r["姓名"], r["数"]) for r in readers.csv(spark, str(tmp_path / "a.csv"), "`姓名` string, `数` int", "gb18030").collect()}
    assert got == {("李,四", 1), ("王", None)}
    (tmp_path / "b.csv").write_text('a,b\n"x\ny",2\n')
    assert readers.csv(spark, str(tmp_path / "b.csv"), "a string, b int").first()["a"] == "x\ny"
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [r["a"] for r in readers.json_lines(spark, str(tmp_path / "c.jsonl"), "a int").orderBy("a").collect()] == [None, 1]
    (tmp_path / "d.xml").write_bytes("<a><b>肝</b> <c>胆</c></a>".encode("gb18030"))
    assert readers.markup(spark, str(tmp_path)).first()["text"] == "肝 胆"
    assert [r["name"] for r in readers.files(spark, str(tmp_path), "csv$").orderBy("name").collect()] == ["a.csv", "b.csv"]
    link = sqlite3.connect(tmp_path / "e.db")
    link.executescript("CREATE TABLE t(a INT, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, NULL);")
    link.commit()
    link.close()
    assert readers.sqlite(spark, str(tmp_path / "e.db"), "SELECT a, b FROM t", "a bigint, b string").count() == 2
    cluster = spark.range(1).select(F.lit('{"fragments":[{"tokens":["a","b"]}]}').alias("j"))
    assert cluster.select(readers.tokens(F.col("j")).alias("t")).first()["t"] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 3)], "id bigint, k string, n int")
    sinks.parquet(df, str(tmp_path / "p"), by=["k"])
    sinks.append(df, str(tmp_path / "j"))
    sinks.append(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 4 and spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert readers.parquet(spark, str(tmp_path / "p"), ["id", "missing"]).where("missing IS NULL").count() == 2
    assert {r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {'{"id":2,"k":"b","n":null}', '{"id":1,"k":"a","n":3}'}
    sinks.csv(df, str(tmp_path / "c"))
    late = spark.createDataFrame([(1, "z", 3), (3, "c", 1)], "id bigint, k string, n int")
    assert {r["k"] for r in sinks.latest(df, late, ["id"], "n").collect()} == {"b", "z", "c"}
    assert sinks.merged(df, late, "id").count() == 3
