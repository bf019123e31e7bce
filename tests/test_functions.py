import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import text, timerange
from tidemark.operators import aggregates, joins, packets, windows
from tidemark.operators.validate import Field, cited_within, schema_errors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ranges(spark):
    r = one(spark, timerange.parse_range(F.lit("2030年1月2日 3时04分")))
    assert (r["start"], r["end"], r["precision"]) == (dt.datetime(2030, 1, 2, 3, 4), dt.datetime(2030, 1, 2, 3, 5), "minute")
    assert one(spark, timerange.parse_range(F.lit("2030-02-30"))) is None
    for known, cut, inclusive, expected in (
        ("2030-01-02 10:00:00", "2030-01-02 10:00:00", True, True), ("2030-01-02 10:00:00", "2030-01-02 10:00:00", False, False),
        ("2030-01-02", "2030-01-02 10:00:00", True, False), ("2030-01-01", "2030-01-02", True, True), ("2030-01-02", "2030-01-02", True, False),
        ("2030-01-02 09:59", "2030-01-02 10:00:00", False, True), ("?", "2030-01-02", True, False),
    ):
        got = one(spark, timerange.visible_at(timerange.parse_range(F.lit(known)), timerange.parse_range(F.lit(cut)), inclusive))
        assert got is expected, (known, cut)
    assert one(spark, timerange.first_present(F.lit(""), F.lit("bad"), F.lit("2030-01-01"))) == "bad"
    assert one(spark, timerange.first_readable(F.lit(""), F.lit("bad"), F.lit("2030-01-01")))["start"] == dt.datetime(2030, 1, 1)


def test_strict_json(spark):
    for value, ok in (('{"a": 1}', True), (' {"a": [1]}\n', True), ('{"a":1} {}', False), ('{"a":1}] {}', False), ('{"a":1,"a":2}', False), ('{"a":NaN}', False), ("```{}```", False), ("[1]", False), ("", False)):
        assert one(spark, text.strict_json(F.lit(value))) is ok, value
    assert one(spark, text.strict_json(F.lit(None).cast("string"))) is False


def test_schema_errors(spark):
    rules = [Field("mode", values=("GO", "WAIT")), Field("ids", "array", least=1, most=2), Field("note", required=False, most=3)]
    for value, errors in (
        ('{"mode":"GO","ids":["a"]}', []), ('{"mode":"NO","ids":["a","a"]}', ["$.ids", "$.mode"]), ('{"mode":"GO","ids":[],"x":1}', ["$+", "$.ids"]), ("{", ["$"]), ('{"mode":"GO","ids":["a"],"note":"long"}', ["$.note"]),
    ):
        assert one(spark, schema_errors(F.lit(value), rules)) == errors, value
    assert one(spark, cited_within(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) and not one(spark, cited_within(F.array(F.lit("c")), F.lit(None)))


def test_text(spark):
    assert one(spark, text.affirmed(F.lit("未见转移。可见转移"), "转移", "未见")) and not one(spark, text.affirmed(F.lit(None).cast("string"), "x", "y"))
    assert one(spark, text.safe_sentences(F.lit("a。b1。c"), "1")) == "a。c"
    assert one(spark, text.without_literals(F.lit("abc ab"), ["ab", "abc"], "*")) == "* *"
    assert one(spark, text.clauses(F.lit(" a 。1 b1。"))) == ["a", "1 b1"]


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), (None, 3, "x"), ("b", None, "y")], "k string, i int, v string")
    assert {r["k"]: r["status"] for r in aggregates.reconcile(df, "k", "v", ["i"]).collect()} == {"a": "unknown", None: "known", "b": "known"}
    assert {(r["i"], r["kept"]) for r in aggregates.dedup_map(df.where("i IS NOT NULL"), "i", ["k", "v"]).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert windows.first_rows(df, "k", ["i"]).count() == 3
    assert windows.ranked_ids(df.where("false"), [F.col("i")], "X", 3, "k").count() == 0
    left = spark.createDataFrame([(1, "a", None), (2, None, dt.datetime(2030, 1, 1))], "e bigint, k string, t timestamp_ntz")
    right = spark.createDataFrame([(9, "a", None), (8, None, dt.datetime(2030, 1, 1))], "c bigint, k string, t timestamp_ntz")
    assert {tuple(r) for r in joins.asof_backward(left, right, "k", "e", "t", "t", "c").collect()} == {(1, None), (2, None)}
    pairs = packets.dispositions(left, right, "k", [("NO_TIME", F.col("r.t").isNull())], ["NO_TIME"])
    assert [r["disposition"] for r in pairs.collect()] == ["unresolved"]
