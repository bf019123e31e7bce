import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import spans, text, timerange


def test_spans_against_a_scan(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab。\n肝😀") for _ in range(draw.randint(0, 30))) for _ in range(200)] + ["", None, "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", spans.spans(F.col("t"), "a+b?|肝").alias("s"), spans.sentence_start(F.col("t"), F.lit(7)).alias("at"))
    for r in df.collect():
        found = [] if r["t"] is None else [(m.start(), m.end(), m[0]) for m in re.finditer("a+b?|肝", r["t"])]
        assert [(s["start"], s["end"], s["text"]) for s in r["s"] or []] == found
        if r["t"] is not None:
            head = r["t"][:7]
            assert r["at"] == max(head.rfind(c) for c in "\n。；") + 1


def test_sections(spark):
    t = "主诉：A建议切除\n现病史：B建议切除\n辅助检查：C建议切除。"
    found = spark.createDataFrame([(t,)], "t string").select(spans.outside(spans.spans(F.col("t"), "建议切除"), spans.ranges(F.col("t"), [("主诉：", "\\n"), ("现病史：", "\\n辅助检查")])).alias("s")).first()["s"]
    assert [s["start"] for s in found] == [t.rindex("建议")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_document_times(spark):
    for value, start, issue in (
        ("2030-01-02 03:04 记录", dt.datetime(2030, 1, 2, 3, 4), None), ("记录时间：2030年1月2日 03:04\n正文 2031-01-01", dt.datetime(2030, 1, 2, 3, 4), None), ("2030-01-02 x 记录时间:2030-01-03", None, "DOCUMENT_TIME_AMBIGUOUS"),
        ("2030-02-30 x", None, "DOCUMENT_TIME_MISSING"), ("", None, "DOCUMENT_TIME_MISSING"), (None, None, "DOCUMENT_TIME_MISSING"),
    ):
        got = one(spark, timerange.document_time(F.lit(value).cast("string")))
        assert ((got["time"] or {"start": None})["start"], got["issue"]) == (start, issue), value
    assert one(spark, timerange.exact_time(F.lit("2030-01-02"))) is None and one(spark, timerange.exact_time(F.lit("2030-01-02T03:04:05+08:00"))) is None
    assert one(spark, timerange.exact_time(F.lit("2030-01-02T03:04"))) == dt.datetime(2030, 1, 2, 3, 4)
    assert one(spark, timerange.iso_date(F.lit("20300102"))) == dt.date(2030, 1, 2) and one(spark, timerange.iso_date(F.lit("2030/13/02"))) is None
    cutoff = F.lit(dt.datetime(2030, 1, 2, 10)).cast("timestamp_ntz")
    assert one(spark, timerange.future_dates(F.lit("2030-01-02 09:59，2030-01-02 10:00，2030-01-02，2030-01-03"), cutoff)) == ["2030-01-02 10:00", "2030-01-03"]


def test_negation_and_certainty(spark):
    assert one(spark, text.affirmed_within(F.lit("未见肝转移。" + "x" * 30 + "转移"), "转移", "未见", 24)) is True
    assert one(spark, text.affirmed_within(F.lit("未见肝转移，转移"), "转移", "未见", 24)) is False
    assert one(spark, text.certainty(F.lit(None).cast("string"), "a", "b")) == "none"
    assert one(spark, text.redacted(F.lit("abc1。d2"), "[0-9]", 2)) == "ab" and one(spark, text.redacted(F.lit("1"), "[0-9]", 2)) is None
    assert one(spark, text.size_mm(F.lit("大小约2.5×3.1cm，另见28mm"))) == 31.0 and one(spark, text.size_mm(F.lit(""))) is None
