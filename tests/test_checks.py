import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import nodes
from tidemark.operators import aggregates, flow, replay, validate
from tidemark.sources import readers, sinks


def test_frozen_differences(spark):
    frozen = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "k bigint, v string")
    rebuilt = spark.createDataFrame([(3, "c"), (4, None), (5, None)], "k bigint, v string")
    assert {(r["k"], r["differs"]) for r in validate.frozen_differences(frozen, rebuilt, ["k"], ["v"]).collect()} == {(1, "missing"), (2, "missing"), (3, "v"), (5, "extra")}


def test_rules(spark):
    df = spark.createDataFrame([("x", "p", "H"), ("x", "q", None), ("y", None, "?")], "k string, who string, flag string")
    assert {(r["k"], r["problem"]) for r in validate.key_violations(df, "k", "who").collect()} == {("x", "ambiguous"), ("y", "unmapped")}
    assert {(r["rule"], r["rows"]) for r in validate.contract_violations(df, validate.Contract(("k",), ("who",), (("flag", ("H",)),))).collect()} == {("filled:who", 1), ("values:flag", 1), ("grain", 2)}
    assert validate.overlaps(df, "who", "k").first()["n"] == 1
    assert validate.coverage_gaps(df, df, "k").count() == 0
    assert {r["rule"] for r in validate.violations(df, "k", [("f", F.col("flag") == "H")]).collect()} == {"f"}
    assert validate.contract_violations(df.where("false"), validate.Contract(("k",), ("who",))).agg(F.sum("rows")).first()[0] == 0


def test_typed_replay(spark):
    t = lambda d: dt.datetime(2030, 1, d)
    states = [("c1", "LAP", "OMENTUM", "M", t(1), t(1), None, True), ("c2", "LAP", "OMENTUM", "M", t(1), t(1), None, True), ("c3", "LAP", "OMENTUM", "M", t(1), t(1), t(3), True), ("c4", "LAP", "OMENTUM", "M", t(1), t(1), None, False), ("c5", "LAP", "LIVER", "M", t(1), t(1), None, True)]
    schema = "case_id string, action string, site string, domain string, now timestamp_ntz, baseline timestamp_ntz, until timestamp_ntz, strict boolean"
    event = lambda c, i, d, **o: (c, i, o.get("kind", "lap_result"), o.get("site", "网膜"), ["M"], o.get("compatible", []), t(d), o.get("exact", True), o.get("audited", True), o.get("reviewed", True))
    events = [event("c1", "e1", 5), event("c1", "e2", 4, kind="ct", compatible=["LAP"]), event("c1", "e0", 1), event("c2", "e3", 5, audited=False), event("c3", "e4", 5), event("c4", "e5", 4), event("c4", "e6", 5, exact=False), event("c5", "e7", 4)]
    kinds = "case_id string, event_id string, kind string, site string, domains array<string>, compatible array<string>, at timestamp_ntz, exact boolean, audited boolean, reviewed boolean"
    got = {r["case_id"]: (r["status"], r["event_id"], r["match"]) for r in replay.typed_match(spark.createDataFrame(states, schema), spark.createDataFrame(events, kinds), {"lap_result": "LAP"}, {"网膜": "OMENTUM"}, 30).collect()}
    assert got == {"c1": ("READY", "e2", "COMPATIBLE"), "c2": ("REVIEW_REQUIRED", None, None), "c3": ("COUNTERFACTUAL_UNOBSERVED", None, None), "c4": ("REVIEW_REQUIRED", None, None), "c5": ("COUNTERFACTUAL_UNOBSERVED", None, None)}


def test_flow_without_sources(spark):
    at = "struct<start:timestamp_ntz,end:timestamp_ntz,precision:string>"
    points = spark.createDataFrame([("a", 1)], "case_id string, stage int").select("case_id", "stage", F.lit(None).cast(at).alias("at"), F.lit("after_records").alias("position"), F.array().cast("array<string>").alias("anchors"))
    none = spark.createDataFrame([], f"case_id string, source_id string, kind string, title string, body string, time {at}, basis string, origin string, issue string, version_issue string")
    packet = flow.packets(flow.decide(points, none, flow.whole_record_rules())).first()
    assert (packet["status"], packet["records"], packet["context"]) == ("UNRESOLVED", 0, "")


def test_grouped(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 3, "x"), ("b", 1, None)], "k string, o int, v string")
    assert {r["k"]: r["values"] for r in aggregates.ordered_distinct(df, "k", ["o"], "v").collect()} == {"a": ["y", "x"]}
    assert {r["k"]: r["status"] for r in aggregates.statuses(df, "k", ["v"]).collect()} == {"a": "conflict", "b": "unknown"}
    assert [tuple(r) for r in aggregates.top_counts(df, "v", 1).collect()] == [("x", 2)]
    wide = nodes.flattened(df.select("k", F.struct(F.struct("o").alias("in"), "v").alias("s")), "s", "s")
    assert wide.columns == ["k", "s_in_o", "s_v"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", 1), ("t2", 2)], "task string, k int")
    assert readers.planned(df, df, df.where("k = 1"), "task", "k").count() == 1
    with pytest.raises(Exception, match="stand in no task"):
        readers.planned(df, df.where("k = 1"), df, "task", "k").collect()
    assert sinks.json_document(df).first()["value"] == '[{"task":"t1","k":1},{"task":"t2","k":2}]'
    assert sinks.json_document(df, "split").first()["value"] == '{"columns":["task","k"],"data":[["t1",1],["t2",2]]}'
    sinks.csv(df.coalesce(1), str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    sinks.protected("x", str(tmp_path / "p"), [str(tmp_path)])
    assert (tmp_path / "p").stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        sinks.protected("x", str(tmp_path / ".." / "q"), [str(tmp_path)])
