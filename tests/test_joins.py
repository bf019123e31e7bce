import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, windows

DAY = dt.timedelta(days=1)
EV, CH = "e bigint, k string, t timestamp_ntz, c int, side int", "c bigint, k string, t timestamp_ntz, e int"


def make(seed):
    draw = random.Random(seed)
    # one entity holds most rows, moments repeat, entities and times may be missing
    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", None])
    time = lambda: draw.choice([None] + [dt.datetime(2030, 1, 1) + n * dt.timedelta(hours=30) for n in range(40)])
    return [(i, key(), time(), 0, 0) for i in range(150)], [(i, key(), time(), 0) for i in range(150)]


def pairs(events, changes, e):
    return [(c[2] - e[2], c[0], c[2]) for c in changes if e[1] is not None and e[2] is not None and c[1] == e[1] and c[2] is not None]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    events, changes = make(seed)
    left, right = spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH)
    got = {r["e"]: r["c"] for r in joins.asof_backward(left, right, "k", "e", "t", "t", "c", days=3).collect()}
    best = {}
    for e in events:
        near = [p for p in pairs(events, changes, e) if p[0] <= dt.timedelta(0)]
        last = max(near, key=lambda p: (p[0], p[1]), default=None)
        best[e[0]] = last[1] if last and last[0] >= -3 * DAY else None
    assert got == best
    got = {r["e"]: (r["c"], r["gap_us"]) for r in joins.nearest(left, right, "k", "e", "t", "c", "t", 2, 3).collect()}
    want = {}
    for e in events:
        near = [(abs(p[0]), p[0], p[1]) for p in pairs(events, changes, e) if -2 * DAY <= p[0] <= 3 * DAY]
        if near:
            want[e[0]] = (min(near)[2], min(near)[1] // dt.timedelta(microseconds=1))
    assert got == want
    for behind in (True, False):
        got = {r["e"]: r["c"] for r in joins.first_within(left, right, "k", "e", "t", "c", "t", 4, behind=behind).collect()}
        want = {}
        for e in events:
            near = [(p[2], p[1]) for p in pairs(events, changes, e) if (dt.timedelta(0) < p[0] <= 4 * DAY if behind else -4 * DAY <= p[0] < dt.timedelta(0))]
            if near:
                want[e[0]] = min(near)[1]
        assert got == want
    for with_start, with_end in ((False, False), (True, False), (True, True)):
        got = {r["e"]: r["n"] for r in joins.counts_between(left, right, "k", "e", "t", F.col("t") - F.expr("INTERVAL '5' DAY"), F.col("t"), with_start, with_end).collect()}
        inside = lambda d: (-5 * DAY <= d if with_start else -5 * DAY < d) and (d <= dt.timedelta(0) if with_end else d < dt.timedelta(0))  # noqa: E731, B023
        assert got == {e[0]: sum(inside(p[0]) for p in pairs(events, changes, e)) for e in events}


def test_hot_entity(spark):
    # 100,000 rows of one entity: all pairs would be 2.5 billion
    events = spark.range(50_000).select(F.col("id").alias("e"), F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("t"))
    changes = spark.range(50_000).select(F.col("id").alias("c"), F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 600 + 60).cast("timestamp_ntz").alias("t"))
    assert joins.counts_between(events, changes, "k", "e", "t", F.col("t") - F.expr("INTERVAL '1' DAY"), F.col("t")).agg(F.max("n")).first()[0] == 144
    assert joins.nearest(events, changes, "k", "e", "t", "c", "t", 1, 1).where("e = c").count() == 50_000


def test_intervals(spark):
    stays = [("S1", "a", dt.datetime(2030, 1, 1), dt.datetime(2030, 3, 1)), ("S2", "a", dt.datetime(2030, 1, 20), dt.datetime(2030, 2, 1)), ("S3", "a", dt.datetime(2030, 5, 1), None), ("S4", "a", dt.datetime(2030, 6, 1), dt.datetime(2030, 5, 1)), ("S5", None, dt.datetime(2030, 1, 1), None)]
    points = [(1, "a", dt.datetime(2030, 1, 25)), (2, "a", dt.datetime(2030, 2, 20)), (3, "a", dt.datetime(2030, 5, 1)), (4, "a", dt.datetime(2030, 5, 20)), (5, None, None)]
    got = joins.shortest_interval(spark.createDataFrame(points, "p bigint, k string, t timestamp_ntz"), spark.createDataFrame(stays, "s string, k string, a timestamp_ntz, b timestamp_ntz"), "k", "p", "t", "s", "a", "b")
    assert {(r["p"], r["s"]) for r in got.collect()} == {(1, "S2"), (2, "S1"), (3, "S3")}


def test_group_limits_stand_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("g"), "id")
    for out in (windows.quota(df, "g", ["id"], {"0": 4}, 2), windows.balanced_fill(df, "g", ["id"], {"0": 1}, 10), windows.last_n(df, "g", ["id"], 2), windows.hash_sample(df, "g", "id", "s", 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan, plan


def test_selection(spark):
    rows = [(i, ["a", "b"][i % 2], [f"p{i % 5}", None][i == 7], i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "i bigint, cat string, who string, score int")
    got = windows.one_each(df, "cat", ["a", "b", "c"], "who", [-F.col("score"), F.col("i")], 2).collect()
    assert len({r["who"] for r in got}) == len(got) == 4 and [r["cat"] for r in got].count("a") == 2
    assert windows.one_each(df.where("false"), "cat", ["a"], "who", [F.col("i")], 2).count() == 0
    tagged = df.select("i", "cat", F.when(F.col("i") == 30, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    repaired = windows.covered(tagged.orderBy("i").limit(6), tagged, "i", "cat", "tags", ["x", "never"], "s").collect()
    assert len(repaired) == 6 and any("x" in r["tags"] for r in repaired)
    assert {r["band"] for r in windows.rank_bands(df, "i", "s", [("d", 3), ("l", 2)]).collect()} == {"d", "l"}
    places = {r["cat"]: r["places"] for r in windows.allocate_to_targets(df, "cat", {"a": 1, "b": 1, "none": 2}, 9).collect()}
    assert places["none"] == 0 and places["a"] + places["b"] == 9
