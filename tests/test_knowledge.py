import random

import pytest

from tidemark.operators.knowledge import as_known, buckets_for

EV, CH = "event_id bigint, entity string, at bigint, slice string", "id bigint, entity string, kind string, happened bigint, known bigint, bucket string"


def brute(events, changes):
    out = []
    for e, k, t, *_ in events:
        if k is None or t is None:
            continue
        best = {}
        for i, ck, kind, h, kn, *_ in changes:
            if None not in (ck, kind, h, kn) and ck == k and h <= t and kn <= t:
                best[kind] = max(best.get(kind, ((-1 << 62),)), (h, kn, -i))
        out += [(e, -b[2]) for b in best.values()]
    return sorted(out)


@pytest.mark.parametrize("slice_us,buckets", [(1, 3), (7, 1), (1 << 40, 4)])
def test_against_every_pair(spark, slice_us, buckets):
    draw = random.Random(slice_us)
    pick = lambda: draw.choice(["hot"] * 6 + ["a", "b", None])
    events = [(i, pick(), draw.choice([None, *range(30)]), "x") for i in range(120)]
    changes = [(i, pick(), draw.choice(["lab", "image", None]), draw.choice([None, *range(-5, 30)]), draw.choice([None, *range(-5, 30)]), "y") for i in range(400)]
    got = as_known(spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH), buckets=buckets, slice_us=slice_us)
    assert sorted(map(tuple, got.collect())) == brute(events, changes)


def test_ties_and_the_very_moment(spark):
    events = [(1, "p", 10, "")]
    changes = [(5, "p", "k", 10, 3, ""), (4, "p", "k", 10, 3, ""), (3, "p", "k", 10, 11, ""), (2, "p", "k", 9, 10, "")]
    got = as_known(spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH))
    assert [tuple(r) for r in got.collect()] == [(1, 4)]


def test_empty(spark):
    for events, changes in (([], []), ([(1, "p", 1, "")], []), ([], [(1, "p", "k", 1, 1, "")])):
        assert as_known(spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH)).count() == 0


def test_many_events_for_few_changes(spark):
    # one bucket's worth of changes and many events: no task takes them all
    from pyspark.sql import functions as F

    events = spark.range(200_000).select(F.col("id").alias("event_id"), F.concat(F.lit("p"), F.col("id") % 50).alias("entity"), (F.col("id") * 1000).alias("at"))
    changes = spark.range(500).select("id", F.concat(F.lit("p"), F.col("id") % 50).alias("entity"), F.lit("k").alias("kind"), (F.col("id") * 1000).alias("happened"), F.lit(0).cast("bigint").alias("known"))
    found = as_known(events, changes, slice_us=1_000_000)
    assert found.count() == 200_000 - 0
    assert buckets_for(spark, 2_001_000) >= 100 and buckets_for(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_task = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 150_000
