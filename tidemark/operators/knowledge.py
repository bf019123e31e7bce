"""Records as they were known at an event's time.

A change counts for an event when it had happened and was known by then, so it
becomes eligible at the later of the two moments. Of the eligible changes of a
kind the one that happened last wins; of several, the one known last, then the
smallest id. A change that becomes eligible later can only replace the winner so
far, so the winner at any moment is a running maximum in eligibility order, and
an event finds it by binary search.

Entities are cut into slices of time. The winner of all earlier slices enters a
slice as one carried change per kind, so neither a hot entity nor its history is
ever gathered in one task: a slice holds at most one change per moment and kind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import keep

_EARLIEST = -(1 << 62)
#: Width of a time slice, about twelve days.
SLICE_US = 1_048_576_000_000
#: Rows of both sides that one group handles on average.
ROWS_PER_BUCKET = 20_000


def buckets_for(spark: SparkSession, rows: int) -> int:
    """How many groups so many rows are spread over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_BUCKET)


def _lookup(events: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """The winning change of each kind for every event; both sides hold many (entity, slice) groups."""
    empty = pd.DataFrame({"event_id": pd.Series(dtype="int64"), "change_id": pd.Series(dtype="int64")})
    if events.empty or changes.empty:
        return empty
    n = len(changes)
    both = pd.concat([changes[["entity", "slice"]], events[["entity", "slice"]]], ignore_index=True)
    group = both.groupby(["entity", "slice"], sort=False).ngroup().to_numpy()
    kinds, _ = pd.factorize(changes["kind"])
    width = int(kinds.max()) + 1
    key, eligible = group[:n].astype(np.int64) * width + kinds, changes["eligible"].to_numpy()
    order = np.lexsort((eligible, key))
    key, eligible = key[order], eligible[order]
    happened, known, ident = (changes[c].to_numpy()[order] for c in ("happened", "known", "id"))
    by_rank = np.lexsort((-ident, known, happened))
    rank = np.empty(n, dtype=np.int64)
    rank[by_rank] = np.arange(n)
    # Groups ascend, so an offset per group restarts the running maximum.
    winner = by_rank[np.maximum.accumulate(rank + key * n) - key * n]
    moments = np.unique(eligible)
    place = key * (len(moments) + 1) + np.searchsorted(moments, eligible)
    until = np.searchsorted(moments, events["at"].to_numpy(), side="right")
    found = []
    for kind in range(width):
        own = group[n:].astype(np.int64) * width + kind
        k = np.searchsorted(place, own * (len(moments) + 1) + until, side="left") - 1
        hit = (k >= 0) & (key[np.maximum(k, 0)] == own)
        found.append(pd.DataFrame({"event_id": events["event_id"].to_numpy()[hit], "change_id": ident[winner[k[hit]]]}))
    return pd.concat(found, ignore_index=True)


def as_known(
    events: DataFrame, changes: DataFrame, buckets: int | None = None, slice_us: int = SLICE_US
) -> DataFrame:
    """Join each event with the latest change of each kind that was valid and known at its time.

    ``events`` has (event_id bigint, entity, at bigint); ``changes`` has
    (id bigint, entity, kind, happened bigint, known bigint); times are
    microseconds. Rows with a null in any of these are left out; other columns
    are ignored. Equal moments count as known. Returns (event_id, change_id), at
    most one row per event and kind; events without an eligible change have none.
    An event given twice is answered twice. ``buckets`` is the number of groups
    of entities' slices that are handed to Python one at a time; by default it
    follows the rows of both sides, and is no less than the shuffle's partitions.
    What several branches read is kept until ``session.release``.
    """
    ev = events.select("event_id", F.col("entity").cast("string").alias("entity"), "at").dropna()
    ch = changes.select(
        F.col("entity").cast("string").alias("entity"), F.col("kind").cast("string").alias("kind"), "happened", "known", "id"
    ).dropna()
    if buckets is None:
        buckets = buckets_for(events.sparkSession, ev.count() + ch.count())
    ev = ev.withColumn("slice", F.expr(f"floor(at / {slice_us})"))
    # One change per moment: map-side combine, so repeats of a hot entity shrink before the shuffle.
    ch = keep(
        ch.groupBy("entity", "kind", F.greatest("happened", "known").alias("eligible"))
        .agg(F.max(F.struct("happened", "known", (-F.col("id")).alias("minus"))).alias("best"))
        .withColumn("slice", F.expr(f"floor(eligible / {slice_us})"))
    )
    needed = ev.select("entity", "slice").distinct()
    summary = ch.groupBy("entity", "kind", "slice").agg(F.max("best").alias("best"))
    asked = needed.join(summary.select("entity", "kind").distinct(), "entity").select(
        "entity", "kind", "slice", F.lit(None).cast(summary.schema["best"].dataType).alias("best"), F.lit(0).alias("side")
    )
    past = Window.partitionBy("entity", "kind").orderBy("slice", "side").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        asked.unionByName(summary.withColumn("side", F.lit(1)))
        .withColumn("best", F.max("best").over(past))
        .where("side = 0 AND best IS NOT NULL")
        .withColumn("eligible", F.lit(_EARLIEST))
    )
    columns = ["entity", "slice", "kind", "eligible", F.col("best.happened").alias("happened"), F.col("best.known").alias("known"), (-F.col("best.minus")).alias("id")]
    offered = ch.join(needed, ["entity", "slice"], "left_semi").select(*columns).unionByName(carried.select(*columns))
    bucket = F.expr(f"pmod(xxhash64(entity, slice), {buckets})").alias("bucket")
    return (
        ev.withColumn("bucket", bucket)
        .groupBy("bucket")
        .cogroup(offered.withColumn("bucket", bucket).groupBy("bucket"))
        .applyInPandas(_lookup, "event_id bigint, change_id bigint")
    )
