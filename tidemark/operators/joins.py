"""Temporal and keyed joins.

No temporal join pairs the rows of an entity: events and changes are put in one
order, and what an event looks for is a running maximum, minimum or count over
it. Entities are cut into slices of time; what the slices before (or behind) hold
enters a slice as one value, so a hot entity is spread over as many tasks as it
has slices. Only intervals, which have two ends, are met by equality on entity
and slice with the range as residual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of time: weeks.
SLICE = "WEEK"


def running(rows: DataFrame, value: Column, how: str, forward: bool = False) -> DataFrame:
    """Add ``run``: the max, min or sum of ``value`` over the rows of the same ``k`` up to this one in the order of (t, side), or from it on.

    ``rows`` has k, t and side, the first two not null.
    """
    combine = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    sliced = rows.withColumn("_slice", F.date_trunc(SLICE, "t")).withColumn("_v", value)
    inside = Window.partitionBy("k", "_slice").orderBy("t", "side")
    inside = inside.rowsBetween(0, Window.unboundedFollowing) if forward else inside.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("k").orderBy("_slice")
    across = across.rowsBetween(1, Window.unboundedFollowing) if forward else across.rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("k", "_slice").agg(combine("_v").alias("_v")).select("k", "_slice", combine("_v").over(across).alias("_carried"))
    own = sliced.withColumn("_own", combine("_v").over(inside)).join(carried, ["k", "_slice"])
    whole = {"max": F.greatest("_own", "_carried"), "min": F.least("_own", "_carried"), "sum": F.coalesce("_own", F.lit(0)) + F.coalesce("_carried", F.lit(0))}[how]
    return own.withColumn("run", whole).drop("_slice", "_v", "_own", "_carried")


def _placed(df: DataFrame, on: str, at: str | Column, side: int, **columns: Column) -> DataFrame:
    return df.select(F.col(on).alias("k"), (F.col(at) if isinstance(at, str) else at).alias("t"), F.lit(side).alias("side"), *[c.alias(n) for n, c in columns.items()]).where("k IS NOT NULL AND t IS NOT NULL")


def _null(df: DataFrame, column: str) -> Column:
    return F.lit(None).cast(df.schema[column].dataType)


def _beside(events: DataFrame, changes: DataFrame, on: str, event_id: str, at: str | Column, changed: str, change_id: str, forward: bool, strict: bool = False) -> DataFrame:
    """(e, a, t, c): for each placed event the nearest change before it, or behind it; that very moment counts unless ``strict``.

    Of changes at one moment the larger id counts looking back, the smaller looking forward.
    """
    # changes at the same moment stand before an event looking back and behind it looking forward, or else the other way
    side = int(forward) if strict else int(not forward)
    ev = _placed(events, on, at, side, e=F.col(event_id), c=_null(changes, change_id))
    ch = _placed(changes, on, changed, 1 - side, e=_null(events, event_id), c=F.col(change_id))
    value = F.when(F.col("side") == 1 - side, F.struct("t", "c"))
    found = running(ev.unionByName(ch), value, "min" if forward else "max", forward).where(f"side = {side}")
    return found.select("e", F.col("t").alias("a"), F.col("run.t").alias("t"), F.col("run.c").alias("c"))


def asof_backward(events: DataFrame, changes: DataFrame, on: str, event_id: str, at: str, changed: str, change_id: str, days: int | None = None) -> DataFrame:
    """The latest change at or before each event.

    Returns (event_id, change_id), change_id null where there is none within
    ``days``. Ties go to the larger change id. Changes without entity or time are
    left out; such events find nothing, and take no part in the search.
    """
    found = _beside(events, changes, on, event_id, at, changed, change_id, forward=False)
    hit = F.col("c") if days is None else F.when(F.col("t") >= F.col("a") - F.expr(f"INTERVAL '{days}' DAY"), F.col("c"))
    lost = events.where(F.col(on).isNull() | F.col(at).isNull()).select(F.col(event_id), _null(changes, change_id).alias(change_id))
    return found.select(F.col("e").alias(event_id), hit.alias(change_id)).unionByName(lost)


def nearest(left: DataFrame, right: DataFrame, on: str, left_id: str, at: str, right_id: str, time: str, before: int, behind: int) -> DataFrame:
    """The right row nearest to each left row from ``before`` days earlier to ``behind`` days later.

    Ties go to the earlier one, then the smaller id. Returns (left_id, right_id,
    gap_us) for left rows that have one; left ids are taken as unique.
    """
    # of rows at one moment only the smallest id can win
    firsts = right.groupBy(F.col(on).alias("_on"), F.col(time).alias("_time")).agg(F.min(right_id).alias("_id"))
    sides = [_beside(left.withColumnRenamed(on, "_on"), firsts, "_on", left_id, at, "_time", "_id", forward) for forward in (False, True)]
    gap = F.expr("timestampdiff(MICROSECOND, a, t)")
    near = sides[0].unionByName(sides[1]).where("c IS NOT NULL").withColumn("g", gap).where(F.col("g").between(-before * 86_400_000_000, behind * 86_400_000_000))
    best = near.groupBy("e").agg(F.min(F.struct(F.abs("g").alias("d"), "g", "c")).alias("m"))
    return best.select(F.col("e").alias(left_id), F.col("m.c").alias(right_id), F.col("m.g").alias("gap_us"))


def first_within(left: DataFrame, right: DataFrame, on: str, left_id: str, at: str, right_id: str, time: str, days: int, behind: bool = True) -> DataFrame:
    """The earliest right row within ``days`` behind each left row (or before it). Ties go to the smaller id."""
    span = F.expr(f"INTERVAL '{days}' DAY")
    start = F.col(at) if behind else F.col(at) - span
    found = _beside(left, right, on, left_id, start, time, right_id, forward=True, strict=behind)
    inside = F.col("t") <= F.col("a") + span if behind else F.col("t") < F.col("a") + span
    return found.where(inside).select(F.col("e").alias(left_id), F.col("c").alias(right_id), F.col("t").alias("found_at"))


def counts_between(left: DataFrame, right: DataFrame, on: str, left_id: str, time: str, start: Column, end: Column, with_start: bool = False, with_end: bool = False) -> DataFrame:
    """(left_id, n): how many right rows of the same entity lie between two moments of each left row; zero without entity or moment.

    Left ids are taken as unique.
    """
    # a boundary stands before the rows of its own moment, or behind them
    marks = left.select(F.col(on).alias("_on"), F.col(left_id).alias("_e"), start.alias("_start"), end.alias("_end"))
    first = _placed(marks, "_on", "_start", 0 if with_start else 2, e=F.col("_e"), sign=F.lit(-1))
    last = _placed(marks, "_on", "_end", 2 if with_end else 0, e=F.col("_e"), sign=F.lit(1))
    rows = _placed(right, on, time, 1, e=_null(left, left_id), sign=F.lit(0))
    both = marks.where("_start IS NOT NULL AND _end IS NOT NULL AND _start <= _end").select(F.col("_e").alias("e"))
    counted = running(first.unionByName(last).unionByName(rows), F.when(F.col("side") == 1, 1).otherwise(0), "sum").where("side <> 1")
    n = counted.join(both, "e", "left_semi").groupBy("e").agg(F.greatest(F.sum(F.col("run") * F.col("sign")), F.lit(0)).alias("n"))
    return left.select(F.col(left_id).alias("e")).join(n, "e", "left").select(F.col("e").alias(left_id), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def shortest_interval(points: DataFrame, intervals: DataFrame, on: str, point_id: str, at: str, interval_id: str, start: str, end: str) -> DataFrame:
    """The shortest interval that contains each point, then the smallest id.

    An interval without end is as long as its first moment; reversed intervals
    and those without start contain nothing. Intervals are entered in every slice
    they touch, so a point meets those of its own slice only. Returns (point_id,
    interval_id).
    """
    whole = intervals.withColumn("_until", F.coalesce(end, start)).where(F.col("_until") >= F.col(start))
    week = F.expr("INTERVAL '7' DAY")
    entered = whole.withColumn("_slice", F.explode(F.sequence(F.date_trunc(SLICE, F.col(start)), F.date_trunc(SLICE, F.col("_until")), week)))
    asked = points.where(F.col(at).isNotNull()).withColumn("_slice", F.date_trunc(SLICE, F.col(at)))
    inside = asked.alias("l").join(entered.alias("r"), (F.col(f"l.{on}") == F.col(f"r.{on}")) & (F.col("l._slice") == F.col("r._slice")) & F.col(f"l.{at}").between(F.col(f"r.{start}"), F.col("r._until")))
    length = F.expr(f"timestampdiff(SECOND, r.{start}, r._until)")
    return (
        inside.groupBy(F.col(f"l.{point_id}").alias(point_id))
        .agg(F.min(F.struct(length.alias("n"), F.col(f"r.{interval_id}").alias("i"))).alias("m"))
        .select(point_id, F.col("m.i").alias(interval_id))
    )


def unambiguous(aliases: DataFrame, alias: str, entity: str) -> DataFrame:
    """Aliases that stand for exactly one entity; null aliases and entities are left out."""
    return aliases.where(F.col(alias).isNotNull() & F.col(entity).isNotNull()).groupBy(alias).agg(F.min(entity).alias(entity), F.max(entity).alias("_other")).where(F.col(entity) == F.col("_other")).drop("_other")


def last_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the last under ``order``; a null key is a key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keyed(value: Column) -> Column:
    """A free identifier as a join key: without a trailing ``.0``, upper case, letters and digits only; blank gives null."""
    return F.nullif(F.regexp_replace(F.upper(F.regexp_replace(F.trim(value), r"\.0$", "")), "[^A-Z0-9]", ""), F.lit(""))


def diff(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """What became of each key between two versions: added, removed, changed or same. Keys are taken as unique."""
    o, n = old.select(F.col(key), F.col(body).alias("_old"), F.lit(True).alias("_in_old")), new.select(F.col(key), F.col(body).alias("_new"), F.lit(True).alias("_in_new"))
    return o.join(n, key, "full_outer").select(
        key, F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("same").alias("change")
    )


def exists_with_aliases(rows: DataFrame, key: str, day: str, aliases: DataFrame, inventory: DataFrame) -> DataFrame:
    """``rows`` with ``known``: whether the key or any of its aliases stands in the inventory on that day.

    ``aliases`` has (key, alias), ``inventory`` (key, day); all names are values of one kind.
    """
    names = aliases.select(F.col(key).alias("_k"), F.col("alias").alias("_name")).unionByName(rows.select(F.col(key).alias("_k"), F.col(key).alias("_name"))).dropna().distinct()
    hits = names.join(inventory.select(F.col(key).alias("_name"), F.col(day).alias("_day")).distinct(), "_name").select("_k", "_day").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, (F.col(key) == F.col("_k")) & (F.col(day) == F.col("_day")), "left").withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_k", "_day", "_hit")


def by_first_key(rows: DataFrame, details: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the details under the first key that finds some; of several details the smallest value counts."""
    found = None
    out = rows
    for i, k in enumerate(keys):
        side = details.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(side, F.col(k) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found = F.col(f"_v{i}") if found is None else F.coalesce(found, F.col(f"_v{i}"))
    return out.withColumn(value, found).drop(*[f"_v{i}" for i in range(len(keys))])


def fetched(rows: DataFrame, texts: DataFrame, hashed: Column, key: str, order: str, text: str, clean: Column | None = None) -> DataFrame:
    """``rows`` with the text under a derived hash key: the first text of each key in order, '' where there is none, cleaned as it is read."""
    first = texts.groupBy(F.col(key).alias("_key")).agg(F.min_by(clean if clean is not None else F.col(text), order).alias("_text"))
    return rows.join(first, hashed == F.col("_key"), "left").withColumn(text, F.coalesce("_text", F.lit(""))).drop("_key", "_text")


def said_near(actions: DataFrame, texts: DataFrame, on: str, action_id: str, day: str, word: str, text_id: str, at: str, text: str, days: int = 1) -> DataFrame:
    """(action_id, text_id): the earliest text within ``days`` of an action's day that contains the action's word.

    A text is entered under each day it can serve, so the join is an equality on
    entity and day.
    """
    reach = F.explode(F.sequence(F.date_sub(F.to_date(at), days), F.date_add(F.to_date(at), days)))
    entered = texts.where(F.col(at).isNotNull()).select(F.col(on).alias("_on"), F.col(text_id).alias("_id"), F.col(at).alias("_at"), F.col(text).alias("_text"), reach.alias("_day"))
    hit = actions.join(entered, (F.col(on) == F.col("_on")) & (F.to_date(day) == F.col("_day")) & F.contains("_text", F.col(word)))
    return hit.groupBy(action_id).agg(F.min(F.struct("_at", "_id")).alias("m")).select(action_id, F.col("m._id").alias(text_id))


def by_position(df: DataFrame, places: dict[int, str]) -> DataFrame:
    """Columns taken by their position and renamed; positions the table has not come out as null text."""
    return df.select(*[(F.col(f"`{df.columns[i]}`") if i < len(df.columns) else F.lit(None).cast("string")).alias(name) for i, name in places.items()])


def looked_up(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The entry of a small table for a value, or the default."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(entries[value], F.lit(default))


def rule_rows(cases: DataFrame, rules: DataFrame, ids: str, rule_id: str, text: str) -> DataFrame:
    """Each case with the texts of the rules it names, in rule order, joined by ``; ``; unknown rules are left out."""
    named = cases.withColumn("_rule", F.explode_outer(ids)).join(rules.select(F.col(rule_id).alias("_rule"), F.col(text).alias("_text")), "_rule", "left")
    return named.groupBy(*[c for c in cases.columns if c != ids]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_rule", "_text")))), lambda r: r["_text"]), "; ").alias("guidance"))


def preferred(aliases: DataFrame, alias: str, entity: str, source: str, order: Sequence[str]) -> DataFrame:
    """One entity per alias, from the source that stands first in ``order``, then the smallest entity."""
    rank = F.coalesce(*[F.when(F.col(source) == s, i) for i, s in enumerate(order)], F.lit(len(order)))
    return aliases.where(F.col(alias).isNotNull() & F.col(entity).isNotNull()).groupBy(alias).agg(F.min(F.struct(rank.alias("r"), F.col(entity).alias("e")))["e"].alias(entity))


def change_classes(old: DataFrame, new: DataFrame, key: str, body: str, metadata: Sequence[str]) -> DataFrame:
    """(key, change): added, removed, body, metadata, or same, by what differs between two versions of a record."""
    o = old.select(F.col(key), F.struct(F.col(body).alias("b"), F.struct(*metadata).alias("m")).alias("_o"))
    n = new.select(F.col(key), F.struct(F.col(body).alias("b"), F.struct(*metadata).alias("m")).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o.b").eqNullSafe(F.col("_n.b")), "body").when(~F.col("_o.m").eqNullSafe(F.col("_n.m")), "metadata").otherwise("same")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))
