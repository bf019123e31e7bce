"""Ordered operators over the rows of an entity, and deterministic selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def first_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key; nulls come last. A map-side minimum, no sort of the whole key."""
    rest = [c for c in df.columns if c not in order and c != key]
    ranked = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*order, *rest).alias("row"))
    return df.groupBy(key).agg(F.min(ranked)["row"].alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])


def seen_before(df: DataFrame, key: str, order: Sequence[str], flag: Column, name: str) -> DataFrame:
    """Whether an earlier row of the key has the flag; the row itself does not count."""
    past = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(F.coalesce(flag, F.lit(False))).over(past), F.lit(False)))


def transitions(df: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """(key, ident, next_id, gap_days): each row with the next one of its key, gaps in calendar days. Last rows have none."""
    w = Window.partitionBy(key).orderBy(at, ident)
    return df.select(key, F.col(ident), F.lead(ident).over(w).alias("next_id"), F.datediff(F.lead(at).over(w), F.col(at)).cast("bigint").alias("gap_days")).where("next_id IS NOT NULL")


def daily(df: DataFrame, key: str, at: str, label: str) -> DataFrame:
    """Rows of one key and calendar day merged: how many, and their labels sorted and distinct."""
    return df.where(F.col(at).isNotNull()).groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(label)), ";").alias("labels"))


def last_n(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key. Spark keeps only ``n`` rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("place", F.col("place").cast("bigint"))


def trend(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(key, n, trend): up, down or flat between the last two known values of a key, unknown with fewer."""
    latest = last_n(df.where(F.col(value).isNotNull()), key, order, 2)
    pair = latest.groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.col(value))).alias("b"), F.max(F.when(F.col("place") == 2, F.col(value))).alias("a"))
    return pair.select(key, "n", F.when(F.col("n") < 2, "unknown").when(F.col("b") > F.col("a"), "up").when(F.col("b") < F.col("a"), "down").otherwise("flat").alias("trend"))


def ranked_ids(df: DataFrame, order: Sequence[Column], prefix: str, width: int, key: str) -> DataFrame:
    """Dense ids in a global order, without a one-task window.

    The rows are range-partitioned by the order, checkpointed so that a lost
    executor cannot move a row to another part, and counted by part; each part
    numbers its own rows behind those before it. The order must be total.
    """
    ordered = df.select(key, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o")).repartitionByRange("_o").sortWithinPartitions("_o")
    ordered = cut(ordered.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy("_o")
    return ordered.join(F.broadcast(starts), "_part").select(key, F.format_string(f"{prefix}%0{width}d", F.col("_start") + F.row_number().over(inside)).alias("ranked_id"))


def quota(df: DataFrame, group: str, order: Sequence[str], limits: dict[str, int], other: int = 0) -> DataFrame:
    """The first rows of each group up to its limit. No more than the largest limit of a group pass its shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    limit = F.coalesce(*[F.when(F.col(group) == g, n) for g, n in limits.items()], F.lit(other))
    # the constant bound is what the group limit before the shuffle is made of
    near = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max([other, *limits.values()]))
    return near.where(F.col("place") <= limit).withColumn("place", F.col("place").cast("bigint"))


def hash_order(seed: str, ident: str) -> Column:
    """A reproducible random order: SHA-256 of seed and id."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")), 256)


def hash_sample(df: DataFrame, stratum: str, ident: str, seed: str, n: int) -> DataFrame:
    """``n`` rows of each stratum in hash order: the same rows on every run and cluster."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, ident), ident)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("place", F.col("place").cast("bigint"))


def split_bands(df: DataFrame, ident: str, seed: str, bands: Sequence[tuple[str, int]]) -> DataFrame:
    """Assign rows to bands by a hash of their id, in the given hundredths; the rest gets none. Needs no sort at any size."""
    cell = F.conv(F.left(hash_order(seed, ident), F.lit(8)), 16, 10).cast("bigint") % 100
    out, upper = None, 0
    for name, share in bands:
        upper += share
        out = F.when(cell < upper, name) if out is None else out.when(cell < upper, name)
    return df.withColumn("band", out)


def balanced_fill(df: DataFrame, group: str, order: Sequence[str], sizes: dict[str, int], n: int) -> DataFrame:
    """Fill ``n`` places, always from the group that is smallest so far.

    In closed form: candidates ordered by the size their group has when their
    turn comes, then by group; the first ``n``. ``sizes`` are the groups' sizes
    before the fill.
    """
    start = F.coalesce(*[F.when(F.col(group) == g, s) for g, s in sizes.items()], F.lit(0))
    # no group can give more than n, so the rest is dropped before the shuffle
    near = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= n)
    return near.withColumn("turn", (start + F.col("_place") - 1).cast("bigint")).drop("_place").orderBy("turn", group, *order).limit(n)


def allocate(df: DataFrame, group: str, n: int) -> DataFrame:
    """(group, size, places): ``n`` places shared among groups by size, whole parts first, then the largest remainders.

    Only the groups' sizes are ordered, one row per group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    total = Window.partitionBy()
    shares = sizes.withColumn("_all", F.sum("size").over(total)).withColumn("_whole", F.expr(f"size * {n} div _all")).withColumn("_rest", F.expr(f"size * {n} % _all"))
    place = F.row_number().over(Window.orderBy(F.col("_rest").desc(), group))
    left = F.lit(n) - F.sum("_whole").over(total)
    return shares.withColumn("places", (F.col("_whole") + F.when(place <= left, 1).otherwise(0)).cast("bigint")).select(group, "size", "places")


def soft_cap(df: DataFrame, group: str, order: Sequence[str], cap: int, n: int) -> DataFrame:
    """``n`` rows, no more than ``cap`` of a group as long as others are left; then the overflow in order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    near = df.withColumn("_place", place).where(F.col("_place") <= n).withColumn("over_cap", F.col("_place") > cap)
    return near.drop("_place").orderBy("over_cap", *order).limit(n)


def places(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with their ``place`` within the key and whether they are the first."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("place", place.cast("bigint")).withColumn("is_first", F.col("place") == 1)


def one_each(df: DataFrame, category: str, categories: Sequence[str], entity: str, order: Sequence[Column], cap: int) -> DataFrame:
    """Category by category the first ``cap`` rows, no entity more than once over all of them.

    The categories are few and given, so each is one step; what is taken is at
    most ``cap`` rows a category and is broadcast against the next. The order
    must be total. Rows without entity are left out.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    ranked = df.where(F.col(entity).isNotNull()).select("*", *[c.alias(k) for c, k in zip(order, keys)])
    taken: DataFrame | None = None
    for name in categories:
        own = ranked.where(F.col(category) == name)
        if taken is not None:
            own = own.join(F.broadcast(taken.select(entity)), entity, "left_anti").select(*ranked.columns)
        first = own.groupBy(entity).agg(F.min(F.struct(*keys, *[c for c in df.columns if c != entity])).alias("r")).select(entity, "r.*")
        best = cut(first.orderBy(*keys).limit(cap).select(*df.columns))
        taken = best if taken is None else taken.unionByName(best)
    return taken if taken is not None else df.where("false")


def covered(selected: DataFrame, pool: DataFrame, ident: str, group: str, tags: str, wanted: Sequence[str], seed: str) -> DataFrame:
    """A selection repaired so that every wanted tag stands in it, if the pool has one.

    For each missing tag the first row of the pool in hash order comes in, for
    the last one in hash order of the same group (of any group where none is
    left) that lacks the tag. The selection is as small as a sample and one row
    a tag comes to the driver.
    """
    for tag in wanted:
        has = F.array_contains(tags, tag)
        if selected.where(has).limit(1).count():
            continue
        fresh = pool.where(has).join(selected.select(ident), ident, "left_anti").select(*pool.columns)
        found = fresh.orderBy(hash_order(seed + tag, ident), ident).limit(1)
        if not (row := found.first()):
            continue
        same = F.col(group).eqNullSafe(F.lit(row[group]))
        old = selected.where(~F.coalesce(has, F.lit(False))).orderBy(same.desc(), hash_order(seed + "replace", ident).desc(), F.col(ident).desc()).first()
        if old is None:
            continue
        selected = cut(selected.where(F.col(ident) != old[ident]).unionByName(found))
    return selected


def allocate_to_targets(df: DataFrame, group: str, targets: dict[str, int], n: int) -> DataFrame:
    """(group, available, places): ``n`` places shared in proportion to the groups' targets, halves to the even number, no more than available; what is left goes one by one to the group that lacks most of its target, the first in order on a tie."""
    total = sum(targets.values())
    spark = df.sparkSession
    wanted = spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(targets.items())], f"`{group}` string, _target bigint, _order int")
    sizes = df.where(F.col(group).isin(*targets)).groupBy(group).agg(F.count("*").alias("available"))
    base = wanted.join(sizes, group, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    base = base.withColumn("_base", F.least("available", F.bround(F.col("_target") * n / F.lit(float(total)))).cast("bigint"))
    base = base.withColumn("_left", F.greatest(F.lit(n) - F.sum("_base").over(Window.partitionBy()), F.lit(0)))
    steps = base.where("_left > 0 AND available > _base").select(group, "_order", "_left", "_target", "_base", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_left"), F.col("available") - F.col("_base")))).alias("_k"))
    chosen = steps.withColumn("_rank", F.row_number().over(Window.orderBy((F.col("_target") - F.col("_base") - F.col("_k")).desc(), "_order", "_k"))).where("_rank <= _left")
    more = chosen.groupBy(group).agg(F.count("*").alias("_more"))
    return base.join(more, group, "left").select(group, "available", (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("places"))


def rank_bands(df: DataFrame, ident: str, seed: str, bands: Sequence[tuple[str, int]]) -> DataFrame:
    """Bands of exact sizes in hash order; rows behind the last band have none. Only the rows of the bands are ordered in one place."""
    total = sum(size for _, size in bands)
    first = df.orderBy(hash_order(seed, ident), ident).limit(total)
    place = F.row_number().over(Window.orderBy(hash_order(seed, ident), ident))
    band, upper = None, 0
    for name, size in bands:
        upper += size
        band = F.when(F.col("_place") <= upper, name) if band is None else band.when(F.col("_place") <= upper, name)
    return first.withColumn("_place", place).withColumn("band", band).drop("_place")


def best_overlap(df: DataFrame, key: str, ident: str, flags: str, wanted: Sequence[str], n: int) -> DataFrame:
    """(key, best): the ids of the ``n`` rows of each key whose flags share most with the wanted ones, more first, then the smaller id; rows that share nothing are left out."""
    shared = F.size(F.array_intersect(flags, F.array(*map(F.lit, wanted))))
    rows = last_n(df.withColumn("_shared", shared).where("_shared > 0").withColumn("_minus", -F.col(ident)), key, ["_shared", "_minus"], n)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", ident))).alias("_b")).select(key, F.array_join(F.transform("_b", lambda r: r[ident].cast("string")), ",").alias("best"))
