"""Grouped operators: conflicts, reconciliation, deduplication, gates and tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import normal_part, uuid5


def long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n) for each column; nulls are counted as a value of their own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(pairs).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def conflicts(df: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """Keys with more than one distinct payload; null payloads do not count."""
    return df.groupBy(*keys).agg(F.countDistinct(F.sha2(payload, 256)).alias("payloads"), F.count("*").alias("n")).where("payloads > 1")


def reconcile(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One fact per key: unknown without value, known with one, conflict with several; the latest value and all candidates go with it."""
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("_all"), latest.alias("_latest")).select(
        key,
        F.when(F.size("_all") == 0, "unknown").when(F.size("_all") == 1, "known").otherwise("conflict").alias("status"),
        F.when(F.size("_all") > 0, F.col("_latest")).alias("value"),
        F.array_join("_all", "|").alias("candidates"),
    )


def dedup_map(df: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """(ident, kept, copies): for each row the smallest id with the same keys, and how many rows share them. Equal nulls are equal."""
    groups = df.groupBy(*keys).agg(F.min(ident).alias("kept"), F.count("*").alias("copies"))
    same = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = c if same is None else same & c
    return df.alias("a").join(groups.alias("b"), same).select(F.col(f"a.{ident}").alias(ident), "kept", "copies")


def dominant_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, top, share_permille): how much the commonest value of each key takes."""
    return (
        df.groupBy(key, value).agg(F.count("*").alias("_n")).groupBy(key)
        .agg(F.sum("_n").alias("n"), F.max("_n").alias("top")).withColumn("share_permille", F.expr("top * 1000 div greatest(n, 1)"))
    )


def agreement(df: DataFrame, key: str, answer: str, least: int = 2) -> DataFrame:
    """(key, valid, agreed): the largest count of one answer among the valid ones, null with fewer than ``least``."""
    shares = dominant_share(df.where(F.col(answer).isNotNull()), key, answer)
    return df.select(key).distinct().join(shares, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("valid"), F.when(F.col("n") >= least, F.col("top")).alias("agreed")
    )


def gates(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """For each key whether all rows pass each rule, and whether all rules hold; a null result fails."""
    out = df.groupBy(key).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules])
    return out.withColumn("passed", F.expr(" AND ".join(name for name, _ in rules)))


def completeness(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, filled_permille, grade): share of fields filled; grade A from 800, B from 500, else C."""
    filled = sum(((F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").cast("bigint") for f in fields), F.lit(0).cast("bigint"))
    return df.groupBy(key).agg(F.sum(filled).alias("_f"), F.count("*").alias("_n")).select(
        key, F.expr(f"_f * 1000 div (_n * {len(fields)})").alias("filled_permille")
    ).withColumn("grade", F.when(F.col("filled_permille") >= 800, "A").when(F.col("filled_permille") >= 500, "B").otherwise("C"))


def flag_score(flags: Column, weights: Sequence[tuple[str, int]], bonuses: Sequence[tuple[Sequence[str], int]] = ()) -> Column:
    """Weighted sum of the flags in an array, with bonuses for flags that stand together."""
    total = F.lit(0)
    for flag, weight in weights:
        total = total + F.when(F.array_contains(flags, flag), weight).otherwise(0)
    for group, bonus in bonuses:
        total = total + F.when(F.size(F.array_intersect(flags, F.array(*map(F.lit, group)))) == len(group), bonus).otherwise(0)
    return total.cast("bigint")


def precedence(value: Column, order: Sequence[str]) -> Column:
    """Of a group's values the first in ``order``; null where none stands in it."""
    rank = F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)])
    return F.element_at(F.array(*map(F.lit, order)), F.min(rank).cast("int") + 1)


def scopes(df: DataFrame, rules: Sequence[tuple[str, Column]], key: str) -> DataFrame:
    """(scope, key, n): counts by key over several overlapping subsets in one pass."""
    own = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return df.select(F.col(key), F.explode(own).alias("scope")).groupBy("scope", key).agg(F.count("*").alias("n"))


def tally(df: DataFrame, reasons: Sequence[tuple[str, Column]], passed: str = "included") -> DataFrame:
    """(reason, n): the first rule that holds gives a row's reason."""
    out = None
    for name, rule in reasons:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return df.select(out.otherwise(passed).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def ordered_distinct(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(key, values): the distinct values of a key in the order in which they first come; nulls are left out.

    The first place of each value is a map-side minimum, so repeats shrink before the shuffle.
    """
    firsts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_first"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_first", value))).alias("_v")).select(key, F.transform("_v", lambda v: v[value]).alias("values"))


def distinct_facts(df: DataFrame, keys: Sequence[str], order: str, namespace: str) -> DataFrame:
    """The first row of each combination of keys, compared trimmed and in lower case, with a ``fact_uid`` made of them; contradicting facts stay side by side."""
    parts = [normal_part(F.col(k)) for k in keys]
    named = df.select("*", *[p.alias(f"_n{i}") for i, p in enumerate(parts)])
    rest = [c for c in df.columns if c != order]
    first = named.groupBy(*[f"_n{i}" for i in range(len(keys))]).agg(F.min(F.struct(order, *rest)).alias("r"))
    return first.select(uuid5(namespace, F.concat_ws("|", *[f"_n{i}" for i in range(len(keys))])).alias("fact_uid"), "r.*")


def presented_once(df: DataFrame, same: Sequence[Column], ident: str) -> DataFrame:
    """(ident, refs): records that read alike shown once under their smallest id, with the ids of all of them."""
    return df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(same)]).agg(F.min(ident).alias(ident), F.array_sort(F.collect_set(ident)).alias("_refs")).select(ident, F.array_join(F.transform("_refs", lambda r: r.cast("string")), ";").alias("refs"))


def top_counts(df: DataFrame, value: str, n: int) -> DataFrame:
    """(value, n): the commonest values, ties by value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(n)


def any_gates(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """For each key whether any row meets each rule; a null result does not."""
    return df.groupBy(key).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules])


def statuses(df: DataFrame, key: str, fields: Sequence[str], absent: Sequence[str] = ("无", "none")) -> DataFrame:
    """(key, field, status, value) of every key and field: unknown without value, conflict with several, absent where it says so, else present; the smallest value goes with it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("value")) for f in fields])).alias("x")
    grouped = df.select(key, pairs).groupBy(key, "x.field").agg(F.min("x.value").alias("value"), F.max("x.value").alias("_last"))
    status = F.when(F.col("value").isNull(), "unknown").when(F.col("value") != F.col("_last"), "conflict").when(F.col("value").isin(*absent), "absent").otherwise("present")
    return grouped.select(key, "field", status.alias("status"), "value")


def status_grades(held: DataFrame, key: str, high: Sequence[str], most_unknown: int = 2) -> DataFrame:
    """(key, score_permille, unknown_high, grade) from statuses: present and absent count whole, a conflict half; A from 750 with few unknowns among the high fields, B from 500, else C."""
    score = F.when(F.col("status").isin("present", "absent"), 1000).when(F.col("status") == "conflict", 500).otherwise(0)
    unknown = F.count_if((F.col("status") == "unknown") & F.col("field").isin(*high))
    out = held.groupBy(key).agg(F.sum(score).alias("_s"), F.count("*").alias("_n"), unknown.alias("unknown_high")).withColumn("score_permille", F.expr("_s div _n"))
    return out.select(key, "score_permille", "unknown_high", F.when((F.col("score_permille") >= 750) & (F.col("unknown_high") <= most_unknown), "A").when(F.col("score_permille") >= 500, "B").otherwise("C").alias("grade"))


def united(df: DataFrame, key: str, flags: str) -> DataFrame:
    """(key, flags): the union of the flag arrays of a key, sorted. Flags are made distinct before the shuffle."""
    return df.select(key, F.explode(flags).alias("_f")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_f")).alias(flags))


def level(appropriate: Column, preventable: Column) -> Column:
    """HIGH, MEDIUM, LOW or NONE from two scores of 0 to 3; null where one is missing or the scores fit none."""
    none = (preventable == 0) | (appropriate == 0)
    return F.when(none, "LEVEL_NONE").when((appropriate >= 2) & (preventable == 3), "LEVEL_HIGH").when((appropriate >= 2) & (preventable == 2), "LEVEL_MEDIUM").when((appropriate >= 1) & (preventable == 1), "LEVEL_LOW")


def selective_curve(df: DataFrame, score: Column, hit: Column, gates: Sequence[int]) -> DataFrame:
    """(gate, covered, hits, coverage_permille, rate_permille): what passes each gate and how often it is right, in one pass."""
    own = F.filter(F.array(*[F.lit(g).cast("bigint") for g in gates]), lambda g: score >= g)
    rows = df.select(F.explode(F.array_union(own, F.array(F.lit(-1).cast("bigint")))).alias("gate"), F.coalesce(hit, F.lit(False)).alias("_hit"))
    counts = rows.groupBy("gate").agg(F.count("*").alias("covered"), F.count_if("_hit").alias("hits"))
    whole = counts.where("gate = -1").select(F.col("covered").alias("_all"))
    return counts.where("gate <> -1").join(F.broadcast(whole)).select("gate", "covered", "hits", F.expr("covered * 1000 div greatest(_all, 1)").alias("coverage_permille"), F.expr("hits * 1000 div greatest(covered, 1)").alias("rate_permille"))


def tier(rules: Sequence[tuple[str, Column]], other: str) -> Column:
    """The name of the first rule that holds; a null result does not."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit(other))


def source_map(df: DataFrame, ident: str, keys: Sequence[str], source: str) -> DataFrame:
    """(keys, kept, source_count, source_map): equal reports once, with where each of their rows is from."""
    named = F.struct(ident, F.concat(F.col(ident).cast("string"), F.lit("="), F.coalesce(source, F.lit(""))).alias("_s"))
    rows = df.groupBy(*keys).agg(F.min(ident).alias("kept"), F.count("*").alias("source_count"), F.array_sort(F.collect_list(named)).alias("_m"))
    return rows.select(*keys, "kept", "source_count", F.array_join(F.transform("_m", lambda r: r["_s"]), ";").alias("source_map"))
