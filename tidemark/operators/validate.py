"""Validation of outputs against declarative rules, and lineage of datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strict_json


@dataclass(frozen=True)
class Field:
    """A rule for one top-level field of a JSON object."""

    name: str
    kind: str = "string"  # string, number or array
    required: bool = True
    values: tuple[str, ...] = ()
    least: int = 0
    most: int | None = None


def schema_errors(text: Column, fields: Sequence[Field], closed: bool = True) -> Column:
    """The paths of a JSON text's violations, sorted; ``$`` where it is no strict JSON object."""
    value = F.try_parse_json(text)
    errors: list[Column] = []
    for f in fields:
        raw = F.try_variant_get(value, f"$.{f.name}", "array<string>" if f.kind == "array" else "double" if f.kind == "number" else "string")
        there = F.try_variant_get(value, f"$.{f.name}", "variant").isNotNull()
        wrong = F.lit(False)
        if f.kind == "array":
            wrong = raw.isNull() | (F.size(raw) < f.least) | (F.size(F.array_distinct(raw)) < F.size(raw))
            if f.most is not None:
                wrong = wrong | (F.size(raw) > f.most)
        elif f.kind == "string":
            wrong = raw.isNull() | (F.length(raw) < f.least)
            if f.values:
                wrong = wrong | ~raw.isin(*f.values)
            if f.most is not None:
                wrong = wrong | (F.length(raw) > f.most)
        else:
            wrong = raw.isNull()
        errors.append(F.when(~there, F.lit(f"$.{f.name}") if f.required else F.lit(None).cast("string")).when(wrong, F.lit(f"$.{f.name}")))
    if closed:
        extra = F.array_except(F.json_object_keys(text), F.array(*[F.lit(f.name) for f in fields]))
        errors.append(F.when(F.size(extra) > 0, F.lit("$+")))
    return F.when(~strict_json(text), F.array(F.lit("$"))).otherwise(F.array_sort(F.array_compact(F.array(*errors))))


def cited_within(cited: Column, visible: Column) -> Column:
    """Whether every cited id is among the visible ones; null arrays are empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(cited, none), F.coalesce(visible, none))) == 0


def inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, filled, distinct_values): a manifest of a table, in one pass."""
    whole = F.count("*").alias("rows")
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.countDistinct(c).alias("distinct_values")) for c in columns]
    return df.agg(whole, F.array(*parts).alias("x")).select("rows", F.explode("x").alias("x")).select("x.column", "rows", "x.filled", "x.distinct_values")


def frozen_differences(frozen: DataFrame, rebuilt: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that differ between a frozen dataset and its rebuild: the columns that differ, ``missing`` where the rebuild lacks the row, ``extra`` where only it has it."""
    a = frozen.select(*keys, F.struct(*columns).alias("_a"), F.lit(True).alias("_in_a"))
    b = rebuilt.select(*keys, F.struct(*columns).alias("_b"), F.lit(True).alias("_in_b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    differs = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").otherwise(F.array_join(names, ","))
    return a.join(b, list(keys), "full_outer").withColumn("differs", differs).where("differs <> ''").select(*keys, "differs")


def key_violations(df: DataFrame, key: str, entity: str) -> DataFrame:
    """(key, problem): keys with several entities, or with none."""
    grouped = df.groupBy(key).agg(F.min(entity).alias("_a"), F.max(entity).alias("_b"))
    return grouped.select(key, F.when(F.col("_a").isNull(), "unmapped").when(F.col("_a") != F.col("_b"), "ambiguous").alias("problem")).where("problem IS NOT NULL")


def coverage_gaps(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has; empty where they cover the same."""
    a, b = wanted.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def overlaps(df: DataFrame, part: str, key: str) -> DataFrame:
    """(part_a, part_b, n): how many keys two parts share, for parts that share any. A key's parts are few and meet within it."""
    parts = df.select(key, part).dropna().distinct().groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("_p")).where(F.size("_p") > 1)
    pairs = F.flatten(F.transform("_p", lambda a, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda b: F.struct(a.alias("part_a"), b.alias("part_b")))))
    return parts.select(F.explode(pairs).alias("x")).groupBy("x.part_a", "x.part_b").agg(F.count("*").alias("n"))


def violations(df: DataFrame, ident: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(ident, rule) for each rule a row breaks; a rule that gives null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))
    return df.select(ident, F.explode(broken).alias("rule"))


@dataclass(frozen=True)
class Contract:
    """What a table must be: its grain, the columns that must be filled, and the values some may take."""

    grain: tuple[str, ...]
    filled: tuple[str, ...] = ()
    values: tuple[tuple[str, tuple[str, ...]], ...] = ()


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, rows): how many rows break each rule of a contract, all of its rules in two passes."""
    rules = [(f"filled:{c}", F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")) for c in contract.filled]
    rules += [(f"values:{c}", F.col(c).isNull() | F.col(c).isin(*values)) for c, values in contract.values]
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules]) if rules else None
    repeated = df.groupBy(*contract.grain).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).select(F.lit("grain").alias("rule"), "rows")
    if counts is None:
        return repeated
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("rows")) for name, _ in rules])).alias("x")).select("x.*").unionByName(repeated)


def output_errors(case_id: Column, step: Column, output: Column, terminal: dict[str, str]) -> Column:
    """The first rule that a decision in a sequence breaks, null where none; ``output`` is a struct (case_id, step, mode, action, target_gap_id, gain, gaps), gaps an array of (gap_id).

    A terminal action must have its own mode, claim no gain and name no target;
    any other must pause, name one of its gaps and estimate a gain.
    """
    ids = F.transform(output["gaps"], lambda g: g["gap_id"])
    modes = F.create_map(*[F.lit(x) for pair in terminal.items() for x in pair])
    last = F.array_contains(F.array(*map(F.lit, terminal)), output["action"])
    rules = [
        ("CASE_OR_STEP", (output["case_id"] == case_id) & (output["step"] == step)),
        ("GAP_IDS", F.size(F.array_distinct(ids)) == F.size(ids)),
        ("TERMINAL_MODE", ~last | (output["mode"] == F.element_at(modes, output["action"]))),
        ("TERMINAL_GAIN", ~last | (output["gain"] == "NOT_APPLICABLE")),
        ("TERMINAL_TARGET", ~last | output["target_gap_id"].isNull()),
        ("ACQUISITION_TARGET", last | ((output["mode"] == "PAUSE_FOR_EVIDENCE") & F.array_contains(ids, output["target_gap_id"]))),
        ("ACQUISITION_GAIN", last | (output["gain"] != "NOT_APPLICABLE")),
    ]
    return F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])


def text_alarms(df: DataFrame, ident: str, text: str, patterns: Sequence[tuple[str, str]], literals: Sequence[str] = ()) -> DataFrame:
    """(ident, alarm): forbidden patterns and literals that a text holds."""
    tests = [(name, F.col(text).rlike(pattern)) for name, pattern in patterns] + [(f"literal:{x}", F.contains(text, F.lit(x))) for x in literals]
    return df.select(ident, F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))).alias("alarm"))


def preflight(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, expected, actual, delta) for every expected or counted name; ``counts`` has (name, actual)."""
    base = counts.sparkSession.createDataFrame(list(expected.items()), "name string, expected bigint")
    return base.join(counts, "name", "full_outer").withColumn("delta", F.coalesce("actual", F.lit(0)) - F.coalesce("expected", F.lit(0))).select("name", "expected", "actual", "delta")
