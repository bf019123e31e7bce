"""What was knowable at a checkpoint, and why each record counts or does not.

Every (checkpoint, record) pair of an entity gets a reason; nothing is filtered
away. The pairs of an entity are its checkpoints times its records, which is the
result itself, so the join is an equality on the entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null where none does."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])


def disposition(reason: Column, unresolved: Sequence[str]) -> Column:
    """included without a reason, unresolved for the given reasons, else excluded."""
    return F.when(reason.isNull(), "included").when(reason.isin(*unresolved), "unresolved").otherwise("excluded")


def dispositions(
    checkpoints: DataFrame, records: DataFrame, on: str, rules: Sequence[tuple[str, Column]], unresolved: Sequence[str]
) -> DataFrame:
    """Every pair of a checkpoint and a record of its entity, with reason and disposition.

    Rules are Columns over ``c`` (checkpoint) and ``r`` (record). An entity
    without records has no pairs.
    """
    reason = first_reason(rules)
    pairs = checkpoints.alias("c").join(records.alias("r"), F.col(f"c.{on}") == F.col(f"r.{on}"))
    return pairs.withColumn("reason", reason).withColumn("disposition", disposition(F.col("reason"), unresolved))


def ordinal_ids(df: DataFrame, arrays: Sequence[tuple[str, str]], key: str, fields: Sequence[str]) -> DataFrame:
    """Flatten arrays of structs into one row type with ids of prefix and ordinal (``DOC0001``)."""
    parts = [
        df.select(key, F.posexplode(column).alias("pos", "x")).select(
            key, F.format_string(f"{prefix}%04d", F.col("pos") + 1).alias("source_id"), F.lit(column).alias("kind"), *[F.col(f"x.{f}").cast("string").alias(f) for f in fields]
        )
        for column, prefix in arrays
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(df: DataFrame, key: str, prefix: str, order: str) -> DataFrame:
    """Add ``source_id``: the row's prefix and its ordinal among the key's rows of that prefix (``DOC0001``)."""
    w = Window.partitionBy(key, prefix).orderBy(order)
    return df.withColumn("source_id", F.concat(F.col(prefix), F.format_string("%04d", F.row_number().over(w))))


def rendered(df: DataFrame, key: str, order: Sequence[str], text: str, mark: str = "\n---\n") -> DataFrame:
    """The texts of a key in order, joined by a mark; pipes and line ends of a text are escaped."""
    clean = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, clean.alias("_t")))).alias("_rows"))
    return rows.select(key, F.array_join(F.transform("_rows", lambda r: r["_t"]), mark).alias("text"))


def packet_changes(old: DataFrame, new: DataFrame, on: Sequence[str], body: str) -> DataFrame:
    """Semantic difference of two packet sets: added, removed, changed and same records by key."""
    o = old.select(*on, F.sha2(F.coalesce(body, F.lit("")), 256).alias("_o"))
    n = new.select(*on, F.sha2(F.coalesce(body, F.lit("")), 256).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed").otherwise("same")
    return o.join(n, list(on), "full_outer").select(*on, change.alias("change"))
