"""Writers. Spark's committer makes each write atomic; readers see whole results or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd, split into folders by the given columns."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = False) -> None:
    """CSV with header and quoted text; with ``mark`` each part begins with a byte-order mark, as spreadsheets expect of UTF-8."""
    if mark:
        first, *rest = df.columns
        df = df.withColumnRenamed(first, f"\ufeff{first}")
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_document(df: DataFrame, shape: str = "records") -> DataFrame:
    """One JSON text (value) of a small table: ``records`` as objects, ``split`` as columns and data. Rows stand in the order of their text."""
    fields = {"ignoreNullFields": "false"}
    if shape == "records":
        rows = df.select(F.to_json(F.struct(*df.columns), fields).alias("_r"))
        return rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("_r")), ","), F.lit("]")).alias("value"))
    row = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x")), fields), r'^\{"x":(.*)\}$', "$1"), F.lit("null")) for c in df.columns]), F.lit("]"))
    head = "[" + ",".join(f'"{c}"' for c in df.columns) + "]"
    return df.select(row.alias("_r")).agg(F.concat(F.lit('{"columns":' + head + ',"data":['), F.array_join(F.array_sort(F.collect_list("_r")), ","), F.lit("]}")).alias("value"))


def protected(text: str, path: str, roots: Sequence[str]) -> None:
    """A small text written on the driver, readable by its owner only, inside one of the roots; anywhere else is refused."""
    import os

    real = os.path.realpath(path)
    if not any(real.startswith(os.path.realpath(root) + os.sep) for root in roots):
        raise ValueError("outside of the protected folders")
    handle = os.open(real, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One canonical JSON object a line: keys sorted, nulls kept."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(F.to_json(F.parse_json(row)).alias("value")).write.mode(mode).text(path)


def append(df: DataFrame, path: str) -> None:
    """Append to a JSON Lines journal."""
    json_lines(df, path, mode="append")


def latest(old: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Old and new rows upserted: the latest of each key under ``at``; on a tie the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old rows whose key the new ones do not have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
