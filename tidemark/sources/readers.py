"""Scans. Every reader takes an explicit schema where the format has none."""

from __future__ import annotations

import sqlite3
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import compact


def parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """Parquet files with merged schemas; wanted columns that no file has come out as null text."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if not columns:
        return df
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def only_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids`` (one column of that name); the id filter reaches the scan as a runtime filter."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def csv(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8", separator: str = ",") -> DataFrame:
    """CSV with header, quoted fields over several lines, broken rows with nulls where fields are missing.

    Other encodings than Spark's own (gb18030, gb2312) are decoded from the
    bytes of each file, since the CSV source refuses them by default.
    """
    if encoding.upper().replace("-", "") in {"UTF8", "USASCII", "ISO88591", "UTF16"}:
        return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def decode(batches):
        import csv as rows
        import io
        import itertools

        import pandas as pd

        rows.field_size_limit(1 << 30)
        for batch in batches:
            for content in batch["content"]:
                read = rows.DictReader(io.TextIOWrapper(io.BytesIO(content), encoding, "replace", newline=""), delimiter=separator)
                # a file is decoded as it is read, and its rows go on in parts
                while part := list(itertools.islice(read, 10_000)):
                    yield pd.DataFrame([{f.name: r.get(f.name) for f in shape} for r in part], columns=shape.names)

    text = StructType.fromDDL(", ".join(f"`{f.name}` string" for f in shape))
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, text)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in shape])


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON Lines; unreadable lines are rows of nulls with the line in ``_corrupt``."""
    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(shape.add("_corrupt", "string")).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decoded(content: Column, encodings: Sequence[str] = ("utf-8", "gb18030", "gb2312")) -> Column:
    """Bytes as text by the first encoding that fits; the last one replaces what it cannot read."""

    @F.pandas_udf("string")
    def decode(column):
        def one(data):
            if data is None:
                return None
            for name in encodings:
                try:
                    return bytes(data).decode(name)
                except UnicodeDecodeError:
                    continue
            return bytes(data).decode(encodings[-1], "replace")

        return column.map(one)

    return decode(content)


def markup(spark: SparkSession, folder: str, suffixes: str = "*.{xml,bak}") -> DataFrame:
    """(path, text) of markup files below a folder: decoded, tags stripped, blanks compacted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", compact(F.regexp_replace(decoded(F.col("content")), "<[^>]*>", " ")).alias("text"))


def files(spark: SparkSession, folder: str, pattern: str = ".*") -> DataFrame:
    """(path, name, size) of the files below a folder whose name matches; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    return found.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).where(F.col("name").rlike(pattern)).select("path", "name", "size")


#: Rows of a SQLite result that may come through the driver.
MOST_SQLITE_ROWS = 5_000_000


def sqlite(spark: SparkSession, path: str, query: str, schema: StructType | str, most: int = MOST_SQLITE_ROWS) -> DataFrame:
    """A query on a SQLite file, read-only. The file is one machine's, so the result comes through the driver: a dimension of at most ``most`` rows."""
    link = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        rows = link.execute(query).fetchmany(most + 1)
    finally:
        link.close()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no dimension; export the table to files")
    return spark.createDataFrame(rows, schema)


def tokens(cluster: Column, repaired: str = "repaired_tokens", fragments: str = "fragments") -> Column:
    """The token array of a JSON record: the repaired tokens, else those of the first fragment."""
    shape = f"{repaired} array<string>, {fragments} array<struct<tokens:array<string>>>"
    parsed = F.from_json(cluster, shape)
    return F.coalesce(parsed[repaired], F.try_element_at(parsed[fragments], F.lit(1))["tokens"])


def row_count(df: DataFrame, name: str) -> DataFrame:
    """(name, actual): the rows of a table; of Parquet files the footers alone are read."""
    return df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("name"), "actual")


def planned(df: DataFrame, plan: DataFrame, wanted: DataFrame, task: str, key: str) -> DataFrame:
    """The rows of the wanted keys, read only from the tasks that the plan names for them.

    ``plan`` has (task, key); with ``df`` split by ``task`` into folders, the join
    prunes the folders of other tasks. A wanted key without task is an error, when
    the rows are read.
    """
    keys = wanted.select(key).distinct()
    missing = keys.join(plan.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("_missing"))
    pairs = plan.select(task, key).distinct().join(keys, key, "left_semi")
    rows = df.join(pairs, [task, key], "left_semi")
    checked = rows.crossJoin(F.broadcast(missing))  # one row
    return checked.where(F.when(F.col("_missing") > 0, F.raise_error(F.concat(F.col("_missing").cast("string"), F.lit(" wanted keys stand in no task")).cast("string")).cast("boolean")).otherwise(F.lit(True))).drop("_missing")


def inventory(files: DataFrame, systems: Sequence[tuple[str, str]]) -> DataFrame:
    """(system, found, names): which files' names speak of each system; one that none speaks of has none."""
    rows = files.select(F.col("name"), F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.coalesce(F.col("name").rlike(p), F.lit(False)).alias("hit")) for s, p in systems])).alias("x"))
    return rows.groupBy("x.system").agg(F.count_if("x.hit").alias("found"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("x.hit"), F.col("name")))), ";").alias("names"))


def distinct_reports(df: DataFrame, ident: str, keys: Sequence[str], body: Column, most: int) -> DataFrame:
    """One row for each report of the same keys and whole text: its smallest id, and the text cut to ``most`` characters."""
    rows = df.select(ident, *keys, body.alias("_body"))
    return rows.groupBy(*keys, F.sha2("_body", 256).alias("_digest")).agg(F.min(ident).alias(ident), F.first(F.left("_body", F.lit(most))).alias("report")).drop("_digest")
