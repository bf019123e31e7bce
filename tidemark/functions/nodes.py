"""Structs that carry a value with where it is from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_node(system: Column, file: Column, record: Column, at: Column) -> Column:
    """Where a value is from; as JSON, its empty parts are left out."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(filled(system).alias("system"), filled(file).alias("file"), filled(record).alias("record"), at.cast("string").alias("at"))


def fact_node(value: Column, status: Column, source: Column, candidates: Column | None = None) -> Column:
    """A value with its status and source; the candidates only where they are in conflict."""
    others = candidates if candidates is not None else F.lit(None).cast("array<string>")
    return F.struct(F.when(status == "known", value).alias("value"), status.alias("status"), F.when(status != "unknown", source).alias("source"), F.when(status == "conflict", others).alias("candidates"))


def flattened(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """A struct column as columns of its own, nested ones joined by ``_``."""
    out: list[Column] = []

    def walk(path: str, name: str, kind) -> None:
        if hasattr(kind, "fields"):
            for f in kind.fields:
                walk(f"{path}.`{f.name}`", f"{name}_{f.name}" if name else f.name, f.dataType)
        else:
            out.append(F.col(path).alias(name))

    walk(f"`{column}`", prefix, df.schema[column].dataType)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *out)


def public(df: DataFrame, joined: Sequence[str] = (), blanks: Sequence[str] = ()) -> DataFrame:
    """Without columns whose names begin with ``_``, arrays joined by ``;``, and with blank columns for a reviewer."""
    out = df.select(*[F.array_join(c, ";").alias(c) if c in joined else F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])
    return out.select("*", *[F.lit("").alias(b) for b in blanks])


def evidence_rows(arrays: dict[str, Column]) -> Column:
    """The arrays of a nested case, of structs (at, title, ident, text), as one array with the kind in front."""
    return F.concat(*[F.transform(items, _row(kind)) for kind, items in arrays.items()])


def _row(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("at"), x["title"].alias("title"), x["ident"].alias("ident"), x["text"].alias("text"))


def payload(items: Column, fields: Sequence[str], most: int, chars: int) -> Column:
    """The first ``most`` items of an array of structs, each text field cut to ``chars`` characters, as JSON."""
    return F.to_json(F.transform(F.slice(items, 1, most), lambda x: F.struct(*[F.left(x[f].cast("string"), F.lit(chars)).alias(f) for f in fields])))


def report_text(*parts: Column, fallback: Column, mark: str = "。") -> Column:
    """The parts of a report that are filled, joined; the fallback where none is."""
    filled = [F.nullif(F.trim(p), F.lit("")) for p in parts]
    return F.coalesce(F.nullif(F.concat_ws(mark, *filled), F.lit("")), fallback)


def episode_key(admission: Column, visit: Column) -> Column:
    """What makes notes ones of the same stay: time of admission and visit id, null parts alike."""
    return F.concat_ws("|", F.coalesce(admission, F.lit("")), F.coalesce(visit.cast("string"), F.lit("")))


def at_path(json: Column, path: str, kind: str) -> Column:
    """The value at a dotted path of a JSON text (``a.b[0].c``); null where the path or the kind does not fit."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{path}", kind)


def value_vector(parts: dict[str, Column]) -> Column:
    """Several values as one struct; they are kept apart, whatever is missing."""
    return F.struct(*[c.alias(name) for name, c in parts.items()])
