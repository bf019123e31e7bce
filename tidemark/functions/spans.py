"""Spans of pattern matches in a text, and algebra over them, with built-in functions only.

A span is a struct (start, end, text), places counted from 0, end exclusive.
Between two matches of a pattern stands a part of the text split by it, so the
lengths of parts and matches give every place without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern that matches no empty text, in order; null texts have none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # the place of a match is the length of all parts and matches before it
    found = F.aggregate(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda done, x: F.struct(
            (done["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(done["out"], F.array(F.struct((done["at"] + F.length(x["gap"])).alias("start"), (done["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("text")))).cast(SPANS).alias("out"),
        ),
        lambda done: done["out"],
    )
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPANS))


def ranges(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Sections that start behind a match of a rule's first pattern and last until the next match of its second, or the end of the text."""

    def section(begin: str, stop: str) -> Column:
        stops = spans(text, stop)
        until = lambda s: F.try_element_at(F.filter(stops, lambda e: e["start"] >= s["end"]), F.lit(1))["start"]
        return F.transform(spans(text, begin), lambda s: F.struct(s["end"].alias("start"), F.coalesce(until(s), F.length(text)).alias("end")))

    return F.concat(*[section(begin, stop) for begin, stop in rules])


def outside(found: Column, sections: Column) -> Column:
    """The spans that start in none of the sections."""
    return F.filter(found, lambda s: ~F.exists(sections, lambda r: (s["start"] >= r["start"]) & (s["start"] < r["end"])))


def sentence_start(text: Column, at: Column, marks: str = "\\n。；") -> Column:
    """The place behind the last of the marks before ``at``; 0 where there is none."""
    return F.length(F.regexp_extract(F.substring(text, F.lit(1), at), f"(?s)^(.*[{marks}])", 1))


def trimmed_end(text: Column, at: Column) -> Column:
    """The place behind the last character before ``at`` that is no blank."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), at), r"(?U)\s+$", ""))


def safe_end(text: Column, stops: Sequence[str], sections: Column) -> Column:
    """Where a text stops being safe: at the start of the sentence of the first match of a stop pattern outside the sections, blanks before it left off."""
    ends = [F.coalesce(F.array_min(F.transform(outside(spans(text, p), sections), lambda s: sentence_start(text, s["end"] - 1))), F.length(text)) for p in stops]
    return trimmed_end(text, F.least(*ends, F.length(text)) if ends else F.length(text))
