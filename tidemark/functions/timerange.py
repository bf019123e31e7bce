"""Interval-precision times as Columns.

A time range is a struct (start, end, precision) of zoneless timestamps: a value
given to the day covers that day, one to the minute that minute, one to the
second that second. Visibility rules are predicates over such ranges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.width import narrow

_TEXT = r"^\s*(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?(?:[T\s]*(\d{1,2})\s*[:时]\s*(\d{1,2})\s*分?(?:\s*:?\s*(\d{1,2})(?:\.\d+)?\s*秒?)?)?\s*$"


def parse_range(text: Column) -> Column:
    """A written time as a range; null for null, blank, unreadable or impossible values."""
    plain = narrow(text)
    part = [F.regexp_extract(plain, _TEXT, i).try_cast("int") for i in range(1, 7)]
    start = F.try_make_timestamp_ntz(part[0], part[1], part[2], F.coalesce(part[3], F.lit(0)), F.coalesce(part[4], F.lit(0)), F.coalesce(part[5], F.lit(0)))
    precision = F.when(part[3].isNull(), "day").when(part[5].isNull(), "minute").otherwise("second")
    return as_range(start, precision)


def as_range(start: Column, precision: Column | str) -> Column:
    """The range that starts at ``start`` and is as long as its precision (day, minute or second)."""
    precision = F.lit(precision) if isinstance(precision, str) else precision
    end = (
        F.when(precision == "day", start + F.expr("INTERVAL '1' DAY"))
        .when(precision == "minute", start + F.expr("INTERVAL '1' MINUTE"))
        .otherwise(start + F.expr("INTERVAL '1' SECOND"))
    )
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), precision.alias("precision")))


def time_precision(text: Column) -> Column:
    """unknown, date_only, midnight_or_date_only or datetime, from how a value is written."""
    r = parse_range(text)
    return (
        F.when(r.isNull(), "unknown")
        .when(r["precision"] == "day", "date_only")
        .when(F.date_format(r["start"].cast("timestamp"), "HH:mm:ss") == "00:00:00", "midnight_or_date_only")
        .otherwise("datetime")
    )


def visible_at(known: Column, cut: Column, inclusive: bool = True) -> Column:
    """Whether something known in the range ``known`` is visible at the range ``cut``.

    At a cut to the day the whole of ``known`` must lie before that day;
    otherwise its last second must not lie after the cut (or must lie before it).
    """
    last = F.when(known["precision"] == "second", known["start"]).otherwise(known["end"] - F.expr("INTERVAL '1' SECOND"))
    at = last <= cut["start"] if inclusive else last < cut["start"]
    return F.coalesce(F.when(cut["precision"] == "day", known["end"] <= cut["start"]).otherwise(at), F.lit(False))


def within(known: Column, start: Column, until: Column) -> Column:
    """Whether a range lies wholly in [start, until]."""
    return F.coalesce((known["start"] >= start) & (known["end"] <= until), F.lit(False))


def known_by(value: Column, at: Column, precision: Column) -> Column:
    """``value <= at``, but a date-only value does not count on the day of ``at`` itself."""
    same_day = (precision != "datetime") & (F.to_date(value) == F.to_date(at))
    return F.coalesce((value <= at) & ~same_day, F.lit(False))


def lookback(value: Column, at: Column, days: int, inclusive: bool = True) -> Column:
    """Whether a time lies in the ``days`` before ``at``, that moment included or not."""
    start = at - F.expr(f"INTERVAL '{days}' DAY")
    return F.coalesce((value >= start) & ((value <= at) if inclusive else (value < at)), F.lit(False))


def lookahead(value: Column, at: Column, days: int) -> Column:
    """Whether a time lies after ``at`` and within ``days`` of it."""
    return F.coalesce((value > at) & (value <= at + F.expr(f"INTERVAL '{days}' DAY")), F.lit(False))


def bucket(value: Column, at: Column, days: int = 90) -> Column:
    """pre, within, after or unknown: where a time lies relative to an anchor."""
    return F.when(value.isNull() | at.isNull(), "unknown").when(value <= at, "pre").when(lookahead(value, at, days), "within").otherwise("after")


def first_present(*values: Column) -> Column:
    """The first value that is there at all; a present but unreadable one stops the search."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def first_readable(*values: Column) -> Column:
    """The first value that can be read as a time; unreadable ones fall through."""
    return F.coalesce(*[parse_range(v) for v in values])


# The same written time anywhere in a text, for search.
FIND = r"20\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}\s*日?(?:[T\s]*\d{1,2}\s*[:：时]\s*\d{1,2}\s*分?(?:\s*[:：]?\s*\d{1,2}(?:\.\d+)?\s*秒?)?)?"


def document_time(text: Column, label: str = "记录时间") -> Column:
    """(time, issue) of a document: the time at its head and those behind the label must be one and the same.

    Without any the issue is DOCUMENT_TIME_MISSING, with different ones
    DOCUMENT_TIME_AMBIGUOUS; impossible times do not count. Null texts have none.
    """
    head = F.regexp_extract(text, rf"^\s*({FIND})", 1)
    labelled = F.regexp_extract_all(text, F.lit(rf"{label}\s*[:：]\s*({FIND})"), F.lit(1))
    found = F.array_distinct(F.filter(F.transform(F.concat(F.array(head), F.coalesce(labelled, F.array().cast("array<string>"))), parse_range), lambda r: r.isNotNull()))
    n = F.size(found)
    return F.struct(F.when(n == 1, F.try_element_at(found, F.lit(1))).alias("time"), F.when(n == 1, F.lit(None).cast("string")).when(n > 1, "DOCUMENT_TIME_AMBIGUOUS").otherwise("DOCUMENT_TIME_MISSING").alias("issue"))


def header_time(text: Column) -> Column:
    """The start of the time a document begins with, null where it begins with none."""
    return parse_range(F.regexp_extract(text, rf"^\s*(?:[^\d\s]{{1,8}}\s*[:：]\s*)?({FIND})", 1))["start"]


def future_dates(text: Column, cutoff: Column) -> Column:
    """The written times that lie behind the cutoff, distinct and sorted; a date alone counts on the cutoff's own day only if the cutoff is that midnight."""
    day, midnight = F.to_date(cutoff), F.date_trunc("DAY", cutoff) == cutoff

    def later(m: Column) -> Column:
        r = parse_range(m)
        dated = (F.to_date(r["start"]) > day) | ((F.to_date(r["start"]) == day) & midnight)
        return F.coalesce(F.when(r["precision"] == "day", dated).otherwise(r["start"] >= cutoff), F.lit(False))

    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(FIND), F.lit(0)), later)))


def exact_time(text: Column) -> Column:
    """A full time without zone, of 16 characters at least; dates alone and times with a zone are null."""
    plain = F.length(text) >= 16
    return F.when(plain & text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?\z"), F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def iso_date(text: Column) -> Column:
    """The date of a value written as a date, a time, or eight digits; impossible dates are null."""
    parts = [F.regexp_extract(F.trim(text), r"^(\d{4})(?:[-/.年])?(\d{1,2})(?:[-/.月])?(\d{1,2})(?:\D.*)?\z", i).try_cast("int") for i in (1, 2, 3)]
    readable = F.trim(text).rlike(r"^(\d{8}(\D.*)?|\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}(\D.*)?)\z")
    return F.when(readable, F.to_date(F.try_make_timestamp_ntz(parts[0], parts[1], parts[2], F.lit(0), F.lit(0), F.lit(0))))


def decision_time(citation: Column, day: Column) -> Column:
    """(time, basis): the time cited behind ``@``, else the last second of the day as a proxy."""
    cited = F.regexp_extract(citation, r"@(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?)", 1)
    exact = F.replace(F.nullif(cited, F.lit("")), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    proxy = day.cast("date").cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return F.struct(F.coalesce(exact, proxy).alias("time"), F.when(exact.isNotNull(), "cited").when(proxy.isNotNull(), "end_of_day").otherwise("unknown").alias("basis"))


def first_named(fields: dict[str, Column]) -> Column:
    """(time, field): the first field that can be read as a time, and its name."""
    return F.coalesce(*[F.when(parse_range(c).isNotNull(), F.struct(parse_range(c).alias("time"), F.lit(name).alias("field"))) for name, c in fields.items()])


def first_given(fields: dict[str, Column], missing: str = "MISSING_AVAILABILITY_TIME") -> Column:
    """(time, basis): the first field that is filled at all, and its name, or INVALID_ with its name where it cannot be read."""
    out = None
    for name, c in fields.items():
        value = F.struct(parse_range(c).alias("time"), F.when(parse_range(c).isNotNull(), name).otherwise(f"INVALID_{name}").alias("basis"))
        filled = F.coalesce(c, F.lit("")) != ""
        out = F.when(filled, value) if out is None else out.when(filled, value)
    empty = F.struct(F.lit(None).cast("struct<start:timestamp_ntz,end:timestamp_ntz,precision:string>").alias("time"), F.lit(missing).alias("basis"))
    return empty if out is None else out.otherwise(empty)


def received(known: Column, receipt: Column) -> Column:
    """(time, basis) of a record from outside: it counts from its receipt, if that lies wholly behind its own time.

    Known times from outside do not establish the receipt: where the two overlap
    the order is uncertain, and where one is missing it is unknown; if the receipt
    lies wholly before, the record counts from its own time.
    """
    time = F.when(receipt["start"] >= known["end"], receipt).when(known["start"] >= receipt["end"], known)
    basis = F.when(known.isNull() | receipt.isNull(), "EXTERNAL_RECEIPT_OR_RELEASE_UNKNOWN").when(receipt["start"] >= known["end"], "hospital_received_time").when(known["start"] < receipt["end"], "EXTERNAL_RECEIPT_ORDER_UNCERTAIN").otherwise("own_time")
    return F.struct(time.alias("time"), basis.alias("basis"))
