"""Mixed timestamp formats and zones normalised to one UTC instant.

Every value is expanded, inside the JVM, into the array of all its valid
interpretations (order of day and month, epoch units, both sides of a repeated
hour). A Viterbi pass over each source's record order then picks one
interpretation per value: an interpretation against the source's declared
conventions costs most, a change of format and a jump back in time cost
something, so undeclared conventions are settled by their neighbours.

A value with a single interpretation separates the path before it from the path
after it, so only runs of ambiguous values between two such anchors need the
dynamic program. The pass runs over blocks of record order. Runs inside a block
are settled there. Of a run that touches a block's edge only the costs between
the interpretations at its two ends go on; these small matrices are chained over
the blocks of a source, and the ends so chosen come back to settle the run. No
task ever holds more rows of a source than a block, ambiguous or not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.width import narrow
from tidemark.session import keep

# Hours east of UTC of the zone abbreviations that stand in values, the likelier first where one stands for several zones.
ZONE_HOURS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": (1, 6), "WEST": 1, "CET": 1, "MEZ": 1, "CEST": 2, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "IST": (5.5, 2, 1), "CST": (8, -6), "HKT": 8, "SGT": 8, "AWST": 8, "JST": 9, "KST": 9,
    "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EDT": -4, "EST": -5, "CDT": -5, "MDT": -6, "MST": -7, "PDT": -7, "PST": -8,
}
# Month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"(?:\s*(Z|z|[A-Za-z]{2,4}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?))?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_CJK_HALF = r"(上午|下午|凌晨|早上|中午|晚上|AM|PM|am|pm)?"
# family, pattern, groups of (first, second, third date part, hour, minute, second, fraction, half of day, zone); 0: no such group
_FAMILIES = (
    ("ymd", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:\s*T\s*|\s+){_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?" + _ZONE + r")?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("cjk", rf"^(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*[日号](?:\s*{_CJK_HALF}\s*(\d{{1,2}})\s*[时点:]\s*(\d{{1,2}})\s*(?:分|:)?\s*(?:(\d{{1,2}})\s*秒?)?)?$", (1, 2, 3, 5, 6, 7, 0, 4, 0)),
    ("open", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    ("named_dmy", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    ("named_mdy", rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
)
_SEP = "\u0001"

FORMATS = ("ymd", "compact", "cjk", "dmy", "mdy", "named_dmy", "named_mdy", "epoch_s", "epoch_ms")
#: Costs of the Viterbi pass. One step against a declared convention outweighs any sum of the others within a run.
AGAINST_DECLARED, FORMAT_SWITCH, BACKWARD_JUMP = 1 << 40, 1, 2


def _parts(text: Column) -> Column:
    """Array (family, part 1..3, hour, minute, second, fraction, half, zone) of the first family that matches; null if none."""
    case = None
    for family, pattern, groups in _FAMILIES:
        target = family + _SEP + _SEP.join(f"${g}" if g else "" for g in groups)
        hit = F.regexp_replace(text, pattern, target)
        case = F.when(text.rlike(pattern), hit) if case is None else case.when(text.rlike(pattern), hit)
    return F.split(case, _SEP)


def _int(expr: str) -> str:
    return f"try_cast(nullif({expr}, '') AS INT)"


def interpret(df: DataFrame, value: str, zone: str, date_order: str, out: str = "cands") -> DataFrame:
    """Add ``out``: all valid interpretations of the time value of each row, as an array of structs.

    ``value`` is a string column, ``zone`` an IANA name (null: only values with
    their own zone can be placed), ``date_order`` one of ymd, dmy, mdy or null.
    Each struct has ``us`` (microseconds since the epoch, UTC), ``fmt``
    (position in :data:`FORMATS`), ``cost`` (steps against declared conventions)
    and ``dated`` (the value is a date only; ``us`` is then the end of that day).
    Null, blank and unreadable values give an empty array. A wall-clock time
    that never occurred gives none, one that occurred twice gives both instants.
    """
    zones = ", ".join(f"'{name}', array({', '.join(str(round(h * 3600)) for h in (hours if isinstance(hours, tuple) else (hours,)))})" for name, hours in ZONE_HOURS.items())
    months = ", ".join(f"'{name}', {i}" for i, name in enumerate(MONTHS, 1))
    month = f"element_at(map({months}), lower(left(_p[{{}}], 3)))"
    keep = [c for c in df.columns if c != out]

    def step(frame: DataFrame, *columns: Column) -> DataFrame:
        return frame.select(*[F.col(f"`{c}`") for c in keep], *columns)

    def date(y: str, m: str, d: str, fmt: int) -> str:
        return f"struct({y} AS y, {m} AS m, {d} AS d, {fmt} AS f)"

    first, second, third = (_int(f"_p[{i}]") for i in (1, 2, 3))
    frame = step(df, narrow(F.col(f"`{value}`")).alias("_v"), F.col(f"`{zone}`").alias("_z"), F.col(f"`{date_order}`").alias("_o"))
    carried = [F.col("_v"), F.col("_z"), F.col("_o")]
    frame = step(frame, *carried, _parts(F.col("_v")).alias("_p"))
    frame = step(
        frame,
        *carried,
        F.expr(f"""CASE _p[0]
            WHEN 'ymd' THEN array({date(first, second, third, 0)})
            WHEN 'compact' THEN array({date(first, second, third, 1)})
            WHEN 'cjk' THEN array({date(first, second, third, 2)})
            WHEN 'open' THEN array({date(third, second, first, 3)}, {date(third, first, second, 4)})
            WHEN 'named_dmy' THEN array({date(third, month.format(2), first, 5)})
            WHEN 'named_mdy' THEN array({date(third, month.format(1), second, 6)}) END""").alias("_dates"),
        F.expr(f"""CASE WHEN _p[8] IN ('上午', '凌晨', '早上', 'AM', 'am', 'A', 'a') THEN
                     CASE WHEN {_int("_p[4]")} <= 12 THEN {_int("_p[4]")} % 12 END
                   WHEN _p[8] IN ('下午', '晚上', '中午', 'PM', 'pm', 'P', 'p') THEN
                     CASE WHEN {_int("_p[4]")} <= 12 THEN {_int("_p[4]")} % 12 + 12 ELSE {_int("_p[4]")} END
                   ELSE {_int("_p[4]")} END""").alias("_h"),
        F.expr("nullif(_p[4], '') IS NULL").alias("_dated"),
        F.expr(_int("_p[5]")).alias("_mi"),
        F.expr(f"coalesce({_int('_p[6]')}, 0)").alias("_s"),
        F.expr("coalesce(try_cast(concat('0.', nullif(_p[7], '')) AS DECIMAL(10,9)), 0)").alias("_frac"),
        F.expr("upper(nullif(_p[9], ''))").alias("_zz"),
    )
    frame = step(
        frame,
        F.col("_v"),
        F.col("_z"),
        F.col("_zz"),
        F.expr(f"""CASE WHEN _zz RLIKE '[+-]' THEN
                     array((try_cast(regexp_extract(_zz, r'[+-](\\d{{1,2}})', 1) AS INT) * 3600
                      + coalesce(try_cast(nullif(regexp_extract(_zz, r'[+-]\\d{{1,2}}:?(\\d{{2}})$', 1), '') AS INT), 0) * 60)
                     * if(contains(_zz, '-'), -1, 1))
                   ELSE try_element_at(map({zones}), _zz) END""").alias("_east"),
        F.expr("""filter(transform(_dates, c -> struct(
            CASE WHEN _dated THEN try_make_timestamp_ntz(c.y, c.m, c.d, 0, 0, 0) + INTERVAL '1' DAY
                 WHEN _h BETWEEN 0 AND 23 AND _mi BETWEEN 0 AND 59 AND _s BETWEEN 0 AND 59
                 THEN try_make_timestamp_ntz(c.y, c.m, c.d, _h, _mi, cast(_s + _frac AS DECIMAL(16,6))) END AS t,
            c.f AS f,
            CASE WHEN c.f IN (3, 4) AND _o <> if(c.f = 3, 'dmy', 'mdy') THEN 1 ELSE 0 END AS cost)),
            c -> c.t IS NOT NULL)""").alias("_clocks"),
        F.col("_dated"),
    )
    # A repeated wall clock gives its earlier instant first; the later one goes against the convention.
    frame = step(
        frame,
        F.col("_v"),
        F.expr("""flatten(transform(coalesce(_clocks, array()), c ->
            CASE WHEN size(_east) = 1 THEN array(struct(c.t - make_dt_interval(0, 0, 0, _east[0]) AS u, c.f AS f, c.cost AS cost))
                 WHEN size(_east) > 1 THEN transform(_east, e -> struct(c.t - make_dt_interval(0, 0, 0, e) AS u, c.f AS f, c.cost + CASE
                      WHEN _z IS NULL THEN 0
                      WHEN convert_timezone('UTC', _z, c.t - make_dt_interval(0, 0, 0, e)) = c.t THEN 0
                      WHEN convert_timezone('UTC', _z, date_trunc('YEAR', c.t) - make_dt_interval(0, 0, 0, e)) = date_trunc('YEAR', c.t) THEN 0
                      ELSE 1 END AS cost))
                 WHEN _zz IS NOT NULL OR _z IS NULL THEN filter(array(struct(c.t AS u, c.f AS f, c.cost AS cost)), k -> false)
                 WHEN _dated THEN array(struct(convert_timezone(_z, 'UTC', c.t) AS u, c.f AS f, c.cost AS cost))
                 ELSE filter(transform(sequence(0, 2), k -> struct(
                        convert_timezone(_z, 'UTC', c.t) + make_dt_interval(0, 0, 30 * k, 0) AS u, c.f AS f, c.cost + least(k, 1) AS cost)),
                      k -> convert_timezone('UTC', _z, k.u) = c.t) END))""").alias("_found"),
        F.col("_dated"),
    )
    return step(
        frame,
        F.expr("""concat(
          transform(_found, k -> struct(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', k.u) AS us, k.f AS fmt, k.cost AS cost, _dated AS dated)),
          CASE WHEN _v RLIKE r'^\\d{9,10}([.]\\d{1,6})?$' AND try_cast(_v AS DECIMAL(20,6)) BETWEEN 315532800 AND 4102444800
               THEN array(struct(cast(try_cast(_v AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS us, 7 AS fmt, 0 AS cost, false AS dated))
               WHEN _v RLIKE r'^\\d{12,13}$' AND try_cast(_v AS BIGINT) BETWEEN 315532800000 AND 4102444800000
               THEN array(struct(try_cast(_v AS BIGINT) * 1000 AS us, 8 AS fmt, if(size(_found) > 0, 2, 0) AS cost, false AS dated))
               ELSE filter(array(struct(0L AS us, 0 AS fmt, 0 AS cost, false AS dated)), k -> false) END)""").alias(out),
    )


Cand = tuple[int, int, int]  # instant, format, steps against declared conventions
Cost = tuple[int, float]  # cost, and how late the chosen interpretations stand in their arrays: among equal costs the earlier win


def _own(cand: Cand, place: int, seq: int) -> Cost:
    # a weight that differs by row leaves one cheapest path, however the rows are cut into blocks
    weight = 1.0 + ((seq * 0x9E3779B97F4A7C15) & 0xFFFFFFFF) / 2.0**32
    return cand[2] * AGAINST_DECLARED, place * weight


def _step(before: Cand, now: Cand) -> int:
    return (now[1] != before[1]) * FORMAT_SWITCH + (now[0] < before[0]) * BACKWARD_JUMP


def _forward(lists: list[list[Cand]], seqs: list[int], start: list[Cost | None]) -> tuple[list[Cost | None], list[list[int]]]:
    """The least cost of reaching each interpretation of the last value, and where each step comes from. ``None`` is out of reach."""
    best, back = start, []
    for before, now, seq in zip(lists, lists[1:], seqs[1:]):
        step: list[Cost | None] = []
        origin = []
        for place, cand in enumerate(now):
            own = _own(cand, place, seq)
            least, k = None, 0
            for j, (b, p) in enumerate(zip(best, before)):
                if b is not None:
                    cost = (b[0] + own[0] + _step(p, cand), b[1] + own[1])
                    if least is None or cost < least:
                        least, k = cost, j
            step.append(least)
            origin.append(k)
        best = step
        back.append(origin)
    return best, back


def _viterbi(lists: list[list[Cand]], seqs: list[int], first: int | None = None, last: int | None = None) -> list[int]:
    """Positions of the cheapest path through a run of interpretations, with those at its ends given or free."""
    start = [_own(c, k, seqs[0]) if first in (None, k) else None for k, c in enumerate(lists[0])]
    best, back = _forward(lists, seqs, start)
    k = last if last is not None else min((b, k) for k, b in enumerate(best) if b is not None)[1]
    path = [k]
    for origin in reversed(back):
        k = origin[k]
        path.append(k)
    return path[::-1]


_SETTLED, _OPEN, _EDGE = 0, 1, 2
_HEAD, _TAIL, _THROUGH = 0, 1, 2
_CANDS = "array<struct<us:bigint,fmt:int,cost:int,dated:boolean>>"
_SCHEMA = f"source string, field string, block bigint, part int, seq bigint, row_no bigint, state int, us bigint, fmt int, dated boolean, cands {_CANDS}, ends array<struct<us:bigint,fmt:int>>, costs array<bigint>, ties array<double>"


def _plain(row: Sequence) -> list[Cand]:
    return [(c["us"], c["fmt"], c["cost"]) for c in row]


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the runs of ambiguous values of one block that lie between anchors, and sum up those that touch its edges.

    Rows come back settled or open. A block has an edge row for its head (up to
    its first anchor) and its tail (from its last one), or one for the whole
    where it has no anchor: the interpretations at both ends, and for every pair
    of them the least cost between.
    """
    pdf = pdf.sort_values(["seq", "row_no"], kind="stable").reset_index(drop=True)
    several = pdf["cands"].notna().to_numpy()
    n, state, part = len(pdf), np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf), dtype=np.int32)
    us, fmt, dated = (pdf[c].astype("object").to_numpy() for c in ("us", "fmt", "dated"))
    seqs = pdf["seq"].tolist()
    lists = {i: _plain(pdf["cands"].iloc[i]) for i in np.flatnonzero(several)}
    at = lambda i: lists[i] if i in lists else [(us[i], fmt[i], 0)]
    anchors = np.flatnonzero(~several)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], several, [False])).astype(np.int8)))
    for start, end in zip(edges[::2], edges[1::2]):
        if start == 0 or end == n:
            state[start:end] = _OPEN
            part[start:end] = _THROUGH if not len(anchors) else _HEAD if start == 0 else _TAIL
            continue
        run = range(start - 1, end + 1)
        for i, k in list(zip(run, _viterbi([at(i) for i in run], [seqs[i] for i in run])))[1:-1]:
            chosen = pdf["cands"].iloc[i][k]
            us[i], fmt[i], dated[i] = chosen["us"], chosen["fmt"], chosen["dated"]
    rows = pdf.assign(us=pd.array(us, dtype="Int64"), fmt=pd.array(fmt, dtype="Int32"), dated=dated, state=state, part=part, ends=None, costs=None, ties=None)
    rows.loc[rows["state"] == _SETTLED, "cands"] = None
    sums = [(_THROUGH, 0, n)] if not len(anchors) else [(_HEAD, 0, anchors[0] + 1), (_TAIL, anchors[-1], n)]
    out = []
    for name, start, end in sums:
        ends = [at(start), at(end - 1)]
        costs, ties = [], []
        for first in range(len(ends[0])):
            begin = [_own(c, k, seqs[start]) if k == first else None for k, c in enumerate(ends[0])]
            best, _ = _forward([at(i) for i in range(start, end)], seqs[start:end], begin)
            costs.extend(-1 if b is None else b[0] for b in best)
            ties.extend(0.0 if b is None else b[1] for b in best)
        # the number of interpretations at the first end stands before them
        described = [{"us": len(ends[0]), "fmt": 0}] + [{"us": int(c[0]), "fmt": int(c[1])} for side in ends for c in side]
        out.append({"part": name, "state": _EDGE, "seq": seqs[start], "row_no": 0, "us": None, "fmt": None, "dated": None, "cands": None, "ends": described, "costs": costs, "ties": ties})
    head = {c: pdf[c].iloc[0] for c in ("source", "field", "block")}
    values = {c: rows[c].tolist() + [(head | o)[c] for o in out] for c in rows.columns}
    return pd.DataFrame({c: pd.array([None if x is pd.NA else x for x in v], dtype={"us": "Int64", "fmt": "Int32"}[c]) if c in ("us", "fmt") else pd.Series(v, dtype=None if c in ("block", "part", "seq", "row_no", "state") else "object") for c, v in values.items()})


_CHOICE = "source string, field string, block bigint, part int, first int, last int"


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The interpretations chosen at both ends of every head, tail and whole block of a source: the cheapest path over their matrices."""
    pdf = pdf.assign(_o=pdf["part"] == _TAIL).sort_values(["block", "_o"], kind="stable").reset_index(drop=True)
    firsts, lasts, spans = [], [], []
    for ends, costs, ties in zip(pdf["ends"], pdf["costs"], pdf["ties"]):
        width = ends[0]["us"]
        sides = [(e["us"], e["fmt"], 0) for e in ends[1:]]
        firsts.append(sides[:width])
        lasts.append(sides[width:])
        spans.append([[None if c < 0 else (int(c), float(t)) for c, t in zip(costs[k * len(lasts[-1]) : (k + 1) * len(lasts[-1])], ties[k * len(lasts[-1]) : (k + 1) * len(lasts[-1])])] for k in range(width)])
    best: list[Cost | None] = [(0, 0.0)] * len(firsts[0])
    back: list[tuple[list[int], list[int]]] = []
    for i in range(len(pdf)):
        enter = [0] * len(firsts[i])
        if i:
            # a tail follows its own block's head with settled rows between: nothing is spent on the way
            same = pdf["block"].iloc[i] == pdf["block"].iloc[i - 1]
            reached: list[Cost | None] = []
            for k, cand in enumerate(firsts[i]):
                options = [((b[0] + (0 if same else _step(p, cand)), b[1]), j) for j, (b, p) in enumerate(zip(best, lasts[i - 1])) if b is not None]
                cost, enter[k] = min(options)
                reached.append(cost)
            best = reached
        leave: list[Cost | None] = []
        origin = []
        for j in range(len(lasts[i])):
            options = [((b[0] + span[j][0], b[1] + span[j][1]), k) for k, (b, span) in enumerate(zip(best, spans[i])) if b is not None and span[j] is not None]
            cost, k = min(options) if options else (None, 0)
            leave.append(cost)
            origin.append(k)
        best = leave
        back.append((enter, origin))
    last = [0] * len(pdf)
    first = [0] * len(pdf)
    j = min((b, k) for k, b in enumerate(best) if b is not None)[1]
    for i in range(len(pdf) - 1, -1, -1):
        last[i] = j
        first[i] = back[i][1][j]
        j = back[i][0][first[i]]
    return pdf[["source", "field", "block", "part"]].assign(first=first, last=last)


def _resettle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle one open run between the ends chosen for it."""
    pdf = pdf.sort_values(["seq", "row_no"], kind="stable").reset_index(drop=True)
    lists, seqs, name = [_plain(row) for row in pdf["cands"]], pdf["seq"].tolist(), pdf["part"].iloc[0]
    # the anchor of a head or tail stands outside the run, as the one interpretation it has
    anchor = [(int(pdf["anchor_us"].iloc[0]), int(pdf["anchor_fmt"].iloc[0]), 0)] if name != _THROUGH else None
    before, behind = ([anchor] if name == _TAIL else []), ([anchor] if name == _HEAD else [])
    first = int(pdf["first"].iloc[0]) if name != _TAIL else 0
    last = int(pdf["last"].iloc[0]) if name != _HEAD else 0
    path = _viterbi(before + lists + behind, [0] * len(before) + seqs + [0] * len(behind), first, last)[len(before) : len(before) + len(lists)]
    chosen = [row[k] for row, k in zip(pdf["cands"], path)]
    return pd.DataFrame({"seq": pdf["seq"], "field": pdf["field"], "us": [c["us"] for c in chosen], "fmt": [c["fmt"] for c in chosen], "dated": [c["dated"] for c in chosen]}).astype({"fmt": "int32"})


def normalise_times(
    df: DataFrame,
    id_col: str,
    source_col: str,
    fields: Sequence[str],
    sources: DataFrame,
    zone_col: str = "time_zone",
    order_col: str = "date_order",
    block: int = 1 << 18,
) -> DataFrame:
    """Each non-null value of ``fields`` as one instant in UTC.

    ``df`` has a whole number ``id_col`` that gives the record order of each
    ``source_col``; ``sources`` has one row per source with its zone and date
    order (extra rows of a source are ignored, an unknown source has neither).
    Returns ``(id_col, field, us, fmt, dated)`` with a row for each value that
    can be read; null, blank, unreadable and impossible values have no row, nor
    have values of rows without id, which have no place in the order.
    Repeated ids are kept, one row per value. ``block`` is the width, in ids, of
    the blocks of record order; it bounds a task's rows and changes no result.
    The blocks' rows are kept in memory and on disk until ``session.release``.
    """
    own = (
        sources.where(F.col(source_col).isNotNull())
        .groupBy(F.col(source_col).alias("_source"))
        .agg(F.min(F.struct(F.col(zone_col).alias("zone"), F.lower(order_col).alias("ord"))).alias("_own"))
    )
    values = df.select(
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.col(f"`{id_col}`").cast("bigint").alias("seq"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("raw")) for f in fields])).alias("_x"),
    ).where(F.col("_x.raw").isNotNull() & F.col("seq").isNotNull())
    values = values.join(own, "_source", "left").select(
        F.coalesce("_source", F.lit("")).alias("source"), "seq", F.col("_x.field").alias("field"), F.col("_x.raw").alias("raw"),
        F.col("_own.zone").alias("zone"), F.col("_own.ord").alias("ord"),
    )
    # A generator drops the unreadable values: a filter would be pushed down and repeat the whole parse.
    read = interpret(values, "raw", "zone", "ord").select(
        "source", "field", "seq", "raw", F.explode(F.expr("filter(array(cands), c -> size(c) > 0)")).alias("cands")
    )
    one = F.size("cands") == 1
    rows = read.select(
        "source", "field", F.expr(f"seq div {block}").alias("block"), "seq", F.xxhash64("raw").alias("row_no"),
        *[F.when(one, F.col("cands")[0][c]).alias(c) for c in ("us", "fmt", "dated")],
        F.when(~one, F.col("cands")).alias("cands"),
    )
    level = keep(rows.groupBy("source", "field", "block").applyInPandas(_settle, _SCHEMA))
    edges = level.where(F.col("state") == _EDGE).select("source", "field", "block", "part", "ends", "costs", "ties")
    # one row for a block and side, whatever the rows in it
    chosen = edges.groupBy("source", "field").applyInPandas(_chain, _CHOICE)
    anchor = F.when(F.col("part") == _HEAD, F.element_at("ends", -1)).otherwise(F.element_at("ends", 2))
    chosen = chosen.join(edges.select("source", "field", "block", "part", anchor["us"].alias("anchor_us"), anchor["fmt"].alias("anchor_fmt")), ["source", "field", "block", "part"])
    run = ["source", "field", "block", "part"]
    opened = level.where(F.col("state") == _OPEN).select(*run, "seq", "row_no", "cands").join(chosen, run)
    settled = opened.groupBy(*run).applyInPandas(_resettle, "seq bigint, field string, us bigint, fmt int, dated boolean")
    out = level.where(F.col("state") == _SETTLED).select("seq", "field", "us", "fmt", "dated").unionByName(settled)
    return out.select(F.col("seq").alias(id_col), "field", "us", "fmt", "dated")
