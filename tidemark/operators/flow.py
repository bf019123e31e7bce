"""The packet flow: from a bundle's tables to reasons, packets and a timeline in one call.

Rule packs are data: names and conditions in order, over ``c`` (checkpoint), ``s``
(source) and what the two make together. Every pair of a checkpoint and a source
of its case comes out with the first rule that holds, and what is left makes up
the packet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timerange
from tidemark.operators.packets import first_reason

SOURCE = ("case_id", "source_id", "kind", "title", "body", "time", "basis", "origin", "issue", "version_issue")


@dataclass(frozen=True)
class Rule:
    """A reason to leave a source out, and whether the pair is then unresolved rather than excluded."""

    name: str | Column
    holds: Column
    unresolved: bool = False


def _s(name: str) -> Column:
    return F.col(f"s.{name}")


def visible() -> Column:
    """Whether the source is visible at the checkpoint; its own anchors count up to the very moment."""
    anchor = F.array_contains(F.coalesce(F.col("c.anchors"), F.array().cast("array<string>")), _s("source_id"))
    return F.when(anchor, timerange.visible_at(_s("time"), F.col("c.at"))).otherwise(timerange.visible_at(_s("time"), F.col("c.at"), inclusive=False))


def whole_record_rules() -> list[Rule]:
    """Six reasons, for packets of whole records."""
    own = F.array_contains(F.coalesce(F.col("c.anchors"), F.array().cast("array<string>")), _s("source_id"))
    return [
        Rule("NO_CHECKPOINT", F.col("c.at").isNull(), True),
        Rule(_s("version_issue"), _s("version_issue").isNotNull(), True),
        Rule(F.coalesce(_s("issue"), _s("basis")), _s("issue").isNotNull() | _s("time").isNull(), True),
        Rule("TARGET_DECISION_DOCUMENT_EXCLUDED_WHOLE", (F.col("c.position") == "before_record") & own),
        Rule("NOT_AVAILABLE_BY_CHECKPOINT", ~visible()),
        Rule("SOURCE_TEXT_MISSING", F.coalesce(_s("body"), F.lit("")) == "", True),
    ]


def lookback_rules(days: int, note_title: str, outcome_title: str, plan_text: str, least: int = 30) -> list[Rule]:
    """Twelve reasons, for packets of note beginnings within a lookback before the checkpoint."""
    document = _s("kind") == "document"
    text = F.coalesce(_s("body"), F.lit(""))
    return [
        Rule("NO_STAGE_BOUNDARY", F.col("c.at").isNull()),
        Rule("OTHER_ADMISSION", document & F.coalesce(_s("episode") != F.col("c.episode"), F.lit(False))),
        Rule("PLAN_OR_OUTCOME_DOCUMENT", document & F.coalesce(_s("title"), F.lit("")).rlike(outcome_title)),
        Rule("OUTSIDE_NOTE_TEMPLATES", document & ~F.coalesce(_s("title"), F.lit("")).rlike(note_title)),
        Rule(F.coalesce(_s("issue"), F.lit("RESULT_TIME_MISSING_OR_INVALID")), _s("time").isNull()),
        Rule("OUTSIDE_LOOKBACK_WINDOW", _s("time")["start"] < F.col("c.at")["start"] - F.expr(f"INTERVAL '{days}' DAY")),
        Rule("NOT_FULLY_BEFORE_BOUNDARY", _s("time")["end"] > F.col("c.at")["start"]),
        Rule("IMAGING_REPORT_TEXT_MISSING", (_s("kind") == "imaging") & (text == "")),
        Rule("TYPE_REQUIRES_REVIEW", (_s("kind") == "pathology") & (text == "")),
        Rule("NO_SAFE_NOTE_PREFIX", document & (F.length(F.trim(text)) < least)),
        Rule("DECISION_TEXT_REMAINS", document & text.rlike(plan_text)),
        Rule("NOTE_MENTIONS_LATER_DATE", document & (F.size(timerange.future_dates(text, F.col("c.at")["start"])) > 0)),
    ]


def decide(checkpoints: DataFrame, sources: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(case_id, stage, source_id, reason, disposition) and the source's columns for every pair of a checkpoint and a source of its case.

    A checkpoint whose case has no source keeps one row without source, so no
    checkpoint is lost.
    """
    reason = first_reason([(r.name, r.holds) for r in rules])
    open_ = F.lit(False)
    for r in reversed(rules):
        open_ = F.when(F.coalesce(r.holds, F.lit(False)), r.unresolved).otherwise(open_)
    pairs = checkpoints.alias("c").join(sources.alias("s"), F.col("c.case_id") == F.col("s.case_id"), "left")
    there = _s("source_id").isNotNull()
    return pairs.select(
        F.col("c.case_id").alias("case_id"), F.col("c.stage").alias("stage"), _s("source_id").alias("source_id"), _s("kind").alias("kind"), _s("title").alias("title"), _s("body").alias("body"), _s("time").alias("time"), _s("basis").alias("basis"),
        F.when(there, reason).alias("reason"),
        F.when(~there, F.lit(None).cast("string")).when(reason.isNull(), "included").when(open_, "unresolved").otherwise("excluded").alias("disposition"),
    )


def packets(decided: DataFrame, mark: str = "\n---\n") -> DataFrame:
    """One packet per checkpoint: (case_id, stage, records, kinds, issues, status, context, context_sha).

    Records stand with laboratory values last, then by time, then by id; the
    context is their titles and bodies so ordered. A packet without records is
    UNRESOLVED.
    """
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    included = F.col("disposition") == "included"
    line = F.struct((F.col("kind") == "laboratory").alias("last"), F.col("time")["start"].alias("at"), "source_id", "kind", F.concat_ws(" ", F.concat(F.lit("["), "source_id", F.lit("]")), F.coalesce("title", F.lit(""))).alias("head"), cell(F.col("body")).alias("body"))
    issue = F.when(F.col("disposition") == "unresolved", "SOURCE_VISIBILITY_UNRESOLVED").when(included & F.col("basis").contains("EXAM_TIME_PROXY"), "IMAGING_EXAM_TIME_PROXY").when(included & (F.col("time")["precision"] != "second"), "COARSE_TIME_PRECISION")
    grouped = decided.groupBy("case_id", "stage").agg(F.array_sort(F.collect_list(F.when(included, line))).alias("_rows"), F.array_sort(F.collect_set(issue)).alias("_issues"))
    kinds = F.transform(F.array_sort(F.array_distinct(F.transform("_rows", lambda r: r["kind"]))), lambda k: F.concat(k, F.lit(":"), F.size(F.filter("_rows", lambda r: r["kind"] == k)).cast("string")))
    context = F.array_join(F.transform("_rows", lambda r: F.concat(r["head"], F.lit("\n"), r["body"])), mark)
    return grouped.select(
        "case_id", "stage", F.size("_rows").cast("bigint").alias("records"), F.array_join(kinds, ";").alias("kinds"), F.array_join("_issues", ";").alias("issues"),
        F.when(F.size("_rows") > 0, "DRAFT_REVIEW_REQUIRED").otherwise("UNRESOLVED").alias("status"), context.alias("context"), F.sha2(context, 256).alias("context_sha"),
    )


def timeline(sources: DataFrame) -> DataFrame:
    """(case_id, place, source_id, kind, time_issue): the sources of a case in order of availability, those without time last."""
    from pyspark.sql import Window

    order = Window.partitionBy("case_id").orderBy(F.col("time")["start"].asc_nulls_last(), "source_id")
    return sources.select("case_id", F.row_number().over(order).cast("bigint").alias("place"), "source_id", "kind", F.coalesce("issue", F.when(F.col("time").isNull(), F.col("basis"))).alias("time_issue"))


def checkpoint_problems(checkpoints: DataFrame) -> DataFrame:
    """(case_id, stage, problem): checkpoints that go back behind the one before, repeat a stage, or have no time."""
    from pyspark.sql import Window

    w = Window.partitionBy("case_id").orderBy("stage", F.col("at")["start"])
    before = checkpoints.withColumn("_t", F.last(F.col("at")["start"], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_stage", F.lag("stage").over(w))
    problem = F.when(F.col("_stage") == F.col("stage"), "STAGE_REPEATED").when(F.col("at").isNull(), "NO_TIME").when(F.col("at")["start"] < F.col("_t"), "BEFORE_PREVIOUS")
    return before.select("case_id", "stage", problem.alias("problem")).where("problem IS NOT NULL")
