"""Replay of logged steps: a bounded number of joins instead of a loop over cases.

A case asks for an action; the earliest matching logged event behind its current
time answers, moves the time on and is not used again. The number of steps is
bounded, so the plan is a chain of joins, all on the case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import looked_up
from tidemark.session import cut


def replay(requests: DataFrame, events: DataFrame, steps: int, horizon_days: int) -> DataFrame:
    """Answer each case's requests in order.

    ``requests`` has (case_id, step, wanted, begin) with step from 1 and
    ``begin`` the case's first moment; ``events`` has (case_id, event_id, kind,
    at). Returns (case_id, step, event_id, outcome), outcome being answered,
    unanswered, or not_reached after an unanswered step. Events count within
    ``horizon_days`` of the beginning. Ties go to the smaller event id.
    """
    spark = requests.sparkSession
    state = requests.groupBy("case_id").agg(F.min("begin").alias("begin"), F.min("begin").alias("now")).withColumn("open", F.lit(True))
    done: DataFrame | None = None
    for step in range(1, steps + 1):
        asked = requests.where(F.col("step") == step).select("case_id", "wanted").join(state, "case_id")
        match = (
            asked.where("open").join(events, "case_id")
            .where((F.col("kind") == F.col("wanted")) & (F.col("at") > F.col("now")) & (F.col("at") <= F.col("begin") + F.expr(f"INTERVAL '{horizon_days}' DAY")))
            .groupBy("case_id").agg(F.min(F.struct("at", "event_id")).alias("hit"))
        )
        result = asked.join(match, "case_id", "left").withColumn("outcome", F.when(~F.col("open"), "not_reached").when(F.col("hit").isNull(), "unanswered").otherwise("answered"))
        result = cut(result.select("case_id", F.lit(step).alias("step"), F.col("hit.event_id").alias("event_id"), "outcome", "begin", F.coalesce("hit.at", "now").alias("now")))
        part = result.select("case_id", "step", "event_id", "outcome")
        done = part if done is None else done.unionByName(part)
        state = result.select("case_id", "begin", "now", (F.col("outcome") == "answered").alias("open"))
    return done if done is not None else spark.createDataFrame([], "case_id bigint, step int, event_id bigint, outcome string")


def typed_match(states: DataFrame, events: DataFrame, expected: dict[str, str], aliases: dict[str, str], window_days: int) -> DataFrame:
    """What answers a requested action: (case_id, status, event_id, match).

    ``states`` has (case_id, action, site, domain, now, baseline, until, strict)
    and ``events`` (case_id, event_id, kind, site, domains, compatible, at,
    exact, audited, reviewed), times without zone. An event is EXACT if its kind
    is expected of the action and COMPATIBLE if the action is among those it
    lists. It must be at the same site (aliases are one), serve the domain and lie
    after ``now``, before ``until`` and within the window from the baseline.
    Without an event the status is COUNTERFACTUAL_UNOBSERVED, or REVIEW_REQUIRED
    if one was left out for want of audit; several events of which one is not
    exact in time need review too. Else READY with the earliest, ties by id.
    """
    site = lambda c: looked_up(c, aliases)
    s, e = states.alias("s"), events.alias("e")
    wanted = looked_up(F.col("e.kind"), expected)
    match = F.when(wanted == F.col("s.action"), "EXACT").when(F.array_contains("e.compatible", F.col("s.action")), "COMPATIBLE")
    fits = match.isNotNull() & F.coalesce(site(F.col("e.site")), F.col("e.site")).eqNullSafe(F.coalesce(site(F.col("s.site")), F.col("s.site"))) & F.array_contains("e.domains", F.col("s.domain"))
    sure = F.coalesce(F.col("e.audited"), F.lit(False)) & F.when(F.col("e.exact"), F.col("s.now").isNotNull() & F.col("e.at").isNotNull()).otherwise(~F.col("s.strict") & F.coalesce(F.col("e.reviewed"), F.lit(False)))
    late = F.coalesce((F.col("e.at") <= F.col("s.now")) | (F.col("e.at") >= F.col("s.until")) | (F.col("e.at") > F.col("s.baseline") + F.expr(f"INTERVAL '{window_days}' DAY")), F.lit(False))
    met = s.join(e, (F.col("s.case_id") == F.col("e.case_id")) & fits, "left").select(
        F.col("s.case_id").alias("case_id"), F.col("e.event_id").alias("event_id"), F.col("e.at").alias("at"), F.col("e.exact").alias("exact"), match.alias("match"),
        F.when(F.col("e.event_id").isNull(), "none").when(~F.coalesce(sure, F.lit(False)), "review").when(F.col("e.exact") & late, "none").otherwise("eligible").alias("state"),
    )
    eligible = F.col("state") == "eligible"
    found = met.groupBy("case_id").agg(
        F.count_if(eligible).alias("n"), F.bool_or(eligible & ~F.col("exact")).alias("loose"), F.bool_or(F.col("state") == "review").alias("review"),
        F.min(F.when(eligible, F.struct(F.col("at").isNull().alias("late"), "at", "event_id", "match"))).alias("best"),
    )
    status = F.when(F.col("n") == 0, F.when(F.col("review"), "REVIEW_REQUIRED").otherwise("COUNTERFACTUAL_UNOBSERVED")).when((F.col("n") > 1) & F.col("loose"), "REVIEW_REQUIRED").otherwise("READY")
    ready = status == "READY"
    return found.select("case_id", status.alias("status"), F.when(ready, F.col("best.event_id")).alias("event_id"), F.when(ready, F.col("best.match")).alias("match"))


def scripted(states: DataFrame, script: DataFrame) -> DataFrame:
    """The scripted decision of each (case_id, step); null where the script has none."""
    return states.join(script, ["case_id", "step"], "left")


def messages(system: Column | str, question: Column, context: Column) -> Column:
    """The two messages of a request as an array of (role, content); null without context."""
    first = F.lit(system) if isinstance(system, str) else system
    return F.when(context.isNotNull(), F.array(F.struct(F.lit("system").alias("role"), first.alias("content")), F.struct(F.lit("user").alias("role"), F.concat(question, F.lit("\n\n"), context).alias("content"))))


def outstanding(requests: DataFrame, journal: DataFrame, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Requests without a usable answer in the journal, so that a run goes on where it broke off; an answer is usable if its fields have allowed values."""
    good = journal
    for column, values in allowed.items():
        good = good.where(F.col(column).isin(*values))
    return requests.join(good.select(key).distinct(), key, "left_anti")


def retry_delays(attempts: Column, status: Column, most: int = 8) -> Column:
    """Seconds to wait before each further attempt, doubling up to ``most``, for a status that may pass; an empty array for one that will not."""
    passing = status.isin(408, 409, 429) | (status >= 500) | status.isNull()
    waits = F.transform(F.sequence(F.lit(0), F.greatest(attempts - 1, F.lit(0))), lambda k: F.least(F.pow(F.lit(2.0), k), F.lit(float(most))).cast("int"))
    return F.when(passing & (attempts > 0), waits).otherwise(F.array().cast("array<int>"))


def compared(rows: DataFrame, policies: dict[str, Column], truth: Column) -> DataFrame:
    """(policy, n, agreed): how often each static policy decides as it was, all on the same rows in one pass."""
    decided = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), rule.alias("decision")) for name, rule in policies.items()])).alias("x")
    return rows.select(truth.alias("_truth"), decided).groupBy("x.policy").agg(F.count("*").alias("n"), F.count_if(F.col("x.decision") == F.col("_truth")).alias("agreed"))
