"""One query for each operator over the project's and the generic tables, with the SQL it is compared against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids, text, timerange
from tidemark.operators import aggregates, joins, packets, replay, validate, windows
from tidemark.sources import sinks
from tidemark.session import shared_folder
from tidemark.sources.tables import stream, table
from tidemark.streaming import episodes as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL for comparison where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _us(c: Column | str) -> Column:
    name = c if isinstance(c, str) else None
    moment = F.col(name) if name else c
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), moment)


def _events(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    df = table(spark, folder, "events")
    return df.where(F.col("event_type").isin(*kinds)) if kinds else df


def _count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


# ---- visibility and packets


@query("""
SELECT c.checkpoint_id, CASE WHEN r.clinical_time IS NULL THEN 'NO_TIME' WHEN coalesce(r.text, '') = '' THEN 'NO_TEXT'
  WHEN r.available_time IS NULL THEN 'AVAILABILITY_UNKNOWN' WHEN CAST(r.available_time AS TIMESTAMP) > c.decision_time THEN 'NOT_AVAILABLE_BY_CHECKPOINT' END AS reason,
  CASE WHEN r.clinical_time IS NULL THEN 'unresolved' WHEN coalesce(r.text, '') = '' THEN 'excluded'
  WHEN r.available_time IS NULL THEN 'unresolved' WHEN CAST(r.available_time AS TIMESTAMP) > c.decision_time THEN 'excluded' ELSE 'included' END AS disposition, count(*) AS n
FROM checkpoints c JOIN fictional_raw_records r ON c.patient_uid = r.patient_uid GROUP BY 1, 2, 3""")
def packet_dispositions(spark, folder):
    rules = [
        ("NO_TIME", F.col("r.clinical_time").isNull()),
        ("NO_TEXT", F.coalesce(F.col("r.text"), F.lit("")) == ""),
        ("AVAILABILITY_UNKNOWN", F.col("r.available_time").isNull()),
        ("NOT_AVAILABLE_BY_CHECKPOINT", F.expr("try_cast(r.available_time AS TIMESTAMP_NTZ)") > F.expr("cast(c.decision_time AS TIMESTAMP_NTZ)")),
    ]
    records = table(spark, folder, "fictional_raw_records").select("patient_uid", "clinical_time", "text", "available_time")
    pairs = packets.dispositions(table(spark, folder, "checkpoints"), records, "patient_uid", rules, ("NO_TIME", "AVAILABILITY_UNKNOWN"))
    return _count(pairs, "checkpoint_id", "reason", "disposition")


@query("""
WITH c AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) FILTER (e.ts <= c.at) AS upto, count(*) FILTER (e.ts < c.at) AS before, count(*) FILTER (date_trunc('day', e.ts) < date_trunc('day', c.at)) AS earlier_days
FROM events e JOIN c USING (user_id) GROUP BY 1""")
def visible_inclusive_exclusive(spark, folder):
    cut = _events(spark, folder, "purchase").groupBy("user_id").agg(F.min("ts").alias("at"))
    seen = _events(spark, folder).select("user_id", "ts").join(cut, "user_id")
    known, at = timerange.as_range(F.col("ts"), "second"), timerange.as_range(F.col("at"), "second")
    day = timerange.as_range(F.col("at").cast("date").cast("timestamp_ntz"), "day")
    return seen.groupBy("user_id").agg(
        F.count_if(timerange.visible_at(known, at)).alias("upto"),
        F.count_if(timerange.visible_at(known, at, inclusive=False)).alias("before"),
        F.count_if(F.col("ts") < day["start"]).alias("earlier_days"),
    )


@query("""
SELECT rec_id, CASE WHEN clinical_time IS NULL THEN 'unknown' WHEN clinical_time LIKE '%00:00:00' THEN 'midnight_or_date_only' ELSE 'datetime' END AS precision FROM fictional_raw_records""")
def time_precision_of_records(spark, folder):
    return table(spark, folder, "fictional_raw_records").select("rec_id", timerange.time_precision(F.col("clinical_time")).alias("precision"))


@query("""
SELECT image_row_id, epoch_us(TRY_CAST(coalesce(nullif(trim(report_time), ''), nullif(trim(exam_datetime), '')) AS TIMESTAMP)) AS known_us FROM imaging_all""")
def first_present_time(spark, folder):
    first = timerange.first_present(F.col("report_time"), F.col("exam_datetime"))
    return table(spark, folder, "imaging_all").select("image_row_id", first.alias("t")).select("image_row_id", _us(timerange.parse_range(F.col("t"))["start"]).alias("known_us"))


@query("""
WITH c AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT CASE WHEN c.at IS NULL THEN 'unknown' WHEN e.ts <= c.at THEN 'pre' WHEN e.ts <= c.at + INTERVAL 7 DAY THEN 'within' ELSE 'after' END AS bucket, count(*) AS n
FROM events e LEFT JOIN c USING (user_id) GROUP BY 1""")
def temporal_bucket_counts(spark, folder):
    anchor = _events(spark, folder, "signup").groupBy("user_id").agg(F.min("ts").alias("at"))
    df = _events(spark, folder).select("user_id", "ts").join(anchor, "user_id", "left")
    return _count(df.select(timerange.bucket(F.col("ts"), F.col("at"), 7).alias("bucket")), "bucket")


@query("""
SELECT patient_uid, string_agg(DISTINCT source_type, ';' ORDER BY source_type) AS kinds, count(*) AS n,
  date_diff('day', min(CAST(clinical_time AS TIMESTAMP)), max(CAST(clinical_time AS TIMESTAMP))) AS span_days
FROM fictional_raw_records WHERE patient_uid IS NOT NULL GROUP BY 1""")
def patient_spans(spark, folder):
    t = F.expr("cast(clinical_time AS TIMESTAMP_NTZ)")
    return (
        table(spark, folder, "fictional_raw_records").where("patient_uid IS NOT NULL").groupBy("patient_uid")
        .agg(F.array_join(F.array_sort(F.collect_set("source_type")), ";").alias("kinds"), F.count("*").alias("n"), F.datediff(F.max(t), F.min(t)).cast("bigint").alias("span_days"))
    )


@query("""
SELECT coalesce(o.note_id, n.note_id) AS note_id, CASE WHEN o.note_id IS NULL THEN 'added' WHEN n.note_id IS NULL THEN 'removed' WHEN o.t <> n.t THEN 'changed' ELSE 'same' END AS change
FROM (SELECT note_id, coalesce(document_text, '') AS t FROM hewv_fictional_bundle WHERE visit_id IS NOT NULL) o
FULL JOIN (SELECT note_id, trim(coalesce(document_text, '')) || CASE WHEN visit_id IS NULL THEN '' ELSE visit_id END AS t FROM hewv_fictional_bundle WHERE visit_id IS NULL OR coalesce(document_title, '') <> '会诊记录') n ON o.note_id = n.note_id""")
def packet_version_changes(spark, folder):
    notes = table(spark, folder, "hewv_fictional_bundle")
    # every note is in one version or in both
    old = notes.where("visit_id IS NOT NULL").select("note_id", F.coalesce("document_text", F.lit("")).alias("t"))
    new = notes.where("visit_id IS NULL OR coalesce(document_title, '') <> '会诊记录'").select("note_id", F.concat(F.trim(F.coalesce("document_text", F.lit(""))), F.coalesce("visit_id", F.lit(""))).alias("t"))
    return packets.packet_changes(old, new, ["note_id"], "t")


@query("""
SELECT patient_uid, string_agg(format('{:s}', replace(replace(coalesce(document_title, ''), '|', '\\|'), chr(10), ' ')), ' / ' ORDER BY note_id) AS text
FROM hewv_fictional_bundle WHERE patient_uid IS NOT NULL GROUP BY 1""")
def rendered_titles(spark, folder):
    return packets.rendered(table(spark, folder, "hewv_fictional_bundle").where("patient_uid IS NOT NULL"), "patient_uid", ["note_id"], "document_title", " / ")


@query("""
SELECT patient_uid, 'DOC' || lpad(CAST(row_number() OVER (PARTITION BY patient_uid ORDER BY note_id) AS VARCHAR), 4, '0') AS source_id, CAST(note_id AS VARCHAR) AS note_id
FROM hewv_fictional_bundle WHERE patient_uid IS NOT NULL""")
def ordinal_source_ids(spark, folder):
    bundle = table(spark, folder, "hewv_fictional_bundle").where("patient_uid IS NOT NULL").groupBy("patient_uid").agg(F.array_sort(F.collect_list(F.struct("note_id"))).alias("documents_all"))
    return packets.ordinal_ids(bundle, [("documents_all", "DOC")], "patient_uid", ["note_id"]).drop("kind")


# ---- joins


@query("""
SELECT e.event_id, v.event_id AS view_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v
ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'error'""")
def asof_backward_latest(spark, folder):
    errors, views = _events(spark, folder, "error"), _events(spark, folder, "view").withColumnRenamed("event_id", "view_id")
    return joins.asof_backward(errors, views, "user_id", "event_id", "ts", "ts", "view_id")


@query("""
SELECT e.event_id, CASE WHEN v.ts >= e.ts - INTERVAL 1 DAY THEN v.event_id END AS view_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v
ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'purchase'""")
def asof_backward_fresh(spark, folder):
    events, views = _events(spark, folder, "purchase"), _events(spark, folder, "view").withColumnRenamed("event_id", "view_id")
    return joins.asof_backward(events, views, "user_id", "event_id", "ts", "ts", "view_id", days=1)


@query("""
WITH g AS (SELECT p.event_id, c.event_id AS click_id, date_diff('microsecond', p.ts, c.ts) AS gap
  FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts + INTERVAL 2 DAY WHERE p.event_type = 'purchase' AND c.event_type = 'click')
SELECT event_id, click_id, gap AS gap_us FROM g QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(gap), gap, click_id) = 1""")
def asof_nearest_asymmetric(spark, folder):
    events, clicks = _events(spark, folder, "purchase"), _events(spark, folder, "click").withColumnRenamed("event_id", "click_id")
    return joins.nearest(events, clicks, "user_id", "event_id", "ts", "click_id", "ts", 1, 2)


@query("""
SELECT p.event_id, c.event_id AS view_id, epoch_us(c.ts) AS found_us FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts >= p.ts - INTERVAL 3 DAY AND c.ts < p.ts
WHERE p.event_type = 'purchase' AND c.event_type = 'view' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts, c.event_id) = 1""")
def earliest_in_window(spark, folder):
    found = joins.first_within(_events(spark, folder, "purchase"), _events(spark, folder, "view").withColumnRenamed("event_id", "view_id"), "user_id", "event_id", "ts", "view_id", "ts", 3, behind=False)
    return found.select("event_id", "view_id", _us("found_at").alias("found_us"))


@query("""
SELECT p.event_id, c.event_id AS purchase_id, epoch_us(c.ts) AS found_us FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL 5 DAY
WHERE p.event_type = 'click' AND c.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts, c.event_id) = 1""")
def forward_interval_first(spark, folder):
    found = joins.first_within(_events(spark, folder, "click"), _events(spark, folder, "purchase").withColumnRenamed("event_id", "purchase_id"), "user_id", "event_id", "ts", "purchase_id", "ts", 5)
    return found.select("event_id", "purchase_id", _us("found_at").alias("found_us"))


@query("""
SELECT p.event_id, count(c.event_id) AS n FROM events p LEFT JOIN events c ON p.user_id = c.user_id AND c.ts >= p.ts - INTERVAL 2 DAY AND c.ts < p.ts
WHERE p.event_type = 'purchase' GROUP BY 1""")
def lookback_window_counts(spark, folder):
    return joins.counts_between(_events(spark, folder, "purchase"), _events(spark, folder), "user_id", "event_id", "ts", F.col("ts") - F.expr("INTERVAL '2' DAY"), F.col("ts"), with_start=True)


@query("""
SELECT l.lab_id, min_by(e.encounter_uid, struct_pack(n := date_diff('microsecond', e.admission_time, coalesce(e.discharge_time, e.admission_time)) // 1000000, i := e.encounter_uid)) AS encounter_uid
FROM four_stage l JOIN encounter_interval e ON l.patient_uid = e.patient_uid AND TRY_CAST(l.sample_time AS TIMESTAMP) BETWEEN e.admission_time AND coalesce(e.discharge_time, e.admission_time) GROUP BY 1""")
def point_in_interval_shortest(spark, folder):
    labs = table(spark, folder, "four_stage").select("lab_id", "patient_uid", F.expr("try_cast(sample_time AS TIMESTAMP_NTZ)").alias("t"))
    stays = table(spark, folder, "encounter_interval")
    stays = stays.select("patient_uid", "encounter_uid", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("admission_time", "discharge_time")])
    return joins.shortest_interval(labs, stays, "patient_uid", "lab_id", "t", "encounter_uid", "admission_time", "discharge_time")


@query("""
WITH p AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase')
SELECT p.event_id, count(e.event_id) AS n FROM p LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.user_id = p.user_id AND e.ts > p.ts AND e.ts < p.nxt GROUP BY 1""")
def between_consecutive_counts(spark, folder):
    from pyspark.sql import Window

    steps = _events(spark, folder, "purchase").withColumn("nxt", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return joins.counts_between(steps, _events(spark, folder, "error"), "user_id", "event_id", "ts", F.col("ts"), F.col("nxt"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_known(spark, folder):
    keys = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def anti_selected(spark, folder):
    keys = table(spark, folder, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(keys, "c_custkey", "left_anti").select("c_custkey")


@query("""
SELECT i.image_row_id, CASE WHEN e.patient_uid IS NULL THEN 'unlinked' ELSE 'linked' END AS link FROM imaging_all i LEFT JOIN (SELECT DISTINCT patient_uid FROM encounter_interval WHERE discharge_time IS NOT NULL) e ON i.patient_uid = e.patient_uid""")
def left_outer_link_status(spark, folder):
    closed = table(spark, folder, "encounter_interval").where("discharge_time IS NOT NULL").select("patient_uid").distinct().withColumn("hit", F.lit(True))
    return table(spark, folder, "imaging_all").join(closed, "patient_uid", "left").select("image_row_id", F.when(F.col("hit"), "linked").otherwise("unlinked").alias("link"))


@query("""
SELECT r.rec_id, i.image_row_id FROM fictional_raw_records r JOIN imaging_all i
ON nullif(regexp_replace(upper(trim(r.source_record_id)), '[^A-Z0-9]', '', 'g'), '') = nullif(regexp_replace(upper(replace(trim(i.source_record_key), 'fictional-image-', 'IMG')), '[^A-Z0-9]', '', 'g'), '')""")
def normalized_key_join(spark, folder):
    a = table(spark, folder, "fictional_raw_records").select("rec_id", joins.keyed(F.col("source_record_id")).alias("k"))
    b = table(spark, folder, "imaging_all").select("image_row_id", joins.keyed(F.replace(F.trim("source_record_key"), F.lit("fictional-image-"), F.lit("IMG"))).alias("k"))
    return a.join(b, "k").select("rec_id", "image_row_id")


@query("""
SELECT source_record_key, min(patient_uid) AS patient_uid FROM four_stage WHERE source_record_key IS NOT NULL AND patient_uid IS NOT NULL GROUP BY 1 HAVING count(DISTINCT patient_uid) = 1""")
def unambiguous_alias(spark, folder):
    return joins.unambiguous(table(spark, folder, "four_stage"), "source_record_key", "patient_uid")


@query("""
SELECT source_record_key, lab_id FROM four_stage WHERE source_record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_record_key ORDER BY lab_id DESC) = 1""")
def last_wins_lookup(spark, folder):
    return joins.last_wins(table(spark, folder, "four_stage").where("source_record_key IS NOT NULL").select("source_record_key", "lab_id"), "source_record_key", ["lab_id"])


@query("""
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1) b ON a.o_custkey = b.o_custkey""")
def full_outer_diff(spark, folder):
    orders = table(spark, folder, "orders")
    old, new = (_count(orders.where(f"o_orderdate {op} TIMESTAMP_NTZ'1997-01-01 00:00:00'"), "o_custkey") for op in ("<", ">="))
    return joins.diff(old, new, "o_custkey", "n")


# ---- windows and selection


@query("SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_signal(spark, folder):
    return windows.first_rows(_events(spark, folder, "error").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", _us("ts").alias("us"))


@query("""
SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS error_before FROM events""")
def prior_state_gate(spark, folder):
    return windows.seen_before(_events(spark, folder), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "error_before").select("event_id", "error_before")


@query("""
SELECT * FROM (SELECT user_id, event_id, lead(event_id) OVER w AS next_id, date_diff('day', ts, lead(ts) OVER w) AS gap_days FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_id IS NOT NULL""")
def transitions_lead(spark, folder):
    return windows.transitions(_events(spark, folder, "purchase"), "user_id", "ts", "event_id")


@query("""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS labels FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def daily_window_merge(spark, folder):
    return windows.daily(_events(spark, folder), "user_id", "ts", "event_type").withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 3")
def last_n_per_group(spark, folder):
    return windows.last_n(_events(spark, folder), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "place")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'view' AND value IS NOT NULL QUALIFY place <= 2),
p AS (SELECT user_id, count(*) AS n, max(value) FILTER (place = 1) AS b, max(value) FILTER (place = 2) AS a FROM r GROUP BY 1)
SELECT user_id, n, CASE WHEN n < 2 THEN 'unknown' WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END AS trend FROM p""")
def trend_last_two(spark, folder):
    return windows.trend(_events(spark, folder, "view"), "user_id", ["ts", "event_id"], "value")


@query("SELECT c_custkey, 'CUS-' || lpad(CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS VARCHAR), 8, '0') AS ranked_id FROM customer")
def ranked_ids(spark, folder):
    return windows.ranked_ids(table(spark, folder, "customer"), [-F.col("c_acctbal"), F.col("c_custkey")], "CUS-", 8, "c_custkey")


@query("""
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders QUALIFY place <= CASE o_orderpriority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 10 ELSE 5 END""")
def quota_per_category(spark, folder):
    return windows.quota(table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey"], {"1-URGENT": 20, "2-HIGH": 10}, 5).select("o_orderkey", "o_orderpriority", "place")


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('fixed|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents QUALIFY place <= 10""")
def hash_ranked_sample(spark, folder):
    return windows.hash_sample(table(spark, folder, "documents"), "source", "doc_id", "fixed", 10).select("doc_id", "source", "place")


@query("""
SELECT doc_id, CASE WHEN c < 60 THEN 'develop' WHEN c < 90 THEN 'lock' END AS band FROM (SELECT doc_id, CAST('0x' || left(sha256('split|' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 100 AS c FROM documents)""")
def dev_lock_split(spark, folder):
    return windows.split_bands(table(spark, folder, "documents"), "doc_id", "split", [("develop", 60), ("lock", 30)]).select("doc_id", "band")


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'O' THEN 10 ELSE 0 END + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS turn FROM orders)
SELECT o_orderkey, o_orderstatus, turn FROM c ORDER BY turn, o_orderstatus, o_orderkey LIMIT 100""")
def balanced_fill(spark, folder):
    return windows.balanced_fill(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"], {"F": 40, "O": 10}, 100).select("o_orderkey", "o_orderstatus", "turn")


@query("""
SELECT kind, k, row_number() OVER (PARTITION BY patient_uid ORDER BY t NULLS LAST, kind, k) AS place, patient_uid FROM (
  SELECT patient_uid, 'record' AS kind, rec_id AS k, TRY_CAST(clinical_time AS TIMESTAMP) AS t FROM fictional_raw_records
  UNION ALL SELECT patient_uid, 'image', image_row_id, TRY_CAST(exam_datetime AS TIMESTAMP) FROM imaging_all) WHERE patient_uid IS NOT NULL""")
def timeline_nulls_last(spark, folder):
    from pyspark.sql import Window

    parts = [
        table(spark, folder, name).select("patient_uid", F.lit(kind).alias("kind"), F.col(key).alias("k"), F.expr(f"try_cast({at} AS TIMESTAMP_NTZ)").alias("t"))
        for name, kind, key, at in (("fictional_raw_records", "record", "rec_id", "clinical_time"), ("imaging_all", "image", "image_row_id", "exam_datetime"))
    ]
    w = Window.partitionBy("patient_uid").orderBy(F.col("t").asc_nulls_last(), "kind", "k")
    return parts[0].unionByName(parts[1]).where("patient_uid IS NOT NULL").select("kind", "k", F.row_number().over(w).cast("bigint").alias("place"), "patient_uid")


@query("""
WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT source, size, size * 97 // sum(size) OVER () AS w, size * 97 % sum(size) OVER () AS r FROM s)
SELECT source, size, CAST(w + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 97 - sum(w) OVER () THEN 1 ELSE 0 END AS BIGINT) AS places FROM t""")
def proportional_allocation(spark, folder):
    return windows.allocate(table(spark, folder, "documents"), "source", 97)


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 3 AS over_cap FROM documents) SELECT doc_id, source, over_cap FROM r ORDER BY over_cap, doc_id LIMIT 80""")
def soft_cap_fill(spark, folder):
    return windows.soft_cap(table(spark, folder, "documents").select("doc_id", "source"), "source", ["doc_id"], 3, 80)


# ---- aggregates


@query("""
SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2""")
def long_format_counts(spark, folder):
    return aggregates.long_counts(_events(spark, folder), ["event_type", "user_id"])


@query("""
SELECT source_record_key, count(DISTINCT sha256(text)) AS payloads, count(*) AS n FROM fictional_raw_records GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1""")
def payload_conflicts(spark, folder):
    return aggregates.conflicts(table(spark, folder, "fictional_raw_records"), ["source_record_key"], F.col("text"))


@query("""
SELECT patient_uid, CASE count(DISTINCT lang) WHEN 0 THEN 'unknown' WHEN 1 THEN 'known' ELSE 'conflict' END AS status, arg_max(lang, rec_id) FILTER (lang IS NOT NULL) AS value,
  coalesce(string_agg(DISTINCT lang, '|' ORDER BY lang), '') AS candidates
FROM (SELECT patient_uid, rec_id, nullif(report_type, '') AS lang FROM fictional_raw_records) GROUP BY 1""")
def reconcile_values(spark, folder):
    df = table(spark, folder, "fictional_raw_records").select("patient_uid", "rec_id", F.nullif("report_type", F.lit("")).alias("lang"))
    return aggregates.reconcile(df, "patient_uid", "lang", ["rec_id"])


@query("""
SELECT doc_id, min(doc_id) OVER w AS kept, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY source, text)""")
def report_dedup_map(spark, folder):
    # the digest stands for the text in the shuffle
    df = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return aggregates.dedup_map(df, "doc_id", ["source", "digest"])


@query("""
SELECT user_id, n, top, top * 1000 // n AS share_permille FROM (SELECT user_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1)""")
def dominant_share(spark, folder):
    return aggregates.dominant_share(_events(spark, folder), "user_id", "event_type")


@query("""
WITH c AS (SELECT patient_uid, source_abnormal_flag AS f, count(*) AS c FROM four_stage WHERE source_abnormal_flag IS NOT NULL GROUP BY 1, 2), s AS (SELECT patient_uid, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM c GROUP BY 1)
SELECT p.patient_uid, coalesce(s.n, 0) AS valid, CASE WHEN s.n >= 2 THEN s.top END AS agreed FROM (SELECT DISTINCT patient_uid FROM four_stage) p LEFT JOIN s ON p.patient_uid = s.patient_uid""")
def mode_agreement(spark, folder):
    return aggregates.agreement(table(spark, folder, "four_stage"), "patient_uid", "source_abnormal_flag")


@query("""
SELECT patient_uid, t, u, t AND u AS passed FROM (SELECT patient_uid, bool_and(coalesce(report_time >= sample_time, false)) AS t, bool_and(coalesce(trim(unit_raw) <> '', false)) AS u FROM four_stage GROUP BY 1)""")
def quality_gates(spark, folder):
    rules = [("t", F.col("report_time") >= F.col("sample_time")), ("u", F.trim("unit_raw") != "")]
    return aggregates.gates(table(spark, folder, "four_stage"), "patient_uid", rules)


@query("""
SELECT source, f AS filled_permille, CASE WHEN f >= 800 THEN 'A' WHEN f >= 500 THEN 'B' ELSE 'C' END AS grade FROM (
  SELECT source, CAST(sum(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(lang, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(document_title, '')) <> '' THEN 1 ELSE 0 END) * 1000 // (count(*) * 3) AS BIGINT) AS f FROM documents GROUP BY 1)""")
def completeness_grade(spark, folder):
    return aggregates.completeness(table(spark, folder, "documents"), "source", ["text", "lang", "document_title"])


@query("""
SELECT user_id, score FROM (SELECT user_id, CASE WHEN list_contains(f, 'error') THEN 3 ELSE 0 END + CASE WHEN list_contains(f, 'purchase') THEN 2 ELSE 0 END + CASE WHEN list_contains(f, 'error') AND list_contains(f, 'purchase') THEN 4 ELSE 0 END AS score_int, CAST(score_int AS BIGINT) AS score
FROM (SELECT user_id, list(DISTINCT event_type) AS f FROM events WHERE value > 95 GROUP BY 1))""")
def flag_score_bonus(spark, folder):
    flags = _events(spark, folder).where("value > 95").groupBy("user_id").agg(F.collect_set("event_type").alias("f"))
    return flags.select("user_id", aggregates.flag_score(F.col("f"), [("error", 3), ("purchase", 2)], [(("error", "purchase"), 4)]).alias("score"))


@query("""
SELECT user_id, least(count(*) FILTER (event_type = 'view'), 5) + least(count(*) FILTER (event_type = 'click'), 5) * 2 + CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 3 ELSE 0 END AS richness FROM events GROUP BY 1""")
def weighted_richness(spark, folder):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return _events(spark, folder).groupBy("user_id").agg((F.least(n("view"), F.lit(5)) + F.least(n("click"), F.lit(5)) * 2 + F.when(n("error") == 0, 3).otherwise(0)).cast("bigint").alias("richness"))


@query("""
SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 END) WHEN 0 THEN 'F' WHEN 1 THEN 'P' WHEN 2 THEN 'O' END AS status FROM orders GROUP BY 1""")
def status_precedence(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(aggregates.precedence(F.col("o_orderstatus"), ("F", "P", "O")).alias("status"))


@query("""
SELECT 'all' AS scope, o_orderpriority, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'large', o_orderpriority, count(*) FROM orders WHERE o_totalprice > 250000 GROUP BY 2 UNION ALL SELECT 'open', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 2""")
def multi_scope_summary(spark, folder):
    rules = [("all", F.lit(True)), ("large", F.col("o_totalprice") > 250000), ("open", F.col("o_orderstatus") == "O")]
    return aggregates.scopes(table(spark, folder, "orders"), rules, "o_orderpriority")


@query("""
SELECT CASE WHEN patient_uid IS NULL THEN 'no_patient' WHEN coalesce(text, '') = '' THEN 'no_text' WHEN clinical_time IS NULL THEN 'no_time' ELSE 'included' END AS reason, count(*) AS n FROM fictional_raw_records GROUP BY 1""")
def exclusion_tally(spark, folder):
    rules = [("no_patient", F.col("patient_uid").isNull()), ("no_text", F.coalesce("text", F.lit("")) == ""), ("no_time", F.col("clinical_time").isNull())]
    return aggregates.tally(table(spark, folder, "fictional_raw_records"), rules)


@query("""
SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def nested_distribution(spark, folder):
    return _count(table(spark, folder, "orders"), "o_custkey").groupBy(F.col("n").alias("orders")).agg(F.count("*").alias("customers"))


@query("""
WITH u AS (SELECT source, unnest([0.6, 0.8, 1.0]) AS gate, share FROM (SELECT source, max(c) * 1.0 / sum(c) AS share FROM (SELECT source, lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1))
SELECT CAST(gate * 10 AS BIGINT) AS gate_tenths, count(*) FILTER (share >= gate - 1e-12) AS passed, count(*) AS n FROM u GROUP BY 1""")
def consistency_gates_coverage(spark, folder):
    shares = aggregates.dominant_share(table(spark, folder, "documents").where("lang IS NOT NULL"), "source", "lang")
    gates = shares.select("n", "top", F.explode(F.array(*[F.lit(g).cast("bigint") for g in (6, 8, 10)])).alias("gate_tenths"))
    return gates.groupBy("gate_tenths").agg(F.count_if(F.col("top") * 10 >= F.col("n") * F.col("gate_tenths")).alias("passed"), F.count("*").alias("n"))


# ---- text


RULES = [("mdt", "多学科|tumour board"), ("surgery", "切除|surgery"), ("imaging", "强化|CT|磁共振"), ("lab", "升至|降至|rises")]


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '多学科|tumour board') THEN 'mdt' WHEN regexp_matches(text, '切除|surgery') THEN 'surgery' WHEN regexp_matches(text, '强化|CT|磁共振') THEN 'imaging' WHEN regexp_matches(text, '升至|降至|rises') THEN 'lab' ELSE 'other' END AS class FROM documents""")
def text_rule_classifier(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.classify(F.col("text"), RULES).alias("class"))


@query("""
SELECT doc_id, concat_ws(';', CASE WHEN regexp_matches(text, '多学科|tumour board') THEN 'mdt' END, CASE WHEN regexp_matches(text, '切除|surgery') THEN 'surgery' END, CASE WHEN regexp_matches(text, '强化|CT|磁共振') THEN 'imaging' END, CASE WHEN regexp_matches(text, '升至|降至|rises') THEN 'lab' END) AS tags FROM documents""")
def text_rule_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.tags(F.col("text"), RULES), ";").alias("tags"))


@query("""
SELECT doc_id, coalesce(len(list_filter(regexp_split_to_array(text, '[。；;！!？?\\n]+'), lambda c: regexp_matches(c, '转移|metasta') AND NOT regexp_matches(c, '未见|无|no |No '))) > 0, false) AS affirmed FROM documents""")
def negation_aware_match(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.affirmed(F.col("text"), "转移|metasta", "未见|无|no |No ").alias("affirmed"))


@query("""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[。；;！!？?\\n]+'), lambda c: trim(c, ' ')), lambda c: regexp_matches(c, '建议|plan'))[1:3], '|') AS clauses FROM documents WHERE text IS NOT NULL""")
def clause_split_select(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", text.clauses_with(F.col("text"), "建议|plan", 3).alias("clauses"))


@query("""
SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}', '<DATE>', 'g'), '[0-9]+', '#', 'g') AS masked FROM documents""")
def masked_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.masked(F.col("text"), [("[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", "<DATE>"), ("[0-9]+", "#")]).alias("masked"))


@query("""
SELECT note_id, coalesce(contains(document_text, document_title), false) AS leaks FROM hewv_fictional_bundle""")
def leak_guard(spark, folder):
    return table(spark, folder, "hewv_fictional_bundle").select("note_id", F.coalesce(F.contains("document_text", "document_title"), F.lit(False)).alias("leaks"))


@query("""
SELECT doc_id, CASE WHEN instr(text, '建议') > 0 THEN substring(text, greatest(instr(text, '建议') - 10, 1), instr(text, '建议') + 2 + 20 - greatest(instr(text, '建议') - 10, 1)) END AS snippet FROM documents""")
def snippet_around_match(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.snippet(F.col("text"), "建议", 10, 20).alias("snippet"))


@query("""
SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '([0-9]+\\.[0-9]+)cm', 1), lambda x: CAST(x AS DOUBLE))) AS largest FROM documents WHERE text IS NOT NULL""")
def size_extract_max(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", text.largest_number(F.col("text"), "([0-9]+\\.[0-9]+)cm").alias("largest"))


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace('<doc><title>' || coalesce(document_title, '') || '</title><p>' || replace(coalesce(text, ''), '<', '&lt;') || '</p></doc>', '<[^>]*>', ' ', 'g'), '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]+', ' ', 'g')) AS plain FROM documents""")
def legacy_markup_text(spark, folder):
    # whole texts, escaped, stand in the markup
    markup = F.concat(F.lit("<doc><title>"), F.coalesce("document_title", F.lit("")), F.lit("</title><p>"), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("</p></doc>"))
    return table(spark, folder, "documents").select("doc_id", text.tag_text(markup).alias("plain"))


@query("""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY instr(text, '淋巴结'), doc_id) AS place FROM documents WHERE contains(text, '淋巴结')) WHERE place <= 2""")
def evidence_search_top_k(spark, folder):
    hits = table(spark, folder, "documents").where("contains(text, '淋巴结')").select("source", "doc_id", F.instr("text", "淋巴结").alias("at"))
    return windows.quota(hits, "source", ["at", "doc_id"], {}, 2).select("source", "doc_id")


@query("""
SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS first FROM documents""")
def first_number_in_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.first_number(F.col("text")).alias("first"))


@query("""
SELECT doc_id, CASE WHEN instr(text, '提示') > 0 THEN list_last(regexp_extract_all(substring(text, 1, instr(text, '提示') - 1), '((19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})', 1)) END AS before,
  CASE WHEN instr(text, '安排在') > 0 THEN nullif(regexp_extract(substring(text, instr(text, '安排在') + 3), '((19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})', 1), '') END AS behind FROM documents""")
def embedded_dates(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.date_before(F.col("text"), "提示").alias("before"), text.date_behind(F.col("text"), "安排在").alias("behind"))


@query("""
SELECT event_type, count(*) FILTER (value > 90) AS hits, count(*) AS n, count(*) FILTER (value > 90) * 1000 // count(*) AS rate_permille FROM events GROUP BY 1""")
def stratum_rates(spark, folder):
    return _events(spark, folder).groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("hits"), F.count("*").alias("n")).withColumn("rate_permille", F.expr("hits * 1000 div n"))


# ---- json, ids, validation, upserts


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, folder):
    return _events(spark, folder).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
SELECT event_id, props IS NOT NULL AS plain, false AS trailing, false AS doubled, false AS nan, false AS fenced, false AS array FROM events""")
def strict_json_validity(spark, folder):
    p = F.col("props")
    made = {"plain": p, "trailing": F.concat(p, F.lit(" {}")), "doubled": F.regexp_replace(p, r"^\{", '{"k": 1, '), "nan": F.regexp_replace(p, r"\d+", "NaN"), "fenced": F.concat(F.lit("```json\n"), p, F.lit("\n```")), "array": F.concat(F.lit("["), p, F.lit("]"))}
    return _events(spark, folder).select("event_id", *[text.strict_json(c).alias(name) for name, c in made.items()])


@query("""
SELECT event_id, CASE WHEN props IS NULL THEN '$' ELSE array_to_string(list_sort(list_filter([CASE WHEN k < 10 THEN '$.k' END, CASE WHEN event_type IN ('error', 'signup') THEN '$.kind' END, CASE WHEN event_id % 3 = 0 THEN '$.tags' END, CASE WHEN event_id % 5 = 0 THEN '$+' END], lambda x: x IS NOT NULL)), ',') END AS errors
FROM (SELECT event_id, event_type, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def schema_rule_errors(spark, folder):
    rules = [validate.Field("k", "number"), validate.Field("kind", values=("view", "click", "purchase")), validate.Field("tags", "array", least=1, most=2)]
    k = F.from_json("props", "k bigint")["k"]
    # missing numbers, wrong words, doubled items and extra keys by row
    body = F.concat(F.lit("{"), F.when(k < 10, F.lit('"k": "x"')).otherwise(F.concat(F.lit('"k": '), k.cast("string"))), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "tags": '), F.when(F.col("event_id") % 3 == 0, '["a", "a"]').otherwise('["a", "b"]'), F.when(F.col("event_id") % 5 == 0, ', "more": 1').otherwise(""), F.lit("}"))
    return _events(spark, folder).select("event_id", F.array_join(validate.schema_errors(F.when(F.col("props").isNotNull(), body), rules), ",").alias("errors"))


@query("SELECT rec_id, sha256(concat_ws('|', coalesce(source_system, ''), coalesce(source_file, ''), coalesce(source_record_id, ''))) AS k, left(sha256(source_record_key), 16) AS short FROM fictional_raw_records")
def stable_source_keys(spark, folder):
    return table(spark, folder, "fictional_raw_records").select(
        "rec_id", ids.source_key(F.col("source_system"), F.col("source_file"), F.col("source_record_id")).alias("k"), ids.short_hash(F.col("source_record_key")).alias("short")
    )


@query()
def uuid5_ids(spark, folder):
    return table(spark, folder, "fictional_raw_records").select("rec_id", ids.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("|", ids.normal_part(F.col("source_system")), "source_record_key")).alias("uid"))


@query("""
SELECT event_id, sha256('{"a":[1,"' || event_type || '"],"k":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"z":{"b":null,"c":"肝"}}') AS sha FROM events WHERE props IS NOT NULL""")
def canonical_sha(spark, folder):
    k = F.from_json("props", "k bigint")["k"].cast("string")
    body = F.concat(F.lit('{ "z": {"c": "肝", "b": null}, "k": '), k, F.lit(', "a": [1, "'), F.col("event_type"), F.lit('"] }'))
    return _events(spark, folder).where("props IS NOT NULL").select("event_id", ids.content_sha(body).alias("sha"))


@query("""
SELECT 'text' AS "column", count(*) AS rows, count(text) AS filled, count(DISTINCT text) AS distinct_values FROM documents UNION ALL
SELECT 'source', count(*), count(source), count(DISTINCT source) FROM documents UNION ALL SELECT 'lang', count(*), count(lang), count(DISTINCT lang) FROM documents""")
def dataset_inventory(spark, folder):
    return validate.inventory(table(spark, folder, "documents").withColumn("text", F.sha2("text", 256)), ["text", "source", "lang"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'missing' WHEN o_totalprice > 400000 THEN 'o_totalprice' ELSE 'o_orderstatus' END AS differs FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P'""")
def frozen_rebuild_differences(spark, folder):
    a = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    dear = F.col("o_totalprice") > 400000
    # the rebuild loses some orders and changes others
    b = table(spark, folder, "orders").where(~(dear & (F.col("o_orderpriority") == "1-URGENT"))).select("o_orderkey", F.when(dear, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when((F.col("o_orderstatus") == "P") & ~dear, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return validate.frozen_differences(a, b, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END DESC, o_orderkey DESC) = 1""")
def upsert_latest(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    parts = [windows.last_n(orders.where(w), "o_custkey", ["o_orderdate", "o_orderkey"], 1).drop("place") for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    return sinks.latest(parts[0], parts[1], ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("""
WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, 'new' AS origin FROM n UNION ALL SELECT DISTINCT o_custkey, 'old' FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM n)""")
def retention_merge(spark, folder):
    orders = table(spark, folder, "orders")
    new, old = (orders.where(w).select("o_custkey").distinct().withColumn("origin", F.lit(o)) for w, o in (("o_orderstatus = 'P'", "new"), ("o_orderstatus <> 'P'", "old")))
    return sinks.merged(old, new, "o_custkey")


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 90)
UNION ALL SELECT 'errors_only', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90 EXCEPT SELECT user_id FROM events WHERE event_type = 'click' AND value > 90)""")
def set_overlaps(spark, folder):
    a, b = (_events(spark, folder, kind).where("value > 90").select("user_id") for kind in ("error", "click"))
    return a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("errors_only").alias("part"), F.count("*").alias("n")))


@query("""
WITH b AS (SELECT user_id AS case_id, min(ts) AS begin FROM events WHERE event_type = 'signup' GROUP BY 1),
s1 AS (SELECT case_id, begin, min(struct_pack(t := e.ts, i := e.event_id)) AS h FROM b LEFT JOIN events e ON e.user_id = b.case_id AND e.event_type = 'click' AND e.ts > begin AND e.ts <= begin + INTERVAL 10 DAY GROUP BY 1, 2),
s2 AS (SELECT s1.case_id, min(struct_pack(t := e.ts, i := e.event_id)) AS h FROM s1 LEFT JOIN events e ON e.user_id = s1.case_id AND e.event_type = 'purchase' AND s1.h.t IS NOT NULL AND e.ts > s1.h.t AND e.ts <= begin + INTERVAL 10 DAY GROUP BY 1)
SELECT s1.case_id, 1 AS step, s1.h.i AS event_id, CASE WHEN s1.h.i IS NULL THEN 'unanswered' ELSE 'answered' END AS outcome FROM s1
UNION ALL SELECT s2.case_id, 2, s2.h.i, CASE WHEN s1.h.i IS NULL THEN 'not_reached' WHEN s2.h.i IS NULL THEN 'unanswered' ELSE 'answered' END FROM s2 JOIN s1 ON s1.case_id = s2.case_id""")
def turn_replay(spark, folder):
    begin = _events(spark, folder, "signup").groupBy(F.col("user_id").alias("case_id")).agg(F.min("ts").alias("begin"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("step"), F.lit("click").alias("wanted")), F.struct(F.lit(2).alias("step"), F.lit("purchase").alias("wanted")))).alias("s")
    requests = begin.select("case_id", "begin", steps).select("case_id", "begin", "s.step", "s.wanted")
    events = _events(spark, folder).select(F.col("user_id").alias("case_id"), "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return replay.replay(requests, events, 2, 10)


# ---- streaming


@query("""
WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), n AS (SELECT e.user_id, first, epoch_us(first) AS first_us, count(*) FILTER (e.ts <= first + INTERVAL 1 DAY) AS inside, count(*) AS n FROM events e JOIN f USING (user_id) GROUP BY 1, 2, 3)
SELECT CAST(user_id AS VARCHAR) AS entity, first_us, CAST(least(inside, 3) AS INTEGER) AS steps, CASE WHEN inside >= 3 THEN 'depth_limit_reached' WHEN n > inside OR first + INTERVAL 1 DAY < mark THEN 'expired' ELSE 'waiting' END AS status FROM n, w""")
def stream_episodes(spark, folder):
    """Episodes over the events as a stream, each batch appended to a table in the shared folder; the last news of each entity."""
    events = stream(spark, folder, "events")
    base = shared_folder(spark, "episodes")
    news = streams.episodes(events, "user_id", "ts", most_steps=3, horizon_us=86_400_000_000)
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/news")
    news.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return joins.last_wins(spark.read.parquet(f"{base}/news"), "entity", ["batch"]).drop("batch")


@query("SELECT DISTINCT event_id FROM events")
def stream_distinct_events(spark, folder):
    """Every event once, although the stream delivers each twice."""
    events = stream(spark, folder, "events").withColumn("available", F.col("ts").cast("timestamp"))
    base = shared_folder(spark, "distinct")
    once = streams.distinct_events(events.unionByName(events), "event_id", "available", "40 days")
    once.select("event_id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("""
SELECT event_id, CASE WHEN coalesce(ts <= TIMESTAMP '2024-01-20', false) THEN NULL ELSE 'not_available_by_checkpoint' END AS reason FROM events""")
def stream_late_audit(spark, folder):
    """Rows of a stream that came in time, and the late ones in an output of their own."""
    events = stream(spark, folder, "events").withColumn("due", F.lit("2024-01-20").cast("timestamp_ntz"))
    base = shared_folder(spark, "late")
    in_time, late = streams.split_late(events, "ts", "due")
    parts = (in_time.select("event_id", F.lit(None).cast("string").alias("reason")), late.select("event_id", "reason"))
    for i, part in enumerate(parts):
        part.writeStream.format("parquet").option("path", f"{base}/out{i}").option("checkpointLocation", f"{base}/state{i}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, reason string").parquet(f"{base}/out0").unionByName(spark.read.schema("event_id bigint, reason string").parquet(f"{base}/out1"))


@query("""
SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_windows(spark, folder):
    """Counts by day and kind of a stream, each day once the watermark has closed it."""
    events = stream(spark, folder, "events").withColumn("available", F.col("ts").cast("timestamp"))
    base = shared_folder(spark, "windows")
    counts = streams.windowed(events, "available", "event_type").select("window", "event_type", "n")
    counts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.unix_micros("window.start").alias("day_us"), "event_type", "n")
