"""Queries over joins, selection, aggregates, checks, replay and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import nodes
from tidemark.operators import aggregates, joins, replay, validate, windows
from tidemark.plans.reference import _events, _us, query
from tidemark.session import shared_folder
from tidemark.sources import readers, sinks
from tidemark.sources.tables import table

# ---- joins


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS k, c_custkey + 1 AS alias FROM customer), n AS (SELECT k, alias AS name FROM a UNION SELECT c_custkey, c_custkey FROM customer),
i AS (SELECT DISTINCT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT DISTINCT n.k, i.o_orderdate FROM n JOIN i ON n.name = i.o_custkey)
SELECT o_orderkey, h.k IS NOT NULL AS known FROM orders o LEFT JOIN h ON o.o_custkey = h.k AND o.o_orderdate = h.o_orderdate""")
def exists_alias_expanded(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    aliases = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") + 1).alias("alias"))
    return joins.exists_with_aliases(orders, "k", "day", aliases, orders.where("o_orderstatus = 'F'")).select("o_orderkey", "known")


@query("""
WITH d AS (SELECT source_record_key AS a, index_report_uid AS b, coalesce(exam_method, '') AS m FROM imaging_all)
SELECT r.rec_id, coalesce(x.m, y.m) AS exam_method FROM (SELECT rec_id, replace(source_record_id, 'IMG', 'fictional-image-') AS a, source_record_key AS b FROM fictional_raw_records) r
LEFT JOIN (SELECT a, min(m) AS m FROM d WHERE a IS NOT NULL GROUP BY 1) x ON r.a = x.a LEFT JOIN (SELECT b, min(m) AS m FROM d WHERE b IS NOT NULL GROUP BY 1) y ON r.b = y.b""")
def alternate_key_join(spark, folder):
    rows = table(spark, folder, "fictional_raw_records").select("rec_id", F.replace("source_record_id", F.lit("IMG"), F.lit("fictional-image-")).alias("a"), F.col("source_record_key").alias("b"))
    details = table(spark, folder, "imaging_all").select(F.col("source_record_key").alias("a"), F.col("index_report_uid").alias("b"), F.coalesce("exam_method", F.lit("")).alias("exam_method"))
    return joins.by_first_key(rows, details, ["a", "b"], "exam_method").select("rec_id", "exam_method")


@query("""
WITH t AS (SELECT sha256(source_record_key) AS k, arg_min(regexp_replace(coalesce(text, ''), '[0-9]', '#', 'g'), rec_id) AS text FROM fictional_raw_records WHERE source_record_key IS NOT NULL GROUP BY 1)
SELECT note_id, coalesce(t.text, '') AS text FROM hewv_fictional_bundle n LEFT JOIN t ON sha256(n.source_record_id) = t.k""")
def text_by_hashed_key(spark, folder):
    texts = table(spark, folder, "fictional_raw_records").where("source_record_key IS NOT NULL").select(F.sha2("source_record_key", 256).alias("k"), "rec_id", "text")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", "#")
    return joins.fetched(table(spark, folder, "hewv_fictional_bundle").select("note_id", "source_record_id"), texts, F.sha2("source_record_id", 256), "k", "rec_id", "text", clean).select("note_id", "text")


@query("""
WITH c AS (SELECT checkpoint_id, patient_uid, decision_time, CASE stage WHEN 1 THEN '增强' WHEN 2 THEN '引流' ELSE '建议' END AS word FROM checkpoints),
n AS (SELECT note_id, patient_uid, document_text, TRY_CAST(create_time AS TIMESTAMP) AS t FROM hewv_fictional_bundle)
SELECT checkpoint_id, arg_min(note_id, struct_pack(t := t, i := note_id)) AS note_id FROM c JOIN n ON c.patient_uid = n.patient_uid AND contains(n.document_text, word) AND CAST(decision_time AS DATE) BETWEEN CAST(t AS DATE) - 40 AND CAST(t AS DATE) + 40 GROUP BY 1""")
def text_within_days(spark, folder):
    points = table(spark, folder, "checkpoints").withColumn("word", F.when(F.col("stage") == 1, "增强").when(F.col("stage") == 2, "引流").otherwise("建议"))
    notes = table(spark, folder, "hewv_fictional_bundle").select("note_id", "patient_uid", "document_text", F.expr("try_cast(create_time AS TIMESTAMP_NTZ)").alias("t"))
    return joins.said_near(points, notes, "patient_uid", "checkpoint_id", "decision_time", "word", "note_id", "t", "document_text", days=40)


@query("SELECT r_regionkey AS first, r_name AS second, CAST(NULL AS VARCHAR) AS ninth FROM region")
def columns_by_position(spark, folder):
    return joins.by_position(table(spark, folder, "region"), {0: "first", 1: "second", 9: "ninth"})


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'good' ELSE 'plain' END AS kind FROM events")
def map_lookup_default(spark, folder):
    return _events(spark, folder).select("event_id", joins.looked_up(F.col("event_type"), {"error": "bad", "purchase": "good"}, "plain").alias("kind"))


@query("""
WITH c AS (SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 20]) AS n FROM supplier) SELECT s_suppkey, coalesce(string_agg(n_name, '; ' ORDER BY n_nationkey), '') AS guidance FROM c LEFT JOIN nation ON n = n_nationkey GROUP BY 1""")
def rule_pack_rows(spark, folder):
    cases = table(spark, folder, "supplier").select("s_suppkey", F.array(F.col("s_nationkey"), F.col("s_nationkey") + 20).alias("rules"))
    return joins.rule_rows(cases, table(spark, folder, "nation"), "rules", "n_nationkey", "n_name")


@query("""
SELECT source_record_key, arg_min(patient_uid, struct_pack(r := CASE source_system WHEN 'fictional_hub' THEN 0 WHEN 'fictional_thames' THEN 1 ELSE 2 END, e := patient_uid)) AS patient_uid FROM fictional_raw_records WHERE source_record_key IS NOT NULL AND patient_uid IS NOT NULL GROUP BY 1""")
def preferred_alias(spark, folder):
    return joins.preferred(table(spark, folder, "fictional_raw_records"), "source_record_key", "patient_uid", "source_system", ["fictional_hub", "fictional_thames"])


@query("""
WITH o AS (SELECT note_id, document_text AS b, document_title AS m FROM hewv_fictional_bundle WHERE admission_time IS NOT NULL), n AS (SELECT note_id, trim(document_text) AS b, upper(document_title) || 'x' AS m FROM hewv_fictional_bundle WHERE visit_id <> '1' OR visit_id IS NULL)
SELECT coalesce(o.note_id, n.note_id) AS note_id, CASE WHEN o.note_id IS NULL THEN 'added' WHEN n.note_id IS NULL THEN 'removed' WHEN o.b IS DISTINCT FROM n.b THEN 'body' WHEN o.m IS DISTINCT FROM n.m THEN 'metadata' ELSE 'same' END AS change FROM o FULL JOIN n ON o.note_id = n.note_id""")
def record_change_classes(spark, folder):
    notes = table(spark, folder, "hewv_fictional_bundle")
    old = notes.where("admission_time IS NOT NULL").select("note_id", F.col("document_text").alias("b"), F.col("document_title").alias("m"))
    new = notes.where("visit_id <> '1' OR visit_id IS NULL").select("note_id", F.trim("document_text").alias("b"), F.concat(F.upper("document_title"), F.lit("x")).alias("m"))
    return joins.change_classes(old, new, "note_id", "b", ["m"])


# ---- selection


@query("SELECT event_id, row_number() OVER w AS place, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def sequence_numbers(spark, folder):
    return windows.places(_events(spark, folder), "user_id", ["ts", "event_id"]).select("event_id", "place", "is_first")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders),
a AS (SELECT * FROM (SELECT * FROM r WHERE o_orderpriority = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
b AS (SELECT * FROM (SELECT * FROM r WHERE o_orderpriority = '2-HIGH' AND o_custkey NOT IN (SELECT o_custkey FROM a) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
c AS (SELECT * FROM (SELECT * FROM r WHERE o_orderpriority = '5-LOW' AND o_custkey NOT IN (SELECT o_custkey FROM a UNION SELECT o_custkey FROM b) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def one_per_entity_capped(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return windows.one_each(orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "o_custkey", [-F.col("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""
WITH s AS (SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 40), need AS (SELECT count(*) FILTER (contains(coalesce(text, ''), '黑便')) = 0 AS missing FROM s),
fresh AS (SELECT doc_id, source, text FROM documents WHERE contains(text, '黑便') AND doc_id NOT IN (SELECT doc_id FROM s) ORDER BY sha256('fixed黑便|' || doc_id), doc_id LIMIT 1),
old AS (SELECT s.doc_id FROM s WHERE NOT contains(coalesce(s.text, ''), '黑便') ORDER BY (s.source IS NOT DISTINCT FROM (SELECT source FROM fresh)) DESC, sha256('fixedreplace|' || s.doc_id) DESC, s.doc_id DESC LIMIT 1)
SELECT doc_id FROM s WHERE NOT ((SELECT missing FROM need) AND EXISTS (SELECT 1 FROM fresh) AND doc_id IN (SELECT doc_id FROM old)) UNION ALL SELECT doc_id FROM fresh WHERE (SELECT missing FROM need)""")
def coverage_repair(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("黑便")), F.array(F.lit("黑便"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return windows.covered(docs.orderBy("doc_id").limit(40), docs, "doc_id", "source", "tags", ["黑便"], "fixed").select("doc_id")


@query("""
WITH t(o_orderpriority, target, ord) AS (VALUES ('1-URGENT', 33, 0), ('2-HIGH', 21, 1), ('3-MEDIUM', 12, 2), ('9-NONE', 9, 3)), a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT t.*, coalesce(n, 0) AS available, least(coalesce(n, 0), CAST(round_even(target * 50 / 75.0, 0) AS BIGINT)) AS base FROM t LEFT JOIN a USING (o_orderpriority)), l AS (SELECT *, greatest(50 - sum(base) OVER (), 0) AS lacking FROM b),
s AS (SELECT o_orderpriority FROM (SELECT *, unnest(range(1, CAST(least(lacking, available - base) AS BIGINT) + 1)) AS k FROM l) QUALIFY row_number() OVER (ORDER BY target - base - k DESC, ord, k) <= lacking)
SELECT o_orderpriority, available, base + (SELECT count(*) FROM s WHERE s.o_orderpriority = l.o_orderpriority) AS places FROM l""")
def allocation_half_even(spark, folder):
    return windows.allocate_to_targets(table(spark, folder, "orders"), "o_orderpriority", {"1-URGENT": 33, "2-HIGH": 21, "3-MEDIUM": 12, "9-NONE": 9}, 50)


@query("""
SELECT c_custkey, CASE WHEN p <= 120 THEN 'develop' ELSE 'lock' END AS band FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256('bands|' || c_custkey), c_custkey) AS p FROM customer) WHERE p <= 200""")
def rank_bands_exact(spark, folder):
    return windows.rank_bands(table(spark, folder, "customer"), "c_custkey", "bands", [("develop", 120), ("lock", 80)]).select("c_custkey", "band")


@query("""
WITH f AS (SELECT patient_uid, note_id, CASE WHEN contains(document_text, '引流') THEN 1 ELSE 0 END + CASE WHEN contains(document_text, '化疗') THEN 1 ELSE 0 END + CASE WHEN contains(document_text, '腹水') THEN 1 ELSE 0 END AS n FROM hewv_fictional_bundle)
SELECT patient_uid, string_agg(note_id, ',' ORDER BY n DESC, note_id) AS best FROM (SELECT * FROM f WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY patient_uid ORDER BY n DESC, note_id) <= 5) GROUP BY 1""")
def best_by_overlap(spark, folder):
    words = ["引流", "化疗", "腹水"]
    flags = F.array_compact(F.array(*[F.when(F.contains("document_text", F.lit(w)), F.lit(w)) for w in words]))
    return windows.best_overlap(table(spark, folder, "hewv_fictional_bundle").select("patient_uid", "note_id", flags.alias("flags")), "patient_uid", "note_id", "flags", words, 5)


@query("""
SELECT patient_uid, row_number() OVER (PARTITION BY patient_uid ORDER BY source_type = 'laboratory' NULLS FIRST, clinical_time NULLS LAST, rec_id) AS place, rec_id FROM fictional_raw_records WHERE patient_uid IS NOT NULL""")
def laboratory_last(spark, folder):
    rows = table(spark, folder, "fictional_raw_records").where("patient_uid IS NOT NULL").select("patient_uid", "rec_id", (F.col("source_type") == "laboratory").alias("late"), F.col("clinical_time").isNull().alias("unknown"), "clinical_time")
    return windows.places(rows, "patient_uid", ["late", "unknown", "clinical_time", "rec_id"]).select("patient_uid", "place", "rec_id")


# ---- aggregates


@query("""
SELECT user_id, array_to_string(list(event_type ORDER BY f), ';') AS kinds FROM (SELECT user_id, event_type, min(struct_pack(t := ts, i := event_id)) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, folder):
    return aggregates.ordered_distinct(_events(spark, folder), "user_id", ["ts", "event_id"], "event_type").select("user_id", F.array_join("values", ";").alias("kinds"))


@query("""
SELECT min(rec_id) AS rec_id, lower(trim(coalesce(patient_uid, ''))) AS a, lower(trim(coalesce(report_type, ''))) AS b FROM fictional_raw_records GROUP BY 2, 3""")
def distinct_facts(spark, folder):
    facts = aggregates.distinct_facts(table(spark, folder, "fictional_raw_records").select("rec_id", "patient_uid", "report_type"), ["patient_uid", "report_type"], "rec_id", "6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return facts.select("rec_id", low("patient_uid").alias("a"), low("report_type").alias("b"))


@query("""
SELECT min(image_row_id) AS image_row_id, string_agg(DISTINCT image_row_id, ';' ORDER BY image_row_id) AS refs FROM imaging_all GROUP BY patient_uid, exam_method, exam_datetime, CASE WHEN coalesce(report_deidentified, '') = '' THEN 'row' || image_row_id ELSE sha256(report_deidentified) END""")
def presented_once(spark, folder):
    images = table(spark, folder, "imaging_all")
    body = F.when(F.coalesce("report_deidentified", F.lit("")) == "", F.concat(F.lit("row"), F.col("image_row_id"))).otherwise(F.sha2("report_deidentified", 256))
    return aggregates.presented_once(images, [F.col("patient_uid"), F.col("exam_method"), F.col("exam_datetime"), body], "image_row_id")


@query("SELECT report_type, count(*) AS n FROM fictional_raw_records WHERE report_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_counts(spark, folder):
    return aggregates.top_counts(table(spark, folder, "fictional_raw_records"), "report_type", 12)


@query("""
SELECT user_id, CAST(sum(coalesce(CASE WHEN event_type = 'purchase' THEN CAST(value * 100 AS BIGINT) END, 0)) AS BIGINT) AS cents, bool_or(coalesce(value > 99, false)) AS high, bool_or(event_type = 'signup') AS signed FROM events GROUP BY 1""")
def null_as_zero_and_any(spark, folder):
    events = _events(spark, folder)
    spent = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("bigint"))
    sums = events.groupBy("user_id").agg(F.sum(F.coalesce(spent, F.lit(0))).alias("cents"))
    return sums.join(aggregates.any_gates(events, "user_id", [("high", F.col("value") > 99), ("signed", F.col("event_type") == "signup")]), "user_id")


@query("""
WITH f AS (SELECT patient_uid, unnest([struct_pack(f := 'report_type', v := nullif(trim(report_type), '')), struct_pack(f := 'event_type', v := nullif(trim(event_type), '')), struct_pack(f := 'sample_time', v := nullif(trim(sample_time), ''))]) AS x FROM fictional_raw_records),
s AS (SELECT patient_uid, x.f AS field, CASE WHEN min(x.v) IS NULL THEN 'unknown' WHEN min(x.v) <> max(x.v) THEN 'conflict' WHEN min(x.v) IN ('无', 'none') THEN 'absent' ELSE 'present' END AS status, min(x.v) AS value FROM f GROUP BY 1, 2)
SELECT * FROM s""")
def field_statuses(spark, folder):
    return aggregates.statuses(table(spark, folder, "fictional_raw_records"), "patient_uid", ["report_type", "event_type", "sample_time"])


@query("""
WITH f AS (SELECT patient_uid, unnest([struct_pack(f := 'report_type', v := nullif(trim(report_type), '')), struct_pack(f := 'event_type', v := nullif(trim(event_type), '')), struct_pack(f := 'sample_time', v := nullif(trim(sample_time), ''))]) AS x FROM fictional_raw_records),
s AS (SELECT patient_uid, x.f AS field, CASE WHEN min(x.v) IS NULL THEN 'unknown' WHEN min(x.v) <> max(x.v) THEN 'conflict' WHEN min(x.v) IN ('无', 'none') THEN 'absent' ELSE 'present' END AS status FROM f GROUP BY 1, 2),
g AS (SELECT patient_uid, CAST(sum(CASE status WHEN 'conflict' THEN 500 WHEN 'unknown' THEN 0 ELSE 1000 END) // count(*) AS BIGINT) AS score_permille, count(*) FILTER (status = 'unknown' AND field = 'sample_time') AS unknown_high FROM s GROUP BY 1)
SELECT *, CASE WHEN score_permille >= 750 AND unknown_high <= 0 THEN 'A' WHEN score_permille >= 500 THEN 'B' ELSE 'C' END AS grade FROM g""")
def status_grades(spark, folder):
    held = aggregates.statuses(table(spark, folder, "fictional_raw_records"), "patient_uid", ["report_type", "event_type", "sample_time"])
    return aggregates.status_grades(held, "patient_uid", ["sample_time"], 0)


@query("""
SELECT user_id, string_agg(DISTINCT f, ';' ORDER BY f) AS flags FROM (SELECT user_id, unnest(list_filter([event_type, CASE WHEN value > 50 THEN 'high' END], lambda x: x IS NOT NULL)) AS f FROM events) GROUP BY 1""")
def united_flags(spark, folder):
    flags = F.array_compact(F.array(F.col("event_type"), F.when(F.col("value") > 50, F.lit("high"))))
    return aggregates.united(_events(spark, folder).select("user_id", flags.alias("flags")), "user_id", "flags").withColumn("flags", F.array_join("flags", ";"))


@query("""
SELECT user_id, CAST(top * 1000 // n AS BIGINT) > 260 AS collapsed, CAST(top * 1000 // n AS BIGINT) AS share_permille FROM (SELECT user_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1)""")
def collapse_test(spark, folder):
    shares = aggregates.dominant_share(_events(spark, folder), "user_id", "event_type")
    return shares.select("user_id", (F.col("share_permille") > 260).alias("collapsed"), "share_permille")


@query("""
SELECT lab_id, CASE WHEN p = 0 OR a = 0 THEN 'LEVEL_NONE' WHEN a >= 2 AND p = 3 THEN 'LEVEL_HIGH' WHEN a >= 2 AND p = 2 THEN 'LEVEL_MEDIUM' WHEN a >= 1 AND p = 1 THEN 'LEVEL_LOW' END AS level FROM (SELECT lab_id, lab_id % 4 AS a, (lab_id // 4) % 5 AS p FROM four_stage)""")
def derived_levels(spark, folder):
    a, p = F.col("lab_id") % 4, F.expr("(lab_id div 4) % 5")
    return table(spark, folder, "four_stage").select("lab_id", aggregates.level(a, p).alias("level"))


@query("""
WITH e AS (SELECT CAST(floor(value) AS BIGINT) AS s, event_type = 'error' AS h FROM events) SELECT gate, count(*) AS covered, count(*) FILTER (h) AS hits, count(*) * 1000 // (SELECT count(*) FROM e) AS coverage_permille, count(*) FILTER (h) * 1000 // count(*) AS rate_permille
FROM e, (SELECT unnest([0, 25, 50, 90]) AS gate) g WHERE s >= gate GROUP BY 1""")
def selective_curve(spark, folder):
    return aggregates.selective_curve(_events(spark, folder), F.floor("value"), F.col("event_type") == "error", [0, 25, 50, 90])


@query("""
SELECT event_type, count(*) FILTER (value > 90 AND b) * 1000 // greatest(count(*) FILTER (value > 90), 1) AS intercepted_permille, count(*) FILTER (value <= 90 AND b) * 1000 // greatest(count(*) FILTER (value <= 90), 1) AS escalated_permille, CAST(sum(event_id % 4) * 1000 // count(*) AS BIGINT) AS mean_permille FROM (SELECT *, event_id % 3 = 0 AS b FROM events) GROUP BY 1""")
def evaluation_rates(spark, folder):
    bad, held = F.col("value") > 90, F.col("event_id") % 3 == 0
    counts = _events(spark, folder).groupBy("event_type").agg(F.count_if(bad & held).alias("a"), F.count_if(bad).alias("b"), F.count_if(~bad & held).alias("c"), F.count_if(~bad).alias("d"), F.sum(F.col("event_id") % 4).alias("s"), F.count("*").alias("n"))
    return counts.select("event_type", F.expr("a * 1000 div greatest(b, 1)").alias("intercepted_permille"), F.expr("c * 1000 div greatest(d, 1)").alias("escalated_permille"), F.expr("s * 1000 div n").alias("mean_permille"))


# ---- checks


@query("SELECT report_type, CASE WHEN count(patient_uid) = 0 THEN 'unmapped' ELSE 'ambiguous' END AS problem FROM fictional_raw_records GROUP BY 1 HAVING count(DISTINCT patient_uid) <> 1")
def key_violations(spark, folder):
    return validate.key_violations(table(spark, folder, "fictional_raw_records"), "report_type", "patient_uid")


@query("""
(SELECT DISTINCT patient_uid, 'missing' AS side FROM checkpoints WHERE patient_uid NOT IN (SELECT patient_uid FROM encounter_interval WHERE patient_uid IS NOT NULL)) UNION ALL (SELECT DISTINCT patient_uid, 'unexpected' FROM encounter_interval WHERE patient_uid NOT IN (SELECT patient_uid FROM checkpoints WHERE patient_uid IS NOT NULL))""")
def coverage_gaps(spark, folder):
    return validate.coverage_gaps(table(spark, folder, "checkpoints"), table(spark, folder, "encounter_interval"), "patient_uid")


@query("""
WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) SELECT a.o_orderpriority AS part_a, b.o_orderpriority AS part_b, count(*) AS n FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.o_orderpriority < b.o_orderpriority GROUP BY 1, 2""")
def part_overlaps(spark, folder):
    return validate.overlaps(table(spark, folder, "orders"), "o_orderpriority", "o_custkey")


@query("""
SELECT rec_id, unnest(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'body' END, CASE WHEN NOT coalesce(available_time >= clinical_time, false) THEN 'order' END, CASE WHEN source_type NOT IN ('imaging', 'laboratory', 'document', 'pathology') THEN 'kind' END], lambda x: x IS NOT NULL)) AS rule FROM fictional_raw_records""")
def record_violations(spark, folder):
    rules = [("body", F.coalesce("text", F.lit("")) != ""), ("order", F.col("available_time") >= F.col("clinical_time")), ("kind", F.coalesce(F.col("source_type").isin("imaging", "laboratory", "document", "pathology"), F.lit(True)))]
    return validate.violations(table(spark, folder, "fictional_raw_records"), "rec_id", rules)


@query("""
SELECT 'filled:patient_uid' AS rule, count(*) FILTER (coalesce(trim(patient_uid), '') = '') AS rows FROM four_stage UNION ALL SELECT 'filled:unit_raw', count(*) FILTER (coalesce(trim(unit_raw), '') = '') FROM four_stage
UNION ALL SELECT 'values:source_abnormal_flag', count(*) FILTER (source_abnormal_flag IS NOT NULL AND source_abnormal_flag NOT IN ('H', 'L')) FROM four_stage UNION ALL SELECT 'grain', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM four_stage GROUP BY source_record_key HAVING count(*) > 1)""")
def contract_violations(spark, folder):
    contract = validate.Contract(("source_record_key",), ("patient_uid", "unit_raw"), (("source_abnormal_flag", ("H", "L")),))
    return validate.contract_violations(table(spark, folder, "four_stage"), contract)


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'CASE_OR_STEP' WHEN event_id % 7 = 0 THEN 'GAP_IDS' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'TERMINAL_MODE' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'TERMINAL_TARGET' WHEN event_type <> 'signup' AND event_id % 5 = 0 THEN 'ACQUISITION_TARGET' END AS error FROM events WHERE event_type IS NOT NULL""")
def sequential_output_rules(spark, folder):
    e, last = F.col("event_id"), F.col("event_type") == "signup"
    gap = lambda name: F.struct(F.lit(name).alias("gap_id"))
    output = F.struct(
        F.when(e % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")).alias("case_id"), F.lit(1).alias("step"),
        F.when(last, F.when(e % 3 == 0, "PAUSE_FOR_EVIDENCE").otherwise("DEFER")).otherwise("PAUSE_FOR_EVIDENCE").alias("mode"), F.when(last, "STOP").otherwise("TEST").alias("action"),
        F.when(last, F.when(e % 2 == 0, "G1")).otherwise(F.when(e % 5 == 0, "G9").otherwise("G1")).alias("target_gap_id"), F.when(last, "NOT_APPLICABLE").otherwise("HIGH").alias("gain"),
        F.when(e % 7 == 0, F.array(gap("G1"), gap("G1"))).otherwise(F.array(gap("G1"), gap("G2"))).alias("gaps"),
    )
    rows = _events(spark, folder).where("event_type IS NOT NULL").select("event_id", "user_id", output.alias("o"))
    return rows.select("event_id", validate.output_errors(F.col("user_id"), F.lit(1), F.col("o"), {"STOP": "DEFER"}).alias("error"))


@query("""
SELECT note_id, unnest(list_filter([CASE WHEN regexp_matches(document_text, '1[0-9]{10}') THEN 'phone' END, CASE WHEN regexp_matches(document_text, '@') THEN 'mail' END, CASE WHEN contains(document_text, '代签') THEN 'literal:代签' END], lambda x: x IS NOT NULL)) AS alarm FROM hewv_fictional_bundle""")
def text_alarms(spark, folder):
    return validate.text_alarms(table(spark, folder, "hewv_fictional_bundle"), "note_id", "document_text", [("phone", "1[0-9]{10}"), ("mail", "@")], ["代签"])


@query("""
WITH c AS (SELECT 'orders' AS name, count(*) AS actual FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'part', count(*) FROM part), e(name, expected) AS (VALUES ('orders', 100), ('events', 10000), ('absent', 5))
SELECT coalesce(e.name, c.name) AS name, expected::BIGINT AS expected, actual, coalesce(actual, 0) - coalesce(expected, 0) AS delta FROM e FULL JOIN c ON e.name = c.name""")
def preflight_deltas(spark, folder):
    counts = None
    for name in ("orders", "events", "part"):
        own = readers.row_count(table(spark, folder, name), name)
        counts = own if counts is None else counts.unionByName(own)
    return validate.preflight(counts, {"orders": 100, "events": 10000, "absent": 5})


# ---- replay and policies


@query("""
WITH s AS (SELECT user_id, min(ts) AS now FROM events WHERE event_type = 'signup' GROUP BY 1),
m AS (SELECT s.user_id, e.event_id, e.ts, CASE e.event_type WHEN 'purchase' THEN 'EXACT' ELSE 'COMPATIBLE' END AS match, e.event_id % 4 <> 0 AS audited, e.event_id % 6 <> 0 AS exact, e.event_id % 12 = 6 AS reviewed, s.now
  FROM s LEFT JOIN events e ON s.user_id = e.user_id AND (e.event_type = 'purchase' OR (e.event_type = 'click' AND e.event_id % 5 = 0)) AND e.event_id % 3 <> 1),
c AS (SELECT *, CASE WHEN event_id IS NULL THEN 'none' WHEN NOT audited OR (NOT exact AND NOT reviewed) THEN 'review' WHEN exact AND (ts <= now OR ts > now + INTERVAL 5 DAY) THEN 'none' ELSE 'eligible' END AS st FROM m),
g AS (SELECT user_id, count(*) FILTER (st = 'eligible') AS n, coalesce(bool_or(st = 'eligible' AND NOT exact), false) AS loose, bool_or(st = 'review') AS review, arg_min(event_id, struct_pack(t := ts, i := event_id)) FILTER (st = 'eligible') AS e, arg_min(match, struct_pack(t := ts, i := event_id)) FILTER (st = 'eligible') AS m FROM c GROUP BY 1)
SELECT user_id AS case_id, CASE WHEN n = 0 THEN CASE WHEN review THEN 'REVIEW_REQUIRED' ELSE 'COUNTERFACTUAL_UNOBSERVED' END WHEN n > 1 AND loose THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status,
  CASE WHEN n = 1 OR (n > 1 AND NOT loose) THEN e END AS event_id, CASE WHEN n = 1 OR (n > 1 AND NOT loose) THEN m END AS match FROM g""")
def typed_replay(spark, folder):
    states = _events(spark, folder, "signup").groupBy(F.col("user_id").alias("case_id")).agg(F.min("ts").alias("now")).select("case_id", F.lit("BUY").alias("action"), F.lit("SHOP").alias("site"), F.lit("D1").alias("domain"), "now", F.col("now").alias("baseline"), F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(False).alias("strict"))
    e = F.col("event_id")
    events = _events(spark, folder).select(
        F.col("user_id").alias("case_id"), "event_id", F.col("event_type").alias("kind"), F.when(e % 2 == 0, "SHOP").otherwise("store").alias("site"), F.when(e % 3 != 1, F.array(F.lit("D1"))).otherwise(F.array(F.lit("D2"))).alias("domains"),
        F.when((F.col("event_type") == "click") & (e % 5 == 0), F.array(F.lit("BUY"))).otherwise(F.array().cast("array<string>")).alias("compatible"), F.col("ts").alias("at"), (e % 6 != 0).alias("exact"), (e % 4 != 0).alias("audited"), (e % 12 == 6).alias("reviewed"),
    )
    return replay.typed_match(states, events, {"purchase": "BUY"}, {"store": "SHOP"}, 5)


@query("""
SELECT c.checkpoint_id, d.decision, CASE WHEN c.stage IS NOT NULL THEN 'user' END AS role, 'Question ' || c.stage || chr(10) || chr(10) || c.patient_uid AS content FROM checkpoints c LEFT JOIN (VALUES (1, 'GO'), (2, 'WAIT')) d(stage, decision) ON c.stage = d.stage WHERE c.patient_uid IS NOT NULL""")
def scripted_messages(spark, folder):
    script = spark.createDataFrame([(1, "GO"), (2, "WAIT")], "step int, decision string")
    points = table(spark, folder, "checkpoints").where("patient_uid IS NOT NULL").select("checkpoint_id", F.col("patient_uid").alias("case_id"), F.col("stage").cast("int").alias("step"))
    plan = points.select("case_id", "step").distinct().join(script, "step")
    asked = replay.scripted(points, plan)
    built = asked.select("checkpoint_id", "decision", replay.messages("rules", F.concat(F.lit("Question "), F.col("step")), F.col("case_id"))[1].alias("m"))
    return built.select("checkpoint_id", "decision", "m.role", "m.content")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1,2,4,8,8' ELSE '' END AS delays FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'F'))""")
def outstanding_requests(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    left = replay.outstanding(orders, orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", {"o_orderstatus": ("O", "F")})
    return left.select("o_orderkey", F.array_join(F.transform(replay.retry_delays(F.lit(5), F.when(F.col("o_orderstatus") == "F", 503).otherwise(400)), lambda d: d.cast("string")), ",").alias("delays"))


# ---- provenance and sources


@query("""
SELECT rec_id, CASE WHEN nullif(trim(report_type), '') IS NULL THEN 'unknown' ELSE 'known' END AS fact_status, nullif(trim(report_type), '') AS fact_value, CASE WHEN nullif(trim(report_type), '') IS NOT NULL THEN nullif(trim(source_system), '') END AS fact_source_system,
  coalesce(nullif(concat_ws('。', nullif(trim(event_type), ''), nullif(trim(report_type), '')), ''), left(text, 10)) AS assembled, coalesce(patient_uid, '') || '|' || coalesce(CAST(source_row AS VARCHAR), '') AS stay, '' AS review FROM fictional_raw_records""")
def provenance_rows(spark, folder):
    value = F.nullif(F.trim("report_type"), F.lit(""))
    source = nodes.source_node(F.col("source_system"), F.col("source_file"), F.col("source_record_id"), F.col("clinical_time"))
    fact = nodes.fact_node(value, F.when(value.isNull(), "unknown").otherwise("known"), source)
    rows = table(spark, folder, "fictional_raw_records").select("rec_id", fact.alias("fact"), nodes.report_text(F.col("event_type"), F.col("report_type"), fallback=F.left("text", F.lit(10))).alias("assembled"), nodes.episode_key(F.col("patient_uid"), F.col("source_row")).alias("stay"), F.lit(1).alias("_private"))
    wide = nodes.flattened(nodes.public(rows, blanks=["review"]), "fact", "fact")
    return wide.select("rec_id", "fact_status", "fact_value", "fact_source_system", "assembled", "stay", "review")


@query("""
SELECT patient_uid, '[' || coalesce(string_agg('{"title":"' || replace(coalesce(left(document_title, 4), ''), '"', '') || '"}', ',' ORDER BY note_id), '') || ']' AS payload FROM (SELECT * FROM hewv_fictional_bundle WHERE patient_uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_uid ORDER BY note_id) <= 3) GROUP BY 1""")
def payload_top_k(spark, folder):
    notes = table(spark, folder, "hewv_fictional_bundle").where("patient_uid IS NOT NULL")
    kept = windows.quota(notes, "patient_uid", ["note_id"], {}, 3).groupBy("patient_uid").agg(F.array_sort(F.collect_list(F.struct("note_id", F.coalesce("document_title", F.lit("")).alias("title")))).alias("items"))
    return kept.select("patient_uid", nodes.payload(F.col("items"), ["title"], 3, 4).alias("payload"))


@query("""
SELECT patient_uid, row_number() OVER (PARTITION BY patient_uid ORDER BY kind, ident) AS place, kind, ident FROM (SELECT patient_uid, 'image' AS kind, CAST(image_row_id AS VARCHAR) AS ident FROM imaging_all UNION ALL SELECT patient_uid, 'note', CAST(note_id AS VARCHAR) FROM hewv_fictional_bundle) WHERE patient_uid IS NOT NULL""")
def evidence_rows(spark, folder):
    def gathered(name, key, at, title, body):
        item = F.struct(F.col(at).alias("at"), F.col(title).alias("title"), F.col(key).cast("string").alias("ident"), F.col(body).alias("text"))
        return table(spark, folder, name).where("patient_uid IS NOT NULL").groupBy("patient_uid").agg(F.collect_list(item).alias(key))

    both = gathered("imaging_all", "image_row_id", "exam_datetime", "exam_method", "report_deidentified").join(gathered("hewv_fictional_bundle", "note_id", "create_time", "document_title", "document_text"), "patient_uid", "full_outer")
    empty = F.array().cast("array<struct<at:string,title:string,ident:string,text:string>>")
    rows = both.select("patient_uid", F.explode(nodes.evidence_rows({"image": F.coalesce("image_row_id", empty), "note": F.coalesce("note_id", empty)})).alias("x")).select("patient_uid", "x.kind", "x.ident")
    return windows.places(rows, "patient_uid", ["kind", "ident"]).select("patient_uid", "place", "kind", "ident")


@query("""
SELECT min(image_row_id) AS image_row_id, patient_uid, left(r, 40) AS report FROM (SELECT image_row_id, patient_uid, exam_method, exam_datetime, CASE WHEN coalesce(trim(report_deidentified), '') = '' THEN '描述：' || coalesce(exam_method, '') ELSE trim(report_deidentified) END AS r FROM imaging_all WHERE TRY_CAST(exam_datetime AS TIMESTAMP) IS NOT NULL) GROUP BY patient_uid, exam_datetime, exam_method, r""")
def imaging_scan(spark, folder):
    body = F.when(F.coalesce(F.trim("report_deidentified"), F.lit("")) == "", F.concat(F.lit("描述："), F.coalesce("exam_method", F.lit("")))).otherwise(F.trim("report_deidentified"))
    images = table(spark, folder, "imaging_all").where(F.expr("try_cast(exam_datetime AS TIMESTAMP_NTZ) IS NOT NULL"))
    return readers.distinct_reports(images, "image_row_id", ["patient_uid", "exam_datetime", "exam_method"], body, 40).select("image_row_id", "patient_uid", "report")


@query("""
SELECT e.event_id FROM events e WHERE event_type IN ('click', 'error') AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ) AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'error'))""")
def planned_scan(spark, folder):
    events = _events(spark, folder)
    plan = events.where("event_type IN ('click', 'error')").select(F.col("event_type").alias("task_id"), "user_id").distinct()
    wanted = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id")).join(plan.select("user_id").distinct(), "user_id", "left_semi")
    return readers.planned(events.withColumn("task_id", F.col("event_type")), plan, wanted, "task_id", "user_id").select("event_id")


@query("""
SELECT system, string_agg(name, ';' ORDER BY name) AS names FROM (SELECT c_name AS name, CASE WHEN regexp_matches(c_name, '(?i)1$') THEN 'one' WHEN regexp_matches(c_name, '(?i)2$') THEN 'two' END AS system FROM customer) WHERE system IS NOT NULL GROUP BY 1""")
def terminology_inventory(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_name").alias("name"))
    return readers.inventory(names, [("one", "(?i)1$"), ("two", "(?i)2$"), ("none", "x{9}")]).where("found > 0").select("system", "names")


@query("SELECT patient_uid, epoch_us(min(t)) AS first_us FROM (SELECT patient_uid, TRY_CAST(clinical_time AS TIMESTAMP) AS t FROM fictional_raw_records) WHERE t IS NOT NULL GROUP BY 1")
def dated_rows_only(spark, folder):
    return table(spark, folder, "fictional_raw_records").select("patient_uid", F.expr("try_cast(clinical_time AS TIMESTAMP_NTZ)").alias("t")).where("t IS NOT NULL").groupBy("patient_uid").agg(F.min("t").alias("t")).select("patient_uid", _us("t").alias("first_us"))


@query("SELECT rec_id, clinical_time FROM fictional_raw_records WHERE contains(text, '增强') AND patient_uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_uid ORDER BY clinical_time DESC NULLS LAST, rec_id DESC) <= 5")
def newest_topic_reports(spark, folder):
    hits = table(spark, folder, "fictional_raw_records").where("contains(text, '增强') AND patient_uid IS NOT NULL").select("patient_uid", "rec_id", "clinical_time")
    return windows.last_n(hits, "patient_uid", ["clinical_time", "rec_id"], 5).select("rec_id", "clinical_time")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 8000 AND c_mktsegment = 'BUILDING' THEN 'first' WHEN c_acctbal > 5000 THEN 'second' WHEN c_acctbal > 0 THEN 'third' ELSE 'none' END AS tier FROM customer""")
def screening_tiers(spark, folder):
    tier = aggregates.tier([("first", (F.col("c_acctbal") > 8000) & (F.col("c_mktsegment") == "BUILDING")), ("second", F.col("c_acctbal") > 5000), ("third", F.col("c_acctbal") > 0)], "none")
    return table(spark, folder, "customer").select("c_custkey", tier.alias("tier"))


@query("""
WITH p AS (SELECT event_id, unnest([struct_pack(n := 'always', d := 'GO'), struct_pack(n := 'never', d := 'WAIT'), struct_pack(n := 'value', d := CASE WHEN value > 50 THEN 'GO' ELSE 'WAIT' END)]) AS x, CASE WHEN event_type = 'error' THEN 'WAIT' ELSE 'GO' END AS truth FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)
SELECT x.n AS policy, count(*) AS n, count(*) FILTER (x.d = truth) AS agreed FROM p GROUP BY 1""")
def comparator_policies(spark, folder):
    """Static policies on identical input, in one pass."""
    rows = _events(spark, folder).where("value IS NOT NULL AND event_type IS NOT NULL").withColumn("truth", F.when(F.col("event_type") == "error", "WAIT").otherwise("GO"))
    return replay.compared(rows, {"always": F.lit("GO"), "never": F.lit("WAIT"), "value": F.when(F.col("value") > 50, "GO").otherwise("WAIT")}, F.col("truth"))


@query("""
SELECT patient_uid, min(rec_id) AS kept, count(*) AS source_count, string_agg(rec_id || '=' || coalesce(source_system, ''), ';' ORDER BY rec_id) AS source_map FROM fictional_raw_records WHERE text IS NOT NULL GROUP BY patient_uid, event_type, sha256(text)""")
def report_source_map(spark, folder):
    rows = table(spark, folder, "fictional_raw_records").where("text IS NOT NULL").withColumn("digest", F.sha2("text", 256))
    return aggregates.source_map(rows, "rec_id", ["patient_uid", "event_type", "digest"], "source_system").select("patient_uid", "kept", "source_count", "source_map")


@query("""
SELECT patient_uid, count(*) AS n, count(DISTINCT rec_id) AS distinct_n FROM fictional_raw_records WHERE patient_uid IN (SELECT patient_uid FROM checkpoints WHERE stage = 2) GROUP BY 1""")
def cohort_export(spark, folder):
    """A cohort's records written raw, split by kind, and read again."""
    cohort = table(spark, folder, "checkpoints").where("stage = 2")
    base = shared_folder(spark, "cohort")
    sinks.parquet(readers.only_ids(table(spark, folder, "fictional_raw_records"), "patient_uid", cohort), base, by=["source_type"])
    return readers.parquet(spark, base).groupBy("patient_uid").agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("distinct_n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS deep, event_type || '/' || coalesce(CAST(user_id AS VARCHAR), '') AS joined FROM events WHERE props IS NOT NULL")
def dotted_path(spark, folder):
    nested = F.concat(F.lit('{"a":{"b":[{"c":'), F.col("props"), F.lit("}]}}"))
    events = _events(spark, folder).where("props IS NOT NULL")
    return events.select("event_id", nodes.at_path(nested, "a.b[0].c.k", "bigint").alias("deep"), F.concat_ws("/", "event_type", F.coalesce(F.col("user_id").cast("string"), F.lit(""))).alias("joined"))


@query("""
WITH r AS (SELECT patient_uid, min(rec_id) AS rec_id, report_type FROM fictional_raw_records WHERE patient_uid IS NOT NULL AND report_type IS NOT NULL GROUP BY patient_uid, report_type QUALIFY row_number() OVER (PARTITION BY patient_uid ORDER BY min(rec_id)) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY report_type ORDER BY rec_id) > 4 AS over_cap FROM r) SELECT rec_id, over_cap FROM p ORDER BY over_cap, rec_id LIMIT 60""")
def soft_cap_one_each(spark, folder):
    rows = table(spark, folder, "fictional_raw_records").where("patient_uid IS NOT NULL AND report_type IS NOT NULL").select("patient_uid", "rec_id", "report_type")
    return windows.soft_cap(windows.first_rows(rows, "patient_uid", ["rec_id"]), "report_type", ["rec_id"], 4, 60).select("rec_id", "over_cap")


@query("""
SELECT event_id, value > 50 AS j, event_type = 'error' AS m, user_id % 4 AS i, NULL::BIGINT AS b FROM events""")
def action_value_vector(spark, folder):
    """The values of an action side by side, never summed."""
    vector = nodes.value_vector({"j": F.col("value") > 50, "m": F.col("event_type") == "error", "i": F.col("user_id") % 4, "b": F.lit(None).cast("bigint")})
    return _events(spark, folder).select("event_id", vector.alias("v")).select("event_id", "v.*")
