"""Queries over documents and packets: times in texts, spans, text rules and the packet flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import spans, text, timerange
from tidemark.operators import flow, packets
from tidemark.plans.reference import _us, query
from tidemark.sources.tables import table

# One written time in the other engine's words, and its start as microseconds; the precision follows from what is there.
_FIND = r"20\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}\s*日?(?:[T\s]*\d{1,2}\s*[:：时]\s*\d{1,2}\s*分?(?:\s*[:：]?\s*\d{1,2}(?:\.\d+)?\s*秒?)?)?"


def _parsed(v: str) -> str:
    """SQL for a written time as a struct (s, p): start and precision."""
    n = f"regexp_extract_all({v}, '[0-9]+')"
    stamp = f"{n}[1] || '-' || lpad({n}[2], 2, '0') || '-' || lpad({n}[3], 2, '0') || ' ' || lpad(coalesce({n}[4], '0'), 2, '0') || ':' || lpad(coalesce({n}[5], '0'), 2, '0') || ':' || lpad(coalesce({n}[6], '0'), 2, '0')"
    return f"struct_pack(s := TRY_CAST({stamp} AS TIMESTAMP), p := CASE WHEN len({n}) < 5 THEN 'day' WHEN len({n}) < 6 THEN 'minute' ELSE 'second' END)"


_DOCUMENT_TIME = f"""
SELECT *, list_distinct(list_filter(list_transform(x, lambda v: {_parsed('v')}), lambda r: r.s IS NOT NULL)) AS found FROM (
  SELECT *, list_filter([regexp_extract(document_text, '^\\s*({_FIND})', 1)] || coalesce(regexp_extract_all(document_text, '记录时间\\s*[:：]\\s*({_FIND})', 1), []), lambda v: v <> '') AS x FROM hewv_fictional_bundle)"""
_TIME_AND_ISSUE = "CASE WHEN len(coalesce(found, [])) = 1 THEN found[1].s END AS s, CASE WHEN len(coalesce(found, [])) = 1 THEN found[1].p END AS p, CASE WHEN len(coalesce(found, [])) = 1 THEN NULL WHEN len(coalesce(found, [])) > 1 THEN 'DOCUMENT_TIME_AMBIGUOUS' ELSE 'DOCUMENT_TIME_MISSING' END AS issue"


@query(f"SELECT note_id, epoch_us(s) AS start_us, p AS precision, issue FROM (SELECT note_id, {_TIME_AND_ISSUE} FROM ({_DOCUMENT_TIME}))")
def document_times(spark, folder):
    t = timerange.document_time(F.col("document_text"))
    found = table(spark, folder, "hewv_fictional_bundle").select("note_id", t.alias("t"))
    return found.select("note_id", _us(F.col("t.time.start")).alias("start_us"), F.col("t.time.precision").alias("precision"), F.col("t.issue").alias("issue"))


@query(f"""
SELECT note_id, epoch_us(({_parsed('v')}).s) AS header_us FROM (SELECT note_id, nullif(regexp_extract(document_text, '^\\s*(?:[^\\d\\s]{{1,8}}\\s*[:：]\\s*)?({_FIND})', 1), '') AS v FROM hewv_fictional_bundle)""")
def document_header_times(spark, folder):
    return table(spark, folder, "hewv_fictional_bundle").select("note_id", _us(timerange.header_time(F.col("document_text"))).alias("header_us"))


@query(f"""
SELECT note_id, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: coalesce(CASE WHEN ({_parsed('v')}).p = 'day' THEN CAST(({_parsed('v')}).s AS DATE) > CAST(c AS DATE) OR (CAST(({_parsed('v')}).s AS DATE) = CAST(c AS DATE) AND date_trunc('day', c) = c)
  ELSE ({_parsed('v')}).s >= c END, false)))), ';') AS later FROM (SELECT note_id, coalesce(regexp_extract_all(document_text, '{_FIND}'), []) AS x, TRY_CAST(create_time AS TIMESTAMP) AS c FROM hewv_fictional_bundle)""")
def future_dates(spark, folder):
    notes = table(spark, folder, "hewv_fictional_bundle").select("note_id", F.coalesce("document_text", F.lit("")).alias("t"), F.expr("try_cast(create_time AS TIMESTAMP_NTZ)").alias("c"))
    return notes.select("note_id", F.array_join(timerange.future_dates(F.col("t"), F.col("c")), ";").alias("later"))


@query("""
SELECT rec_id, epoch_us(CASE WHEN length(report_time) >= 16 AND regexp_matches(report_time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$') THEN TRY_CAST(replace(report_time, 'T', ' ') AS TIMESTAMP) END) AS exact_us FROM fictional_raw_records""")
def exact_times(spark, folder):
    return table(spark, folder, "fictional_raw_records").select("rec_id", _us(timerange.exact_time(F.col("report_time"))).alias("exact_us"))


@query("""
SELECT rec_id, CAST(CASE WHEN regexp_matches(v, '^([0-9]{8}([^0-9].*)?|[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}([^0-9].*)?)$')
  THEN TRY_CAST(regexp_replace(v, '^([0-9]{4})[-/.年]?([0-9]{1,2})[-/.月]?([0-9]{1,2})([^0-9].*)?$', '\\1-\\2-\\3') AS DATE) END AS VARCHAR) AS day FROM (SELECT rec_id, trim(report_time) AS v FROM fictional_raw_records)""")
def iso_dates(spark, folder):
    return table(spark, folder, "fictional_raw_records").select("rec_id", timerange.iso_date(F.col("report_time")).cast("string").alias("day"))


@query("""
SELECT checkpoint_id, epoch_us(CASE WHEN stage = 1 THEN decision_time ELSE CAST(CAST(decision_time AS DATE) AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND END) AS at_us, CASE WHEN stage = 1 THEN 'cited' ELSE 'end_of_day' END AS basis FROM checkpoints""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"))
def decision_times(spark, folder):
    points = table(spark, folder, "checkpoints").withColumn("at", F.col("decision_time").cast("timestamp_ntz"))
    cited = F.when(F.col("stage") == 1, F.concat(F.lit("case@"), F.date_format(F.col("at"), "yyyy-MM-dd HH:mm:ss"), F.lit(":quote")))
    t = timerange.decision_time(F.coalesce(cited, F.lit("case")), F.col("at"))
    return points.select("checkpoint_id", t.alias("t")).select("checkpoint_id", _us(F.col("t.time")).alias("at_us"), F.col("t.basis").alias("basis"))


@query("""
SELECT image_row_id, CASE WHEN TRY_CAST(report_time AS TIMESTAMP) IS NOT NULL THEN 'report_time' WHEN TRY_CAST(exam_datetime AS TIMESTAMP) IS NOT NULL THEN 'exam_datetime' END AS field,
  CASE WHEN coalesce(report_time, '') = '' THEN 'MISSING_AVAILABILITY_TIME' WHEN TRY_CAST(report_time AS TIMESTAMP) IS NULL THEN 'INVALID_report_time' ELSE 'report_time' END AS basis FROM imaging_all""")
def time_fields_named(spark, folder):
    named = timerange.first_named({"report_time": F.col("report_time"), "exam_datetime": F.col("exam_datetime")})
    given = timerange.first_given({"report_time": F.col("report_time")})
    return table(spark, folder, "imaging_all").select("image_row_id", named["field"].alias("field"), given["basis"].alias("basis"))


@query("""
SELECT image_row_id, epoch_us(CASE WHEN r >= k + INTERVAL 1 SECOND THEN r WHEN k >= r + INTERVAL 1 SECOND THEN k END) AS us, CASE WHEN k IS NULL OR r IS NULL THEN 'EXTERNAL_RECEIPT_OR_RELEASE_UNKNOWN' WHEN r >= k + INTERVAL 1 SECOND THEN 'hospital_received_time' WHEN k < r + INTERVAL 1 SECOND THEN 'EXTERNAL_RECEIPT_ORDER_UNCERTAIN' ELSE 'own_time' END AS basis
FROM (SELECT image_row_id, TRY_CAST(report_time AS TIMESTAMP) AS k, TRY_CAST(hospital_received_time AS TIMESTAMP) AS r FROM imaging_all)""")
def external_receipt(spark, folder):
    t = timerange.received(timerange.parse_range(F.col("report_time")), timerange.parse_range(F.col("hospital_received_time")))
    return table(spark, folder, "imaging_all").select("image_row_id", t.alias("t")).select("image_row_id", _us(F.col("t.time.start")).alias("us"), F.col("t.basis").alias("basis"))


# ---- spans

_HISTORY = [("现病史：", "\\n(?:主诉|辅助检查|诊疗计划)"), ("主诉：", "\\n")]
_PLAN = "(?:建议|安排)[^\\n。；;]{0,40}(?:切除|引流|化疗)"


def _sql_spans(t: str, pattern: str) -> str:
    """SQL for the spans (s, e, x) of a pattern in a text."""
    hits, gaps = f"regexp_extract_all({t}, '{pattern}')", f"regexp_split_to_array({t}, '{pattern}')"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: struct_pack(s := CAST(coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda h: length(h))), 0) AS BIGINT), e := CAST(list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + list_sum(list_transform({hits}[1:i], lambda h: length(h))) AS BIGINT), x := {hits}[i]))"


def _sql_ranges(t: str) -> str:
    parts = []
    for begin, stop in _HISTORY:
        begin, stop = begin.replace("\\n", "\\n"), stop.replace("\\n", "\\n")
        parts.append(f"list_transform({_sql_spans(t, begin)}, lambda b: struct_pack(s := b.e, e := coalesce(list_filter({_sql_spans(t, stop)}, lambda z: z.s >= b.e)[1].s, length({t}))))")
    return f"({' || '.join(parts)})"


@query(f"""
WITH n AS (SELECT note_id, document_text AS t FROM hewv_fictional_bundle WHERE document_text IS NOT NULL), r AS (SELECT note_id, t, {_sql_ranges('t')} AS r, {_sql_spans('t', _PLAN)} AS p FROM n)
SELECT note_id, len(r) AS sections, len(p) AS plans, len(list_filter(p, lambda z: len(list_filter(r, lambda q: z.s >= q.s AND z.s < q.e)) = 0)) AS current_plans, list_filter(p, lambda z: len(list_filter(r, lambda q: z.s >= q.s AND z.s < q.e)) = 0)[1].s AS first_at FROM r""")
def plans_outside_history(spark, folder):
    notes = table(spark, folder, "hewv_fictional_bundle").where("document_text IS NOT NULL").select("note_id", F.col("document_text").alias("t"))
    found = notes.select("note_id", spans.ranges(F.col("t"), _HISTORY).alias("r"), spans.spans(F.col("t"), _PLAN).alias("p")).withColumn("current", spans.outside(F.col("p"), F.col("r")))
    return found.select("note_id", F.size("r").cast("bigint").alias("sections"), F.size("p").cast("bigint").alias("plans"), F.size("current").cast("bigint").alias("current_plans"), F.try_element_at("current", F.lit(1))["start"].cast("bigint").alias("first_at"))


@query(f"""
WITH n AS (SELECT note_id, document_text AS t FROM hewv_fictional_bundle WHERE document_text IS NOT NULL), r AS (SELECT note_id, t, {_sql_ranges('t')} AS r, {_sql_spans('t', '诊疗计划：')} || {_sql_spans('t', _PLAN)} AS p FROM n),
o AS (SELECT note_id, t, list_transform(list_filter(p, lambda z: len(list_filter(r, lambda q: z.s >= q.s AND z.s < q.e)) = 0), lambda z: length(regexp_extract(substring(t, 1, z.e - 1), '(?s)^(.*[\\n。；])', 1))) AS cuts FROM r)
SELECT note_id, length(regexp_replace(substring(t, 1, least(coalesce(list_min(cuts), length(t)), length(t))), '\\s+$', '')) AS safe FROM o""")
def safe_note_end(spark, folder):
    t = F.col("document_text")
    notes = table(spark, folder, "hewv_fictional_bundle").where(t.isNotNull())
    return notes.select("note_id", spans.safe_end(t, ["诊疗计划：", _PLAN], spans.ranges(t, _HISTORY)).cast("bigint").alias("safe"))


# ---- text rules


@query("""
WITH m AS (SELECT doc_id, text, regexp_split_to_array(text, '转移|扩张') AS g, regexp_extract_all(text, '转移|扩张') AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(range(1, len(h) + 1), lambda i: NOT regexp_matches(right(array_to_string(list_transform(range(1, i + 1), lambda j: g[j] || CASE WHEN j < i THEN h[j] ELSE '' END), ''), 24), '未见|无|否认'))) > 0 AS affirmed FROM m""")
def negation_prefix_window(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", text.affirmed_within(F.col("text"), "转移|扩张", "未见|无|否认", 24).alias("affirmed"))


@query("""
WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[。；;！!？?\\n]+'), lambda c: regexp_matches(c, '占位|肿块|恶性')) AS c FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(c, lambda x: NOT regexp_matches(x, '考虑|可能|不除外|疑'))) > 0 THEN 'strong' WHEN len(c) > 0 THEN 'uncertain' ELSE 'none' END AS certainty FROM c""")
def clause_certainty(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.certainty(F.col("text"), "占位|肿块|恶性", "考虑|可能|不除外|疑").alias("certainty"))


@query("""
WITH m AS (SELECT doc_id, text, regexp_split_to_array(text, '建议|安排') AS g, regexp_extract_all(text, '建议|安排') AS h FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, list_transform(range(1, len(h) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT)) AS pos, h FROM m)
SELECT doc_id, left(array_to_string(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1]), ' … '), 200) AS snippets FROM (
  SELECT doc_id, list_transform(range(1, len(h) + 1), lambda i: substring(text, greatest(pos[i] - 10, 0) + 1, pos[i] + length(h[i]) + 15 - greatest(pos[i] - 10, 0))) AS x FROM p)""")
def snippets_joined(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", text.snippets(F.col("text"), "建议|安排", 10, 15, " … ", 200).alias("snippets"))


@query("""
WITH m AS (SELECT doc_id, [CAST(x AS DOUBLE) * 10 FOR x IN regexp_extract_all(coalesce(text, ''), '([0-9]+(?:\\.[0-9]+)?)(?:×[0-9]+(?:\\.[0-9]+)?)*\\s?cm', 1)] || [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(coalesce(text, ''), '([0-9]+(?:\\.[0-9]+)?)(?:×[0-9]+(?:\\.[0-9]+)?)*\\s?mm', 1)]
  || [CAST(x AS DOUBLE) * 10 FOR x IN regexp_extract_all(coalesce(text, ''), '×([0-9]+(?:\\.[0-9]+)?)\\s?cm', 1)] || [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(coalesce(text, ''), '×([0-9]+(?:\\.[0-9]+)?)\\s?mm', 1)] AS x FROM documents)
SELECT doc_id, CAST(round(list_max(x) * 10) AS BIGINT) AS tenths_mm FROM m""")
def lesion_size(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(text.size_mm(F.coalesce("text", F.lit(""))) * 10).cast("bigint").alias("tenths_mm"))


@query("""
SELECT lab_id, coalesce(CASE WHEN lab_id % 5 = 0 THEN CAST(lab_id AS DOUBLE) END, TRY_CAST(nullif(regexp_extract(result_raw, '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE)) AS number FROM four_stage""")
def number_with_preference(spark, folder):
    labs = table(spark, folder, "four_stage")
    numeric = F.when(F.col("lab_id") % 5 == 0, F.col("lab_id").cast("double")).when(F.col("lab_id") % 5 == 1, F.lit(float("nan")))
    return labs.select("lab_id", text.number_of(numeric, F.col("result_raw")).alias("number"))


@query("""
SELECT note_id, document_title || '@' || create_time || ':' || left(coalesce(document_text, ''), 20) AS citation,
  coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(document_text, '[。；;！!？?\\n]+'), lambda c: trim(c, ' ')), lambda c: c <> '' AND NOT regexp_matches(c, '[0-9]')), '。'), ''), nullif(left(regexp_extract(document_text, '^[^0-9]*'), 30), '')) AS redacted FROM hewv_fictional_bundle""")
def citations_and_redaction(spark, folder):
    t = F.col("document_text")
    return table(spark, folder, "hewv_fictional_bundle").select("note_id", text.citation(F.col("document_title"), F.col("create_time"), F.left(F.coalesce(t, F.lit("")), F.lit(20))).alias("citation"), text.redacted(t, "[0-9]", 30).alias("redacted"))


@query("""
SELECT note_id, coalesce(contains(document_text, document_title) OR contains(document_text, '计划') OR contains(document_text, '择期'), false) AS leaks FROM hewv_fictional_bundle""")
def leak_guard_markers(spark, folder):
    markers = F.array(F.col("document_title"), F.lit("计划"), F.lit("择期"))
    return table(spark, folder, "hewv_fictional_bundle").select("note_id", text.holds_any(F.col("document_text"), markers).alias("leaks"))


@query("""
SELECT doc_id FROM documents WHERE regexp_matches(text, '胰') AND regexp_matches(text, '转移|扩张') ORDER BY 1""")
def topic_gate(spark, folder):
    return table(spark, folder, "documents").where(text.all_of(F.col("text"), ["胰", "转移|扩张"])).select("doc_id")


@query("""
SELECT doc_id, nullif(nullif(nullif(trim(regexp_replace(document_title, '\\s+', ' ', 'g')), ''), 'nan'), '无') AS title FROM documents""")
def null_words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.without_null_words(F.col("document_title"), ("nan", "无")).alias("title"))


# ---- the packet flow


def _sources(spark, folder) -> DataFrame:
    """The four arrays of a bundle as one row type: notes, images, laboratory and pathology records of each patient."""
    notes, images, records = (table(spark, folder, n) for n in ("hewv_fictional_bundle", "imaging_all", "fictional_raw_records"))
    empty = F.lit(None).cast("string")
    document = timerange.document_time(F.col("document_text"))
    report = timerange.first_given({"report_time": F.col("report_time")})
    known = timerange.first_given({"available_time": F.col("available_time")})
    parts = [
        notes.select("patient_uid", F.lit("document").alias("kind"), F.lit("DOC").alias("prefix"), F.col("note_id").alias("k"), F.col("document_title").alias("title"), F.col("document_text").alias("body"), document["time"].alias("time"), F.lit("DOCUMENT_BODY_COMPLETION").alias("basis"), document["issue"].alias("issue")),
        images.select("patient_uid", F.lit("imaging"), F.lit("IMG"), F.col("image_row_id"), F.coalesce("exam_method", F.lit("未命名影像")), F.col("report_deidentified"), report["time"], report["basis"], F.when(report["basis"] == "MISSING_AVAILABILITY_TIME", "IMAGING_RELEASE_TIME_UNKNOWN")),
        *[
            records.where(F.col("source_type") == kind).select("patient_uid", F.lit(kind), F.lit(prefix), F.col("rec_id"), F.coalesce("report_type", F.lit(title)), F.col("text"), known["time"], known["basis"], empty)
            for kind, prefix, title in (("laboratory", "LAB", "未命名检验"), ("pathology", "PATH", "病理报告"))
        ],
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return packets.numbered(out.where("patient_uid IS NOT NULL"), "patient_uid", "prefix", "k").withColumnRenamed("patient_uid", "case_id").withColumn("version_issue", empty).withColumn("origin", F.lit("hospital"))


def _checkpoints(spark, folder) -> DataFrame:
    points = table(spark, folder, "checkpoints")
    at = timerange.as_range(F.col("decision_time").cast("timestamp_ntz"), "second")
    return points.select(F.col("patient_uid").alias("case_id"), F.col("checkpoint_id").alias("stage"), at.alias("at"), F.lit("after_records").alias("position"), F.array().cast("array<string>").alias("anchors"))


_SOURCES = f"""
d AS (SELECT note_id, patient_uid, document_title, document_text, {_TIME_AND_ISSUE} FROM ({_DOCUMENT_TIME})),
a AS (SELECT patient_uid, 'document' AS kind, 'DOC' AS prefix, note_id AS k, document_title AS title, document_text AS body, s, p, 'DOCUMENT_BODY_COMPLETION' AS basis, issue FROM d
  UNION ALL SELECT patient_uid, 'imaging', 'IMG', image_row_id, coalesce(exam_method, '未命名影像'), report_deidentified, TRY_CAST(report_time AS TIMESTAMP), 'second', CASE WHEN coalesce(report_time, '') = '' THEN 'MISSING_AVAILABILITY_TIME' WHEN TRY_CAST(report_time AS TIMESTAMP) IS NULL THEN 'INVALID_report_time' ELSE 'report_time' END, CASE WHEN coalesce(report_time, '') = '' THEN 'IMAGING_RELEASE_TIME_UNKNOWN' END FROM imaging_all
  UNION ALL SELECT patient_uid, source_type, CASE source_type WHEN 'laboratory' THEN 'LAB' ELSE 'PATH' END, rec_id, coalesce(report_type, CASE source_type WHEN 'laboratory' THEN '未命名检验' ELSE '病理报告' END), text, TRY_CAST(available_time AS TIMESTAMP), 'second', CASE WHEN coalesce(available_time, '') = '' THEN 'MISSING_AVAILABILITY_TIME' ELSE 'available_time' END, NULL FROM fictional_raw_records WHERE source_type IN ('laboratory', 'pathology')),
s AS (SELECT *, prefix || lpad(CAST(row_number() OVER (PARTITION BY patient_uid, prefix ORDER BY k) AS VARCHAR), 4, '0') AS source_id FROM a WHERE patient_uid IS NOT NULL),
x AS (SELECT c.checkpoint_id AS stage, c.patient_uid AS case_id, s.*, CASE WHEN s.source_id IS NULL THEN NULL WHEN issue IS NOT NULL OR s.s IS NULL THEN coalesce(issue, basis) WHEN NOT coalesce(CASE s.p WHEN 'second' THEN s.s WHEN 'minute' THEN s.s + INTERVAL 59 SECOND ELSE s.s + INTERVAL 86399 SECOND END < date_trunc('second', c.decision_time), false) THEN 'NOT_AVAILABLE_BY_CHECKPOINT' WHEN coalesce(body, '') = '' THEN 'SOURCE_TEXT_MISSING' END AS reason,
  s.source_id IS NOT NULL AND (issue IS NOT NULL OR s.s IS NULL) AS unknown FROM checkpoints c LEFT JOIN s ON c.patient_uid = s.patient_uid),
y AS (SELECT *, CASE WHEN source_id IS NULL THEN NULL WHEN reason IS NULL THEN 'included' WHEN unknown OR reason = 'SOURCE_TEXT_MISSING' THEN 'unresolved' ELSE 'excluded' END AS disposition FROM x)"""


@query(f"WITH {_SOURCES} SELECT case_id, stage, source_id, reason, disposition FROM y")
def packet_source_decisions(spark, folder):
    return flow.decide(_checkpoints(spark, folder), _sources(spark, folder), flow.whole_record_rules()).select("case_id", "stage", "source_id", "reason", "disposition")


@query(f"""
WITH {_SOURCES} SELECT case_id, stage, count(*) FILTER (disposition = 'included') AS records,
  coalesce((SELECT string_agg(kind || ':' || n, ';' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM y z WHERE z.stage = y.stage AND z.case_id IS NOT DISTINCT FROM y.case_id AND disposition = 'included' GROUP BY 1)), '') AS kinds,
  coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN disposition = 'unresolved' THEN 'SOURCE_VISIBILITY_UNRESOLVED' WHEN disposition = 'included' AND p <> 'second' THEN 'COARSE_TIME_PRECISION' END) FILTER (disposition = 'unresolved' OR (disposition = 'included' AND p <> 'second')))), ';'), '') AS issues,
  CASE WHEN count(*) FILTER (disposition = 'included') > 0 THEN 'DRAFT_REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS status,
  sha256(coalesce(string_agg('[' || source_id || '] ' || coalesce(title, '') || chr(10) || replace(replace(coalesce(body, ''), '|', '\\|'), chr(10), '<br>'), chr(10) || '---' || chr(10) ORDER BY kind = 'laboratory', s, source_id) FILTER (disposition = 'included'), '')) AS context_sha
FROM y GROUP BY case_id, stage""")
def packet_flow(spark, folder):
    packet = flow.packets(flow.decide(_checkpoints(spark, folder), _sources(spark, folder), flow.whole_record_rules()))
    return packet.select("case_id", "stage", "records", "kinds", F.coalesce("issues", F.lit("")).alias("issues"), "status", "context_sha")


@query(f"WITH {_SOURCES} SELECT patient_uid AS case_id, row_number() OVER (PARTITION BY patient_uid ORDER BY s NULLS LAST, source_id) AS place, source_id, kind, coalesce(issue, CASE WHEN s IS NULL THEN basis END) AS time_issue FROM s")
def packet_timeline(spark, folder):
    return flow.timeline(_sources(spark, folder))


@query("""
SELECT case_id, stage, problem FROM (SELECT patient_uid AS case_id, stage, CASE WHEN lag(stage) OVER w = stage THEN 'STAGE_REPEATED' WHEN decision_time IS NULL THEN 'NO_TIME' WHEN decision_time < last_value(decision_time IGNORE NULLS) OVER (PARTITION BY patient_uid ORDER BY stage, decision_time NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'BEFORE_PREVIOUS' END AS problem
FROM checkpoints WINDOW w AS (PARTITION BY patient_uid ORDER BY stage, decision_time NULLS FIRST)) WHERE problem IS NOT NULL""")
def checkpoint_order_problems(spark, folder):
    at = timerange.as_range(F.col("decision_time").cast("timestamp_ntz"), "second")
    return flow.checkpoint_problems(table(spark, folder, "checkpoints").select(F.col("patient_uid").alias("case_id"), "stage", at.alias("at")))


@query("""
WITH n AS (SELECT note_id, patient_uid, document_title AS title, coalesce(document_text, '') AS body, TRY_CAST(create_time AS TIMESTAMP) AS t, admission_time AS episode FROM hewv_fictional_bundle),
c AS (SELECT checkpoint_id AS stage, patient_uid, decision_time AS b FROM checkpoints),
x AS (SELECT stage, CASE WHEN b IS NULL THEN 'NO_STAGE_BOUNDARY' WHEN regexp_matches(coalesce(title, ''), '术后|术前') THEN 'PLAN_OR_OUTCOME_DOCUMENT' WHEN NOT regexp_matches(coalesce(title, ''), '记录|病程') THEN 'OUTSIDE_NOTE_TEMPLATES' WHEN t IS NULL THEN 'RESULT_TIME_MISSING_OR_INVALID'
  WHEN t < date_trunc('second', b) - INTERVAL 30 DAY THEN 'OUTSIDE_LOOKBACK_WINDOW' WHEN t + INTERVAL 1 SECOND > b THEN 'NOT_FULLY_BEFORE_BOUNDARY' WHEN length(trim(body)) < 30 THEN 'NO_SAFE_NOTE_PREFIX' WHEN regexp_matches(body, '择期手术') THEN 'DECISION_TEXT_REMAINS' ELSE 'OTHER' END AS reason FROM c JOIN n ON c.patient_uid = n.patient_uid)
SELECT stage, CASE WHEN reason = 'OTHER' THEN 'late_or_included' ELSE reason END AS reason, count(*) AS n FROM x GROUP BY 1, 2""")
def lookback_reasons(spark, folder):
    at = timerange.as_range(F.col("decision_time").cast("timestamp_ntz"), "second")
    points = table(spark, folder, "checkpoints").select(F.col("patient_uid").alias("case_id"), F.col("checkpoint_id").alias("stage"), at.alias("at"), F.lit(None).cast("string").alias("episode"), F.array().cast("array<string>").alias("anchors"))
    empty = F.lit(None).cast("string")
    notes = table(spark, folder, "hewv_fictional_bundle").select(F.col("patient_uid").alias("case_id"), F.col("note_id").cast("string").alias("source_id"), F.lit("document").alias("kind"), F.col("document_title").alias("title"), F.col("document_text").alias("body"), timerange.as_range(F.expr("try_cast(create_time AS TIMESTAMP_NTZ)"), "second").alias("time"), F.lit("create_time").alias("basis"), empty.alias("issue"), F.col("admission_time").alias("episode"))
    decided = flow.decide(points, notes, flow.lookback_rules(30, "记录|病程", "术后|术前", "择期手术")).where("source_id IS NOT NULL")
    reason = F.when(F.col("reason").isNull() | (F.col("reason") == "NOTE_MENTIONS_LATER_DATE"), "late_or_included").otherwise(F.col("reason"))
    return decided.groupBy("stage", reason.alias("reason")).agg(F.count("*").alias("n"))
