"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cuts, entries, leaks, personal, tokens, versions
from tidemark.sources.tables import table


def _listed(df: DataFrame, code: str, names: tuple[str, ...]) -> DataFrame:
    aliases = F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>"))
    return df.select(F.col(code).alias("code"), F.explode(F.concat(F.array(*names), aliases)).alias("form")).where("form IS NOT NULL")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entry meant by every free item name and report type."""
    labs, records = table(spark, folder, "four_stage"), table(spark, folder, "fictional_raw_records")
    items = _listed(table(spark, folder, "lab_items"), "item_code", ("item_name", "name_en"))
    types = _listed(table(spark, folder, "report_types"), "type_code", ("type_code", "type_name", "name_en"))
    parts = [
        entries.canonical_rows(df.select(F.col(key).alias("row_id"), F.col(field).alias("entry")), reference).select(F.lit(field).alias("field_name"), "row_id", F.col("code").alias("ref_code"))
        for df, key, field, reference in ((labs, "lab_id", "item_name", items), (records, "rec_id", "report_type", types))
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of notes that are versions of one another."""
    members, pairs = versions.close_versions(table(spark, folder, "hewv_fictional_bundle"), "note_id", "document_text")
    return versions.expand(members, pairs).select(F.col("id_a").alias("note_id_a"), F.col("id_b").alias("note_id_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every note of at least 40 characters with its class of identical texts and the number of other classes close to it."""
    members, pairs = versions.close_versions(table(spark, folder, "hewv_fictional_bundle"), "note_id", "document_text")
    return versions.linked(members, pairs).select(F.col("id").alias("note_id"), "class_id", "links")


_TEXTS = (("fictional_raw_records", "rec_id", "text"), ("hewv_fictional_bundle", "note_id", "document_text"))


def _personal(spark: SparkSession, folder: str, use: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    frames = [(name, table(spark, folder, name).select(F.col(key).alias("row_id"), F.col(text).alias("text"))) for name, key, text in _TEXTS]
    lexicon = personal.learn_lexicon(frames[0][1].unionByName(frames[1][1]))
    parts = [use(df, lexicon).select(F.lit(name).alias("table_name"), "*") for name, df in frames]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct string of personal information in every text."""
    return _personal(spark, folder, personal.find_personal)


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders in the place of personal information."""
    return _personal(spark, folder, personal.sanitise)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text", tokens.vocabulary_path()).select(F.col("id").alias("doc_id"), "ids")


def p7_ids_split(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document with texts of more than 512 characters joined up the tree, and whether they are those of ``p7_ids``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    plain, split = (tokens.encode_corpus(docs, "doc_id", "text", tokens.vocabulary_path(), n) for n in (tokens.SPLIT_CHARS, 512))
    return split.join(plain.select("id", F.col("ids").alias("plain")), "id").select(F.col("id").alias("doc_id"), "ids", (F.col("ids") == F.col("plain")).cast("bigint").alias("equal"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of each leaked item in each document, as places in the original text."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of test items."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return cuts.score(docs, cuts.fit(docs))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that stop before their last sentence or entry is complete."""
    return _scored(spark, folder).where(F.col("chance") >= cuts.CUT_AT).select("doc_id").distinct()


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return cuts.by_source(_scored(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p2_found, p3_found, p3_classes, p6_found, p6_clean, p7_ids, p7_ids_split, p8_found, p8_spans, p9_found, p9_sources)}


# Brute force in another engine: every pair of notes that share a piece.
_NOTE_PIECES = """
WITH d AS (SELECT min(note_id) AS class_id, document_text AS t FROM hewv_fictional_bundle WHERE length(document_text) >= 40 GROUP BY 2),
p AS (SELECT DISTINCT class_id, substr(t, i, 4) AS piece FROM (SELECT class_id, t, unnest(range(1, length(t) - 2)) AS i FROM d)),
n AS (SELECT class_id, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS m FROM p a JOIN p b ON a.piece = b.piece AND a.class_id < b.class_id GROUP BY 1, 2),
c AS (SELECT a, b FROM s JOIN n x ON a = x.class_id JOIN n y ON b = y.class_id WHERE m * 10 >= 7 * greatest(x.n, y.n)),
m AS (SELECT note_id, class_id FROM hewv_fictional_bundle JOIN d ON document_text = t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _NOTE_PIECES + """
SELECT least(x.note_id, y.note_id) AS note_id_a, greatest(x.note_id, y.note_id) AS note_id_b FROM c JOIN m x ON c.a = x.class_id JOIN m y ON c.b = y.class_id
UNION ALL SELECT x.note_id, y.note_id FROM m x JOIN m y ON x.class_id = y.class_id AND x.note_id < y.note_id""",
        "p3_classes": _NOTE_PIECES + """
SELECT note_id, m.class_id, coalesce(l.links, 0) AS links FROM m LEFT JOIN (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM c UNION ALL SELECT b FROM c) GROUP BY 1) l ON m.class_id = l.class_id""",
    }
