"""The queries p1, p4 and p5: the core operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.knowledge import as_known, buckets_for
from tidemark.operators.timestamps import FORMATS, normalise_times
from tidemark.operators.units import common_units
from tidemark.sources.tables import table

TIME_FIELDS = ("exam_datetime", "report_time", "sample_time", "create_time")
CLOCK = "fictional_hub"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Laboratory rows whose number changes on conversion, with 1000 times the converted value."""
    found = common_units(table(spark, folder, "four_stage"), table(spark, folder, "lab_items"), "lab_id", "item_name", "result_raw", "unit_raw")
    return found.where("changed").select(F.col("id").alias("lab_id"), F.round(F.round(F.col("value") * 1000, 6)).cast("bigint").alias("value_milli")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every time value that fixes a date and a time of day, as microseconds since the epoch in UTC."""
    times = normalise_times(table(spark, folder, "fictional_raw_records"), "rec_id", "source_system", TIME_FIELDS, table(spark, folder, "source_systems"))
    return times.where("NOT dated").select("rec_id", F.col("field").alias("field_name"), F.col("us").alias("utc_us"))


def p4_hidden_order(spark: SparkSession, folder: str) -> DataFrame:
    """How the Viterbi pass alone settles day and month: (source_system, open_values, agreed) with every source's order hidden.

    Open values have several interpretations once the order is hidden; agreed are
    those that come out as with the declared order.
    """
    records, sources = table(spark, folder, "fictional_raw_records"), table(spark, folder, "source_systems")
    declared = normalise_times(records, "rec_id", "source_system", TIME_FIELDS, sources)
    hidden = normalise_times(records, "rec_id", "source_system", TIME_FIELDS, sources.withColumn("date_order", F.lit(None).cast("string")))
    day_first = hidden.where(f"fmt IN ({FORMATS.index('dmy')}, {FORMATS.index('mdy')})").select("rec_id", "field", F.col("us").alias("guess"))
    both = declared.select("rec_id", "field", "us").join(day_first, ["rec_id", "field"]).join(records.select("rec_id", "source_system"), "rec_id")
    return both.groupBy("source_system").agg(F.count("*").alias("open_values"), F.count_if(F.col("us") == F.col("guess")).alias("agreed"))


def _micros(clock: str, zone: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', convert_timezone('{zone}', 'UTC', {clock}))")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The record of each source type that stood for the patient, as known, at each checkpoint."""
    records, sources = table(spark, folder, "fictional_raw_records"), table(spark, folder, "source_systems")
    # One value: the zone of the system whose clock the records' own times follow.
    hub = sources.where((F.col("source_system") == CLOCK) & F.col("time_zone").rlike("^[A-Za-z0-9_+/-]+$")).select(F.min("time_zone")).first()[0] or "UTC"
    # The report time counts where no availability is given. A source that declares no order of dates needs its other rows as neighbours.
    declared = sources.where("date_order IS NOT NULL").select("source_system").distinct()
    needed = records.where("report_time IS NOT NULL")
    asked = needed.where("available_time IS NULL").unionByName(needed.where("available_time IS NOT NULL").join(declared, "source_system", "left_anti"))
    reported = normalise_times(asked, "rec_id", "source_system", ["report_time"], sources).select("rec_id", F.col("us").alias("reported"))
    changes = (
        records.select("rec_id", "patient_uid", "source_type", "clinical_time", "available_time")
        .where("clinical_time IS NOT NULL AND patient_uid IS NOT NULL")
        .join(reported, "rec_id", "left")
        .select(
            F.col("rec_id").alias("id"), F.col("patient_uid").alias("entity"), F.coalesce("source_type", F.lit("")).alias("kind"),
            _micros("try_cast(trim(clinical_time) AS TIMESTAMP_NTZ)", hub).alias("happened"),
            F.when(F.col("available_time").isNull(), F.col("reported")).otherwise(_micros("try_cast(trim(available_time) AS TIMESTAMP_NTZ)", hub)).alias("known"),
        )
    )
    events = table(spark, folder, "checkpoints").select(
        F.col("checkpoint_id").alias("event_id"), F.col("patient_uid").alias("entity"), _micros("cast(decision_time AS TIMESTAMP_NTZ)", hub).alias("at")
    )
    # both counts come from the tables' own metadata
    size = records.select("rec_id").count() + events.select("event_id").count()
    found = as_known(events, changes, buckets_for(spark, size))
    return found.select(F.col("event_id").alias("checkpoint_id"), F.col("change_id").alias("rec_id")).distinct()
