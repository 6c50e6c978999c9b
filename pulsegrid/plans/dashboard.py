"""The doctor's dashboard."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clock, text
from pulsegrid.operators import joins, paging, sets
from pulsegrid.operators.predicates import live
from pulsegrid.streaming.status import watchdog as watch

TOP = 6


def monitored(patients: DataFrame) -> DataFrame:
    return live(patients).filter(F.col("study_status").isin("active", "paused"))


def attention(patients: DataFrame, devices: DataFrame, top: int = TOP) -> DataFrame:
    """Monitored patients by last data, newest first, never seen last."""
    first = monitored(patients).orderBy(F.col("last_data_received_at").desc_nulls_last(), F.col("id").asc()).limit(top)
    rows = joins.with_serial(joins.with_assigned_device(first, devices), devices, "assigned_device_id")
    return rows.select("id", text.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"), "study_status", "last_data_received_at", "device_serial")


def running(patients: DataFrame, studies: DataFrame, devices: DataFrame, as_of: datetime | str, top: int = TOP) -> DataFrame:
    """Monitored patients' running studies, latest first."""
    rows = joins.first_running_study(monitored(patients), studies).orderBy(F.col("study_started_at").desc(), F.col("study_id").asc()).limit(top)
    rows = joins.with_serial(rows, devices, "study_device_id")
    return rows.select(F.col("study_id").alias("id"), text.full_name(F.col("first_name"), F.col("last_name")).alias("patient_name"), F.col("study_started_at").alias("started_at"), clock.running_ms(F.col("study_started_at"), as_of).alias("duration_ms"), F.coalesce("device_serial", "study_device_id").alias("device_serial"))


def watchdog(devices: DataFrame, as_of: datetime | str, top: int = TOP) -> DataFrame:
    rows = watch(devices, as_of).orderBy("id").limit(top)
    return rows.select(F.col("id").alias("device_id"), F.col("serial_number").alias("serial"), "status", F.col("last_battery_pct").alias("battery_percent"), "last_seen_at", "reason")


def alerts(events: DataFrame, devices: DataFrame, patients: DataFrame, studies: DataFrame, as_of: datetime | str, top: int = 4) -> DataFrame:
    """The newest rhythm alerts of monitored patients, and one alert per silent device (UNION ALL).

    events (id, patient_id, event_type, severity, detected_at).
    """
    p = joins.first_running_study(monitored(patients), studies, "left").select(F.col("id").alias("_p"), text.full_name(F.col("first_name"), F.col("last_name")).alias("patient_name"), "study_id")
    rhythm = events.join(p, F.col("patient_id") == F.col("_p")).orderBy(F.col("detected_at").desc(), F.col("id").asc()).limit(top)
    rhythm = rhythm.select("id", "patient_id", "patient_name", F.lower("event_type").alias("kind"), F.lower("severity").alias("severity"), "detected_at", "study_id")
    silent = watch(devices, as_of).filter(F.col("reason") == "offline").join(p, F.col("patient_id") == F.col("_p"))
    silent = silent.select(F.concat(F.lit("offline_"), "id").alias("id"), "patient_id", "patient_name", F.lit("device_offline").alias("kind"), F.lit("medium").alias("severity"), F.col("last_seen_at").alias("detected_at"), F.lit(None).cast("string").alias("study_id"))
    return sets.bag(rhythm, silent)


def pending_alerts(alerts_df: DataFrame, patients: DataFrame, doctor_id: str | None = None, *, severities: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Alerts nobody has acknowledged, worst first, then newest; of one doctor, or of all."""
    p = live(patients).select(F.col("id").alias("_p"), "doctor_id")
    rows = alerts_df.filter(F.col("acknowledged_at").isNull()).join(p, F.col("patient_id") == F.col("_p")).drop("_p")
    if doctor_id is not None:
        rows = rows.filter(F.col("doctor_id") == doctor_id)
    if severities:
        rows = rows.filter(F.col("severity").isin(*severities))
    return paging.page(rows, paging.by_severity(rows), limit, offset)
