"""Device queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clinical, clock
from pulsegrid.operators import joins, paging
from pulsegrid.operators.predicates import Page, device_search, live, members


def device_out(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("serial_number").alias("serial"), "model", "firmware_version", "status", F.col("patient_id").alias("assigned_patient_id"), "last_seen_at", "created_at")


def listing(devices: DataFrame, q: str | None = None, statuses: list[str] | None = None, page: Page = Page()) -> tuple[DataFrame, DataFrame]:
    """One page of all devices, newest first, and its total; devices are not a doctor's own."""
    rows = members(device_search(live(devices), q), "status", statuses)
    items, total = paging.page_with_total(rows, paging.newest("created_at"), page)
    return device_out(items), total


def one(devices: DataFrame, device_id: str) -> DataFrame:
    return device_out(live(devices).filter(F.col("id") == device_id))


def health_columns(next_upload: Column) -> list[Column]:
    return [
        F.col("id").alias("device_id"), F.col("serial_number").alias("serial"), "model", F.coalesce(F.nullif("firmware_version", F.lit("")), F.lit("unknown")).alias("firmware_version"), F.coalesce("last_battery_pct", F.lit(0)).alias("battery_percent"),
        F.lit(0).alias("signal_dbm"), F.lit("good").alias("signal_quality"), F.col("last_seen_at").alias("last_ping_at"), next_upload.alias("next_scheduled_upload_at"), F.lit(0).alias("uploads_today"),
        clinical.storage_used(F.col("last_sd_free_mb")).alias("storage_used_mb"), F.lit(clinical.STORAGE_TOTAL_MB).alias("storage_total_mb"),
    ]


def health(devices: DataFrame, device_id: str | None = None) -> DataFrame:
    """Health of devices that were ever seen; here the next upload is due an hour after the last."""
    rows = live(devices).filter(F.col("last_seen_at").isNotNull())
    rows = rows if device_id is None else rows.filter(F.col("id") == device_id)
    return rows.select(*health_columns(clock.plus_one_hour(F.col("last_seen_at"))))


def available(devices: DataFrame, limit: int = 100) -> DataFrame:
    return listing(devices, None, ["available"], Page(limit=limit))[0]


def inventory(devices: DataFrame, patients: DataFrame) -> DataFrame:
    """Every live device with the patient it is with, if any."""
    p = live(patients).select(F.col("id").alias("_p"), F.concat_ws(" ", "first_name", "last_name").alias("patient_name"), "doctor_id")
    return live(devices).join(p, F.col("patient_id") == F.col("_p"), "left").drop("_p")


def pickers(patients: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(available devices, patients without a device) to assign."""
    return available(devices), joins.without_device(patients, devices)
