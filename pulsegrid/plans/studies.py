"""Study queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clock, text
from pulsegrid.operators import joins, paging
from pulsegrid.operators.predicates import Page, live, members, substring_search


def study_out(rows: DataFrame) -> DataFrame:
    ms = clock.duration_ms(F.col("duration_ms"), F.col("started_at"), F.col("ended_at"))
    return rows.select("id", "patient_id", "started_at", "ended_at", clock.duration_hours(ms, F.col("ended_at")).alias("duration_hours"), "status", "device_id", "samples_count", "events_count")


def of_patient(studies: DataFrame, patients: DataFrame, doctor_id: str, patient_id: str) -> tuple[DataFrame, DataFrame]:
    """All studies of one live patient of a doctor, newest first, and their number; nothing if there is no such patient."""
    own = patients.filter((F.col("doctor_id") == doctor_id) & (F.col("id") == patient_id))
    rows = joins.of_existing(live(studies), own)
    return study_out(rows).orderBy(*paging.newest("started_at")), rows.agg(F.count("*").alias("total"))


def detail(studies: DataFrame, patients: DataFrame, devices: DataFrame, doctor_id: str | None = None) -> DataFrame:
    rows = joins.study_detail(studies, patients, devices, doctor_id)
    ms = clock.duration_ms(F.col("duration_ms"), F.col("started_at"), F.col("ended_at"))
    return rows.select("id", "patient_id", text.full_name(F.col("first_name"), F.col("last_name")).alias("patient_name"), "started_at", "ended_at", ms.alias("duration_ms"), F.col("serial_number").alias("device_serial"), "status")


def signal_metadata(studies: DataFrame, patients: DataFrame, devices: DataFrame, doctor_id: str | None = None) -> DataFrame:
    """Where a study's signal lies and how to read it; studies without a key have none."""
    rows = joins.study_detail(studies, patients, devices, doctor_id).filter(F.col("ecg_s3_key").isNotNull())
    ms = clock.duration_ms(F.col("duration_ms"), F.col("started_at"), F.col("ended_at"))
    return rows.select("id", F.col("ecg_s3_key").alias("path"), "sample_rate", clock.epoch_ms(F.col("started_at")).alias("start_timestamp"), ms.alias("duration_ms"), F.col("samples_count").alias("sample_count"))


def search(studies: DataFrame, patients: DataFrame, devices: DataFrame, as_of: datetime | str, q: str | None = None, statuses: list[str] | None = None, page: Page = Page()) -> tuple[DataFrame, DataFrame]:
    """Studies by patient name, serial or id; open ones last until ``as_of`` here."""
    rows = joins.with_serial(joins.flatten(patients, studies), devices)
    end = F.coalesce("ended_at", clock.at(as_of))
    rows = rows.select("id", "patient_id", "patient_name", "started_at", "ended_at", F.greatest(F.lit(0), clock.epoch_ms(end) - clock.epoch_ms(F.col("started_at"))).cast("bigint").alias("duration_ms"), "device_serial", "status")
    rows = members(substring_search(rows, q, "patient_name", "device_serial", "id"), "status", statuses)
    return paging.page_with_total(rows, paging.newest("started_at"), page)
