"""Batches with their events, audit trails and other specified queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import paging
from pulsegrid.operators.predicates import Page, between, members


def batch_with_events(batches: DataFrame, events: DataFrame) -> DataFrame:
    """Each batch with its events as an array, ordered by time."""
    e = events.groupBy(F.col("batch_id").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("timestamp_in_recording", F.col("id").alias("event_id"), "event_type", "severity"))).alias("events"))
    rows = batches.join(e, F.col("id") == F.col("_b"), "left").drop("_b")
    return rows.withColumn("events", F.coalesce("events", F.array().cast(rows.schema["events"].dataType)))


def events_page(events: DataFrame, batch_id: str, page: Page = Page()) -> DataFrame:
    return paging.page(events.filter(F.col("batch_id") == batch_id), [F.col("timestamp_in_recording").asc(), F.col("id").asc()], page.limit, page.offset)


def audit_trail(audit: DataFrame, *, user_id: str | None = None, types: list[str] | None = None, start: object = None, end: object = None, page: Page = Page()) -> DataFrame:
    """Who did what when, newest first."""
    rows = members(audit, "event_type", types)
    rows = rows if user_id is None else rows.filter(F.col("user_id") == user_id)
    return paging.page(between(rows, "created_at", start, end), paging.newest("created_at"), page.limit, page.offset)


def doctor_profile(doctors: DataFrame, patients: DataFrame) -> DataFrame:
    """Every doctor with the number of live patients."""
    n = patients.filter(F.col("deleted_at").isNull()).groupBy(F.col("doctor_id").alias("_d")).agg(F.count("*").alias("n"))
    return doctors.join(n, F.col("id") == F.col("_d"), "left").select("id", "specialty", F.coalesce("n", F.lit(0)).alias("patients"))
