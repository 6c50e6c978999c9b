"""Patient queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clinical, clock, text
from pulsegrid.operators import joins, paging
from pulsegrid.operators.predicates import Page, between, live, members, patient_search, tenant, tri_state, window_hours


def patient_out(rows: DataFrame) -> DataFrame:
    """The public columns; a patient without a birth date is an error there, so it is left to ``without_birth_date``."""
    return rows.filter(F.col("date_of_birth").isNotNull()).select(
        "id", text.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"), F.coalesce("dni", F.lit("")).alias("dni"), F.col("date_of_birth").alias("birth_date"), "sex", "assigned_device_id", "study_status",
        "last_data_received_at", F.col("email").alias("contact_email"), F.col("phone").alias("contact_phone"),
    )


def without_birth_date(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("date_of_birth").isNull())


def filtered(patients: DataFrame, doctor_id: str, q: str | None = None, statuses: list[str] | None = None) -> DataFrame:
    return members(patient_search(tenant(live(patients), doctor_id), q), "study_status", statuses)


def listing(patients: DataFrame, devices: DataFrame, doctor_id: str, q: str | None = None, statuses: list[str] | None = None, page: Page = Page()) -> tuple[DataFrame, DataFrame]:
    """One page of a doctor's patients, and its total.  The page is cut before devices are looked up."""
    rows = filtered(patients, doctor_id, q, statuses)
    items, total = paging.page_with_total(rows, paging.patient_order(page.sort, page.order), page)
    return patient_out(joins.with_assigned_device(items, devices)), total


def one(patients: DataFrame, devices: DataFrame, doctor_id: str, patient_id: str) -> DataFrame:
    rows = tenant(live(patients), doctor_id).filter(F.col("id") == patient_id)
    return patient_out(joins.with_assigned_device(rows, devices))


def device_health(patients: DataFrame, devices: DataFrame, doctor_id: str | None = None) -> DataFrame:
    """Each patient's device health; here the next upload is the last one itself."""
    from pulsegrid.plans.devices import health_columns
    from pulsegrid.operators.predicates import assigned_to

    p = live(patients) if doctor_id is None else tenant(live(patients), doctor_id)
    d = assigned_to(devices).filter(F.col("last_seen_at").isNotNull()).withColumn("_p", F.col("patient_id"))
    return d.join(p.select(F.col("id").alias("_pid")), F.col("_p") == F.col("_pid")).select(F.col("_p").alias("patient_id"), *health_columns(F.col("last_seen_at")))


def device_lookup_code(patients: DataFrame, devices: DataFrame, doctor_id: str) -> DataFrame:
    """(patient_id, code): why a patient has no device health; null where it has."""
    rows = joins.with_assigned_device(tenant(patients, doctor_id), devices)
    d = devices.select(F.col("id").alias("_d"), F.col("last_seen_at").alias("_seen"))
    rows = rows.join(d, F.col("assigned_device_id") == F.col("_d"), "left")
    code = F.when(F.col("deleted_at").isNotNull(), "PATIENT_NOT_FOUND").when(F.col("assigned_device_id").isNull(), "DEVICE_NOT_FOUND").when(F.col("_seen").isNull(), "DEVICE_HEALTH_NOT_FOUND")
    return rows.select(F.col("id").alias("patient_id"), code.alias("code"))


def summary(events: DataFrame, batches: DataFrame, beats: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Per patient: mean rate, events and adherence of the last ``hours``, each against the ``hours`` before.

    events (patient_id, at), batches (patient_id, at, duration_seconds), beats (patient_id, at, rr_ms).  Adherence is the
    share of the window that batches cover; nothing specifies it, so that is this library's choice.
    """
    window_hours(hours)
    now = clock.micros(clock.at(as_of))
    back = lambda c: F.floor((now - clock.micros(c) - 1) / F.lit(hours * 3_600_000_000)).cast("int")  # noqa: E731  0: this window, 1: the one before

    def halves(df: DataFrame, value, name: str) -> DataFrame:
        rows = df.withColumn("_w", back(F.col("at"))).filter(F.col("_w").isin(0, 1))
        return rows.groupBy("patient_id").agg(value(0).alias(name), value(1).alias(f"_{name}"))

    rate = lambda w: F.lit(60_000.0) / F.avg(F.when(F.col("_w") == w, F.col("rr_ms")))
    count = lambda w: F.count_if(F.col("_w") == w)
    cover = lambda w: F.least(F.lit(100.0), F.coalesce(F.sum(F.when(F.col("_w") == w, F.col("duration_seconds"))), F.lit(0)) / F.lit(hours * 36.0))
    out = halves(events, count, "events_count").join(halves(batches, cover, "adherence_percent"), "patient_id", "full").join(halves(beats, rate, "average_bpm"), "patient_id", "full")
    columns = [F.col("patient_id"), F.lit(hours).alias("window_hours")]
    for name in ("average_bpm", "events_count", "adherence_percent"):
        delta = F.col(name) - F.col(f"_{name}")
        columns += [F.col(name), delta.alias(f"{name}_delta"), F.when(delta.isNotNull(), clinical.trend(delta)).alias(f"{name}_trend")]
    return out.select(*columns)


def empty_summary(patients: DataFrame, hours: int = 24) -> DataFrame:
    """What the service itself answers today: the window and three nulls."""
    null = F.lit(None).cast("double")
    return live(patients).select(F.col("id").alias("patient_id"), F.lit(window_hours(hours)).alias("window_hours"), null.alias("heart_rate"), null.alias("events_detected"), null.alias("adherence_percent"))


def history(rows: DataFrame, patient_id: str, *, time: str, start: object = None, end: object = None, acknowledged: bool | None = None, page: Page = Page()) -> DataFrame:
    """A patient's batches or alerts, newest first."""
    rows = between(rows.filter(F.col("patient_id") == patient_id), time, start, end)
    if acknowledged is not None:
        rows = tri_state(rows, "acknowledged_at", acknowledged)
    return paging.page(rows, paging.newest(time), page.limit, page.offset)
