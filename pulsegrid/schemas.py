"""Declared schemas, closed domains and ranks.  Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Closed domains.
USER_ROLES = ("medico", "paciente", "admin", "investigador", "asistente")
AUDIT_EVENTS = ("LOGIN_OK", "LOGIN_FAILED", "LOGOUT", "REGISTER", "PASSWORD_RESET_REQUESTED")
SEXES = ("M", "F", "X")
PATIENT_STATUSES = ("active", "completed", "paused", "none")
DEVICE_STATUSES = ("available", "assigned", "maintenance", "retired")
STUDY_STATUSES = ("in_progress", "completed", "cancelled", "scheduled")
PROCESSING_STATUSES = ("PENDING", "PROCESSING", "DONE", "FAILED")
EVENT_TYPES = ("TACHYCARDIA", "BRADYCARDIA", "AFIB", "PVC", "PAUSE", "NOISE", "OTHER")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SIGNAL_QUALITIES = ("good", "fair", "poor", "none")
TRENDS = ("up", "down", "flat")
WATCHDOG_REASONS = ("offline", "low_battery", "poor_signal")


def severity_rank(severity: Column) -> Column:
    """LOW=1 ... CRITICAL=4: severities order as declared, not by their letters; null for anything else."""
    out = F.when(severity == SEVERITIES[0], F.lit(1))
    for rank, name in enumerate(SEVERITIES[1:], start=2):
        out = out.when(severity == name, F.lit(rank))
    return out


def in_domain(value: Column, domain: tuple[str, ...]) -> Column:
    return value.isin(*domain)


def _table(own: list[tuple[str, T.DataType, bool]]) -> T.StructType:
    head = [T.StructField("id", T.StringType(), False), T.StructField("created_at", T.TimestampType(), False), T.StructField("updated_at", T.TimestampType(), False), T.StructField("deleted_at", T.TimestampType(), True)]
    return T.StructType(head + [T.StructField(n, k, null) for n, k, null in own])


_S, _TS, _I, _L, _D, _B = T.StringType(), T.TimestampType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

USER = _table([("auth0_id", _S, True), ("email", _S, False), ("full_name", _S, False), ("role", _S, False), ("is_active", _B, False), ("last_logout_at", _TS, True)])
AUDIT_EVENT = _table([("user_id", _S, True), ("event_type", _S, False), ("ip_address", _S, True), ("metadata", _S, True)])
DOCTOR = _table([("user_id", _S, False), ("specialty", _S, True), ("license_number", _S, True)])
PATIENT = _table([("doctor_id", _S, False), ("user_id", _S, True), ("medical_record_num", _S, False), ("first_name", _S, False), ("last_name", _S, False), ("date_of_birth", T.DateType(), True), ("dni", _S, True), ("sex", _S, False), ("study_status", _S, False), ("last_data_received_at", _TS, True), ("phone", _S, True), ("email", _S, True), ("notes", _S, True)])
DEVICE = _table([("serial_number", _S, False), ("model", _S, False), ("patient_id", _S, True), ("api_key_hash", _S, False), ("firmware_version", _S, True), ("last_seen_at", _TS, True), ("last_battery_pct", _I, True), ("last_sd_free_mb", _I, True), ("status", _S, False)])
ECG_BATCH = _table([("device_id", _S, False), ("received_at", _TS, False), ("batch_timestamp", _L, False), ("duration_seconds", _I, False), ("sample_rate", _I, False), ("num_channels", _I, False), ("num_samples", _I, False), ("compression_type", _S, False), ("s3_key", _S, False), ("file_size_bytes", _L, True), ("processing_status", _S, False), ("processing_error", _S, True), ("firmware_version", _S, True)])
STUDY = _table([("patient_id", _S, False), ("device_id", _S, False), ("started_at", _TS, False), ("ended_at", _TS, True), ("status", _S, False), ("samples_count", _I, False), ("events_count", _I, False), ("ecg_s3_key", _S, True), ("sample_rate", _I, False), ("duration_ms", _L, True)])
ECG_EVENT = _table([("batch_id", _S, False), ("event_type", _S, False), ("severity", _S, False), ("timestamp_in_recording", _D, False), ("duration_seconds", _D, True), ("confidence_score", _D, True), ("metadata", _S, True)])
ALERT = _table([("patient_id", _S, False), ("event_id", _S, False), ("severity", _S, False), ("message", _S, False), ("seen_at", _TS, True), ("acknowledged_at", _TS, True), ("acknowledged_by", _S, True)])
TABLES = {"user": USER, "audit_event": AUDIT_EVENT, "doctor": DOCTOR, "patient": PATIENT, "device": DEVICE, "ecg_batch": ECG_BATCH, "study": STUDY, "ecg_event": ECG_EVENT, "alert": ALERT}

#: One chunk of a sampled signal; at most 64 K samples a row.
SIGNAL = T.StructType([T.StructField("study_id", _S, False), T.StructField("sample_rate", _I, False), T.StructField("start_ts_ms", _L, False), T.StructField("chunk_index", _I, False), T.StructField("samples", T.ArrayType(T.FloatType(), False), False)])

_BATCH = T.StructType([T.StructField("timestamp", _L), T.StructField("duration_sec", _I), T.StructField("sample_rate", _I), T.StructField("num_samples", _I), T.StructField("compression", _S), T.StructField("data_b64", _S)])
#: Upload payloads: one with its batches nested, one flat.
UPLOAD_NESTED = T.StructType([T.StructField("device_id", _S), T.StructField("firmware_version", _S), T.StructField("battery_pct", _I), T.StructField("sd_free_mb", _I), T.StructField("batch", T.ArrayType(_BATCH)), T.StructField("chunk_index", _I), T.StructField("total_chunks", _I)])
UPLOAD_FLAT = T.StructType([T.StructField("device_id", _S), T.StructField("batch_timestamp", _L), T.StructField("duration_seconds", _I), T.StructField("sample_rate", _I), T.StructField("num_channels", _I), T.StructField("num_samples", _I), T.StructField("compression_type", _S), T.StructField("battery_pct", _I), T.StructField("sd_free_mb", _I), T.StructField("firmware_version", _S), T.StructField("data", _S), T.StructField("chunk_index", _I), T.StructField("total_chunks", _I)])
