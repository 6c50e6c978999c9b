"""The domain over the provided tables: no clinical table is provided, so each is derived by fixed arithmetic.

``DOMAIN_SQL`` derives the same tables in DuckDB's SQL, independently, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.tables import provided

AS_OF = "2024-01-31 00:00:00"
_EVENT = {"error": "PAUSE", "signup": "TACHYCARDIA", "click": "PVC", "purchase": "BRADYCARDIA", "view": "NOISE"}
_AUDIT = {"error": "LOGIN_FAILED", "signup": "REGISTER", "click": "LOGIN_OK", "purchase": "LOGOUT", "view": "PASSWORD_RESET_REQUESTED"}
_STATUS = {"AUTOMOBILE": "active", "BUILDING": "paused", "FURNITURE": "completed", "HOUSEHOLD": "none", "MACHINERY": "active"}


def _case(c: str, values: dict[str, str]) -> Column:
    out: Column | None = None
    for k, v in values.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return out


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _later(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def _id(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


class Domain:
    """The domain tables of one directory, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = lambda name: provided(spark, sf_dir, name)

    @property
    def doctor(self) -> DataFrame:
        n = self._read("nation")
        return n.select(_id("dr_", "n_nationkey").alias("id"), _id("u_", "n_nationkey").alias("user_id"), F.col("n_name").alias("specialty"), F.lit(None).cast("string").alias("license_number"), F.lit(None).cast("timestamp").alias("deleted_at"))

    @property
    def patient(self) -> DataFrame:
        seen = self._read("orders").filter(F.col("o_orderstatus") == "P").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
        c, k = self._read("customer"), F.col("c_custkey")
        created = _later(_ts("2023-01-01"), k * 60)
        return c.join(seen, k == F.col("o_custkey"), "left").select(
            _id("p_", k).alias("id"), created.alias("created_at"), created.alias("updated_at"), F.when(F.col("c_acctbal") < 0, _ts("2024-01-15")).alias("deleted_at"),
            _id("dr_", "c_nationkey").alias("doctor_id"), F.lit(None).cast("string").alias("user_id"), _id("mr_", k).alias("medical_record_num"),
            F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"), F.date_add(F.lit("1940-01-01").cast("date"), (k * 37 % 25000).cast("int")).alias("date_of_birth"),
            F.when(k % 17 != 0, (28_000_000 + k * 137).cast("string")).alias("dni"), F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("X").alias("sex"), _case("c_mktsegment", _STATUS).alias("study_status"),
            F.col("last").alias("last_data_received_at"), F.lit(None).cast("string").alias("phone"), F.when(k % 5 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).alias("email"), F.lit(None).cast("string").alias("notes"),
        )

    @property
    def device(self) -> DataFrame:
        s, k = self._read("supplier"), F.col("s_suppkey")
        holder = (k - F.when(k % 20 == 1, 1).otherwise(0)) * 7 + 1
        created = _later(_ts("2023-06-01"), k * 3600)
        return s.select(
            _id("d_", k).alias("id"), created.alias("created_at"), created.alias("updated_at"), F.when(k % 29 == 28, _ts("2024-01-20")).alias("deleted_at"), F.col("s_name").alias("serial_number"),
            F.when(k % 2 == 0, "SIM7080G v1").otherwise("SIM7080G v2").alias("model"), F.when(k % 5 <= 1, _id("p_", holder)).alias("patient_id"), F.sha2("s_name", 256).alias("api_key_hash"),
            F.when(k % 7 != 0, F.concat(F.lit("0."), (k % 4).cast("string"), F.lit(".1"))).alias("firmware_version"), F.when(k % 11 != 0, _later(_ts(AS_OF), -(k * 13 % 40) * 3600 - 900)).alias("last_seen_at"),
            F.when(k % 13 != 0, k * 11 % 100).cast("int").alias("last_battery_pct"), F.when(k % 9 != 0, k * 17 % 200).cast("int").alias("last_sd_free_mb"),
            F.when(k % 5 <= 1, "assigned").when(k % 5 == 2, "available").when(k % 5 == 3, "maintenance").otherwise("retired").alias("status"),
        )

    @property
    def study(self) -> DataFrame:
        lines = self._read("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("samples"), F.count("*").alias("events"), F.min("l_suppkey").alias("device"))
        o, k = self._read("orders"), F.col("o_orderkey")
        status = _case("o_orderstatus", {"P": "in_progress", "F": "completed", "O": "scheduled"})
        started = F.col("o_orderdate")
        return o.join(lines, k == F.col("l_orderkey"), "left").select(
            _id("s_", k).alias("id"), started.alias("created_at"), started.alias("updated_at"), F.when(k % 41 == 0, _ts("2024-01-15")).alias("deleted_at"), _id("p_", "o_custkey").alias("patient_id"), _id("d_", F.coalesce("device", F.lit(1))).alias("device_id"),
            started.alias("started_at"), F.when(F.col("o_orderstatus") != "P", _later(started, F.col("samples") * 3600)).alias("ended_at"), status.alias("status"), F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples_count"), F.coalesce("events", F.lit(0)).cast("bigint").alias("events_count"),
            F.when(k % 3 != 0, F.concat(F.lit("ecg/s_"), k.cast("string"), F.lit(".bin"))).alias("ecg_s3_key"), F.lit(250).alias("sample_rate"), F.when(k % 4 == 0, F.col("samples") * 3_600_000).alias("duration_ms"),
        )

    @property
    def event(self) -> DataFrame:
        """Events with device_id and their time ``at``; batches have an hour each."""
        e = self._read("events")
        hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).cast("bigint")
        k = F.col("event_id")
        severity = F.when(k % 4 == 0, "LOW").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "HIGH").otherwise("CRITICAL")
        return e.select(
            _id("e_", k).alias("id"), k.alias("number"), F.concat(_id("b_", "user_id"), F.lit("_"), hour.cast("string")).alias("batch_id"), _id("d_", "user_id").alias("device_id"), _case("event_type", _EVENT).alias("event_type"), severity.alias("severity"),
            ((F.unix_micros("ts") % 3_600_000_000) / F.lit(1e6)).alias("timestamp_in_recording"), F.lit(None).cast("double").alias("duration_seconds"), F.lit(None).cast("double").alias("confidence_score"), F.col("props").alias("metadata"), F.col("ts").alias("at"), "value", (hour * 3600).alias("batch_timestamp"),
        )

    @property
    def batch(self) -> DataFrame:
        return self.event.groupBy(F.col("batch_id").alias("id"), "device_id", "batch_timestamp").agg(F.max("at").alias("received_at"), F.count("*").alias("num_samples")).select(
            "id", "device_id", "received_at", "batch_timestamp", F.lit(3600).alias("duration_seconds"), F.lit(250).alias("sample_rate"), F.lit(1).alias("num_channels"), "num_samples", F.lit("delta").alias("compression_type"), F.lit("PENDING").alias("processing_status"), F.lit(None).cast("string").alias("processing_error")
        )

    @property
    def alert(self) -> DataFrame:
        from pulsegrid.operators.joins import event_chain
        from pulsegrid.operators.rhythm import alerts_for

        chain = event_chain(self.event.drop("device_id", "batch_timestamp"), self.batch, self.device, self.patient)
        made = alerts_for(chain).join(self.event.select(F.col("id").alias("_e"), "number", "at"), F.col("event_id") == F.col("_e"))
        return made.select(_id("a_", "number").alias("id"), "patient_id", "event_id", "severity", "message", F.lit(None).cast("timestamp").alias("seen_at"), F.when(F.col("number") % 3 == 0, _later(F.col("at"), F.lit(3600))).alias("acknowledged_at"), F.lit(None).cast("string").alias("acknowledged_by"), F.col("at").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))

    @property
    def audit(self) -> DataFrame:
        e = self._read("events")
        return e.select(_id("au_", "event_id").alias("id"), _id("u_", "user_id").alias("user_id"), _case("event_type", _AUDIT).alias("event_type"), F.lit(None).cast("string").alias("ip_address"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"))

    @property
    def signal(self) -> DataFrame:
        return self._read("embeddings").select(_id("v_", "vec_id").alias("study_id"), F.lit(250).alias("sample_rate"), F.lit(0).cast("bigint").alias("start_ts_ms"), F.lit(0).alias("chunk_index"), F.col("embedding").cast("array<float>").alias("samples"))


DOMAIN_SQL = """WITH
doctor AS (SELECT 'dr_' || n_nationkey AS id, 'u_' || n_nationkey AS user_id, n_name AS specialty FROM nation),
patient AS (
  SELECT 'p_' || c_custkey AS id, TIMESTAMP '2023-01-01' + to_minutes(c_custkey) AS created_at, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-15' END AS deleted_at,
    'dr_' || c_nationkey AS doctor_id, 'mr_' || c_custkey AS medical_record_num, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
    CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS DATE) AS date_of_birth, CASE WHEN c_custkey % 17 <> 0 THEN CAST(28000000 + c_custkey * 137 AS VARCHAR) END AS dni,
    CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS sex,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'active' WHEN 'BUILDING' THEN 'paused' WHEN 'FURNITURE' THEN 'completed' WHEN 'HOUSEHOLD' THEN 'none' WHEN 'MACHINERY' THEN 'active' END AS study_status,
    l.last AS last_data_received_at, CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) l ON c_custkey = l.o_custkey),
device AS (
  SELECT 'd_' || s_suppkey AS id, TIMESTAMP '2023-06-01' + to_hours(s_suppkey) AS created_at, CASE WHEN s_suppkey % 29 = 28 THEN TIMESTAMP '2024-01-20' END AS deleted_at, s_name AS serial_number,
    CASE WHEN s_suppkey % 2 = 0 THEN 'SIM7080G v1' ELSE 'SIM7080G v2' END AS model, CASE WHEN s_suppkey % 5 <= 1 THEN 'p_' || ((s_suppkey - CASE WHEN s_suppkey % 20 = 1 THEN 1 ELSE 0 END) * 7 + 1) END AS patient_id,
    CASE WHEN s_suppkey % 7 <> 0 THEN '0.' || (s_suppkey % 4) || '.1' END AS firmware_version, CASE WHEN s_suppkey % 11 <> 0 THEN TIMESTAMP '2024-01-31' - to_hours(s_suppkey * 13 % 40) - INTERVAL 15 MINUTE END AS last_seen_at,
    CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 11 % 100 END AS last_battery_pct, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 17 % 200 END AS last_sd_free_mb,
    CASE s_suppkey % 5 WHEN 0 THEN 'assigned' WHEN 1 THEN 'assigned' WHEN 2 THEN 'available' WHEN 3 THEN 'maintenance' ELSE 'retired' END AS status
  FROM supplier),
study AS (
  SELECT 's_' || o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN TIMESTAMP '2024-01-15' END AS deleted_at, 'p_' || o_custkey AS patient_id, 'd_' || COALESCE(device, 1) AS device_id, o_orderdate AS started_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_hours(samples) END AS ended_at, CASE o_orderstatus WHEN 'P' THEN 'in_progress' WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' END AS status,
    COALESCE(samples, 0) AS samples_count, COALESCE(events, 0) AS events_count, CASE WHEN o_orderkey % 3 <> 0 THEN 'ecg/s_' || o_orderkey || '.bin' END AS ecg_s3_key, CASE WHEN o_orderkey % 4 = 0 THEN samples * 3600000 END AS duration_ms
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS samples, count(*) AS events, min(l_suppkey) AS device FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
event AS (
  SELECT 'e_' || event_id AS id, event_id AS number, 'b_' || user_id || '_' || (epoch_us(ts) // 3600000000) AS batch_id, 'd_' || user_id AS device_id,
    CASE event_type WHEN 'error' THEN 'PAUSE' WHEN 'signup' THEN 'TACHYCARDIA' WHEN 'click' THEN 'PVC' WHEN 'purchase' THEN 'BRADYCARDIA' WHEN 'view' THEN 'NOISE' END AS event_type,
    CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, (epoch_us(ts) % 3600000000) / 1e6 AS timestamp_in_recording, ts AS moment, value, (epoch_us(ts) // 3600000000) * 3600 AS batch_timestamp, props
  FROM events),
batch AS (SELECT batch_id AS id, device_id, batch_timestamp, max(moment) AS received_at, count(*) AS num_samples FROM event GROUP BY ALL),
live_device AS (SELECT * FROM device WHERE deleted_at IS NULL),
live_patient AS (SELECT * FROM patient WHERE deleted_at IS NULL),
live_study AS (SELECT * FROM study WHERE deleted_at IS NULL),
held AS (SELECT patient_id, min(id) AS assigned_device_id FROM live_device WHERE status = 'assigned' GROUP BY patient_id),
chain AS (SELECT e.*, d.patient_id, d.serial_number, p.doctor_id FROM event e JOIN live_device d ON e.device_id = d.id JOIN live_patient p ON d.patient_id = p.id),
alert AS (SELECT 'a_' || number AS id, patient_id, doctor_id, id AS event_id, severity, event_type || ' en ' || serial_number AS message, CASE WHEN number % 3 = 0 THEN moment + INTERVAL 1 HOUR END AS acknowledged_at, moment AS created_at FROM chain WHERE severity IN ('HIGH', 'CRITICAL')),
severity_rank AS (SELECT * FROM (VALUES ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) t(severity, rank)),
audit AS (SELECT 'au_' || event_id AS id, 'u_' || user_id AS user_id, CASE event_type WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'signup' THEN 'REGISTER' WHEN 'click' THEN 'LOGIN_OK' WHEN 'purchase' THEN 'LOGOUT' WHEN 'view' THEN 'PASSWORD_RESET_REQUESTED' END AS event_type, ts AS created_at, props AS metadata FROM events)
"""
