"""More queries of the catalog: filters, scalar functions, viewports, state changes, uploads and payloads.

Each has its oracle; the conventions are those of ``catalog``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.catalog import _BEATS, _beats, _commands, _folded, _number, ms, query, rounded, timed
from pulsegrid.functions import clinical, clock, requests, text, viewport
from pulsegrid.operators import aggregates, commands, joins, paging, predicates, projections, rhythm, sets, validation
from pulsegrid.operators import signal as sig
from pulsegrid.operators.predicates import live
from pulsegrid.schemas import DEVICE_STATUSES
from pulsegrid.sources import scratch, signals, tables
from pulsegrid.sources.bindings import AS_OF, Domain
from pulsegrid.streaming import ingest, status


def num() -> Column:
    """An event's number."""
    return F.col("number")


# Filters and sets


@query("f07_excluding", "SELECT id FROM live_patient WHERE dni IS NOT NULL AND id <> 'p_3'")
def _(d: Domain) -> DataFrame:
    return predicates.excluding(live(d.patient).filter(F.col("dni").isNotNull()), "id", "p_3").select("id")


_USERS = ", usr AS (SELECT 'u_' || n_nationkey AS id, 'auth|' || n_nationkey AS auth0_id, lower(n_name) || '@example.com' AS email, n_name AS full_name, CASE n_nationkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'asistente' ELSE 'medico' END AS role, n_nationkey % 4 <> 3 AS is_active, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS last_logout_at, CASE WHEN n_nationkey % 11 = 10 THEN TIMESTAMP '2024-01-15' END AS deleted_at FROM nation)"


def _users(d: Domain) -> DataFrame:
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    rows = d.doctor.select(F.col("user_id").alias("id"), F.col("specialty").alias("full_name"))
    return rows.select(
        "id", F.lit(AS_OF).cast("timestamp").alias("created_at"), F.lit(AS_OF).cast("timestamp").alias("updated_at"), F.when(k % 11 == 10, F.lit("2024-01-15").cast("timestamp")).alias("deleted_at"), F.concat(F.lit("auth|"), k.cast("string")).alias("auth0_id"),
        F.concat(F.lower("full_name"), F.lit("@example.com")).alias("email"), "full_name", F.when(k % 5 == 0, "admin").when(k % 5 == 1, "asistente").otherwise("medico").alias("role"), (k % 4 != 3).alias("is_active"), F.when(k % 3 == 0, F.lit("2024-01-10").cast("timestamp")).alias("last_logout_at"),
    )


@query("f09_valid_sessions", _USERS + " SELECT u.id, e.number FROM usr u JOIN event e ON u.id = 'u_' || (e.number % 25) WHERE u.deleted_at IS NULL AND u.is_active AND (u.last_logout_at IS NULL OR e.moment > u.last_logout_at)")
def _(d: Domain) -> DataFrame:
    tokens = d.event.select("number", F.col("at").alias("issued_at"), F.concat(F.lit("u_"), (num() % 25).cast("string")).alias("id"))
    return predicates.valid_session(_users(d).join(tokens, "id"), F.col("issued_at")).select("id", "number")


@query("f16_lists", """SELECT id, array_to_string(list_filter(string_split(t, ','), lambda x: x IN ('available', 'assigned', 'maintenance', 'retired')), ',') AS parsed, array_to_string(CASE WHEN list_contains(l, s) THEN list_filter(l, lambda x: x <> s) ELSE list_append(l, s) END, ',') AS toggled,
 array_to_string(list_sort(list_distinct(list_append(l, s))), ',') AS added, array_to_string(list_filter(l, lambda x: x <> s), ',') AS removed FROM (SELECT id, CASE number % 3 WHEN 0 THEN 'assigned,foo,available' WHEN 1 THEN 'retired,retired' ELSE '' END AS t, CASE WHEN number % 2 = 0 THEN ['assigned', 'available'] ELSE ['retired'] END AS l, CASE number % 4 WHEN 0 THEN 'assigned' WHEN 1 THEN 'retired' ELSE 'maintenance' END AS s FROM event)""")
def _(d: Domain) -> DataFrame:
    t = F.when(num() % 3 == 0, "assigned,foo,available").when(num() % 3 == 1, "retired,retired").otherwise("")
    some = F.when(num() % 2 == 0, F.array(F.lit("assigned"), F.lit("available"))).otherwise(F.array(F.lit("retired")))
    s = F.when(num() % 4 == 0, "assigned").when(num() % 4 == 1, "retired").otherwise("maintenance")
    joined = lambda c: F.array_join(c, ",")
    return d.event.select("id", joined(text.parse_list(t, DEVICE_STATUSES)).alias("parsed"), joined(text.toggle(some, s)).alias("toggled"), joined(F.sort_array(sets.add(some, s))).alias("added"), joined(sets.remove(some, s)).alias("removed"))


@query("f18_roles", _USERS + " SELECT id, role IN ('admin', 'medico') AS allowed FROM usr")
def _(d: Domain) -> DataFrame:
    return _users(d).select("id", predicates.allowed_role(F.col("role"), ["medico"]).alias("allowed"))


@query("f20_batches_between", "SELECT id FROM batch WHERE received_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'")
def _(d: Domain) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp")
    return predicates.between(d.batch, "received_at", at("2024-01-05"), at("2024-01-20 12:00:00")).select("id")


@query("f19_requests", """SELECT id, CASE WHEN failure IN ('ECONNABORTED', 'ETIMEDOUT') THEN 'TIMEOUT' WHEN failure = 'ERR_CANCELED' THEN 'CANCELLED' WHEN status IS NULL THEN 'NETWORK' WHEN status IN (400, 422) THEN 'VALIDATION' WHEN status = 401 THEN 'UNAUTHORIZED' WHEN status = 403 THEN 'FORBIDDEN' WHEN status = 404 THEN 'NOT_FOUND' WHEN status = 409 THEN 'CONFLICT' WHEN status >= 500 THEN 'SERVER' ELSE 'UNKNOWN' END AS code,
 attempt < 2 AND method = 'get' AND failure IS DISTINCT FROM 'ERR_CANCELED' AND (status IS NULL OR status BETWEEN 500 AND 599) AS retried, CAST(least(1000 * 2 ** attempt, 8000) AS BIGINT) AS wait_ms, CASE WHEN attempt < 3 THEN 1 WHEN attempt = 3 THEN 2 ELSE 4 END AS upload_hours
FROM (SELECT id, CASE WHEN number % 3 = 0 THEN 'post' ELSE 'get' END AS method, CASE number % 7 WHEN 0 THEN 'ETIMEDOUT' WHEN 1 THEN 'ERR_CANCELED' WHEN 2 THEN 'ECONNABORTED' END AS failure, CASE WHEN number % 2 = 0 THEN 390 + number % 230 END AS status, number % 6 AS attempt FROM event)""")
def _(d: Domain) -> DataFrame:
    method, attempt = F.when(num() % 3 == 0, "post").otherwise("get"), num() % 6
    failure = F.when(num() % 7 == 0, "ETIMEDOUT").when(num() % 7 == 1, "ERR_CANCELED").when(num() % 7 == 2, "ECONNABORTED")
    code = F.when(num() % 2 == 0, 390 + num() % 230)
    return timed(d.event.select("id", requests.error_code(code, failure).alias("code"), requests.may_retry(method, code, failure, attempt).alias("retried"), clinical.backoff_ms(attempt).alias("wait_ms"), requests.upload_interval_hours(attempt).alias("upload_hours")))


@query("t15_device_states", """SELECT id, state, CASE WHEN state = 'SIM_ERROR' THEN 'SIM_SLEEPING' WHEN state IN ('SIM_WAKING', 'SENDING', 'CONFIRMING') AND number % 3 = 0 THEN 'SIM_ERROR' ELSE list_extract(['PREPARING_BATCH', 'SIM_WAKING', 'SENDING', 'CONFIRMING', 'CLEANING_SD', 'SIM_SLEEPING', 'RECORDING'], CAST(number % 8 + 1 AS BIGINT)) END AS then_state
FROM (SELECT id, number, list_extract(['RECORDING', 'PREPARING_BATCH', 'SIM_WAKING', 'SENDING', 'CONFIRMING', 'CLEANING_SD', 'SIM_SLEEPING', 'SIM_ERROR'], CAST(number % 8 + 1 AS BIGINT)) AS state FROM event)""")
def _(d: Domain) -> DataFrame:
    rows = d.event.withColumn("state", text.cyclic([*requests.DEVICE_STATES, "SIM_ERROR"], num()))
    return rows.select("id", "state", requests.next_device_state(F.col("state"), num() % 3 != 0).alias("then_state"))


@query("x37_claims", _USERS + f" SELECT id AS sub, email, role, epoch_us(TIMESTAMP '{AS_OF}') // 1000000 AS iat, epoch_us(TIMESTAMP '{AS_OF}') // 1000000 + 28800 AS exp FROM usr")
def _(d: Domain) -> DataFrame:
    return _users(d).select(requests.claims(F.col("id"), F.col("email"), F.col("role"), clock.at(AS_OF), 480).alias("c")).select("c.*")


@query("s09_stored_sessions", "SELECT id, CASE WHEN number % 3 <> 0 THEN 't' || number END AS token FROM event")
def _(d: Domain) -> DataFrame:
    kept = F.when(num() % 3 == 0, F.concat(F.lit('{"token": '), num().cast("string"))).otherwise(F.concat(F.lit('{"token": "t'), num().cast("string"), F.lit('", "user": null}')))
    return d.event.select("id", requests.stored_session(kept, "token string, user string")["token"].alias("token"))


@query("p11_users", _USERS + " SELECT id, email, full_name, role FROM usr")
def _(d: Domain) -> DataFrame:
    return projections.user_out(_users(d))


@query("p14_forms", "SELECT id, trim(first_name || ' ' || last_name) AS full_name, COALESCE(dni, '') AS dni, sex, CAST(date_of_birth AS VARCHAR) AS birth_date, email AS contact_email, CAST(NULL AS VARCHAR) AS contact_phone, COALESCE(email, '') AS form_email, '' AS form_phone FROM patient")
def _(d: Domain) -> DataFrame:
    pad = lambda c: F.concat(F.lit(" \t"), F.coalesce(c, F.lit("")), F.lit("\n "))
    forms = d.patient.select("id", pad(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"), pad(F.col("dni")).alias("dni"), F.col("date_of_birth").alias("birth_date"), "sex", pad(F.col("email")).alias("contact_email"), pad(F.col("phone")).alias("contact_phone"))
    given = projections.patient_form_to_input(forms)
    back = projections.patient_to_form(given).select("id", F.col("contact_email").alias("form_email"), F.col("contact_phone").alias("form_phone"))
    return timed(given.join(back, "id"))


# Joins, aggregates and orders


@query("j10_synchronised", "SELECT number AS frame, number % 1000 AS ecg, number % 77 AS impedance FROM event WHERE number % 2 = 0 AND number % 3 = 0")
def _(d: Domain) -> DataFrame:
    keys = d.event.select(F.lit("s").alias("study_id"), num().alias("frame"))
    ecg = keys.filter("frame % 2 = 0").withColumn("ecg", F.col("frame") % 1000)
    impedance = keys.filter("frame % 3 = 0").withColumn("impedance", F.col("frame") % 77)
    return joins.synchronised(ecg, impedance).select("frame", "ecg", "impedance")


@query("j12_doctor_of_user", _USERS + " SELECT u.id, d.id AS doctor_id, d.specialty FROM usr u JOIN doctor d ON u.id = d.user_id WHERE u.deleted_at IS NULL")
def _(d: Domain) -> DataFrame:
    return joins.doctor_of(_users(d), d.doctor).select("id", "doctor_id", "specialty")


@query("a02_existence", "SELECT doctor_id, count(*) > 0 AS there FROM live_patient GROUP BY doctor_id UNION ALL SELECT 'none', FALSE")
def _(d: Domain) -> DataFrame:
    some = live(d.patient).groupBy("doctor_id").agg(aggregates.there().alias("there"))
    none = live(d.patient).filter("doctor_id = 'none'").agg(aggregates.there().alias("there")).select(F.lit("none").alias("doctor_id"), "there")
    return sets.bag(some, none)


@query("a04_widened_range", "SELECT 'v_' || vec_id AS study_id, CAST(CASE WHEN lo = hi THEN lo - 1 ELSE lo END AS DOUBLE) AS lo, CAST(CASE WHEN lo = hi THEN hi + 1 ELSE hi END AS DOUBLE) AS hi FROM (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 3.0 ELSE list_min(embedding) END AS lo, CASE WHEN vec_id % 5 = 0 THEN 3.0 ELSE list_max(embedding) END AS hi FROM embeddings)")
def _(d: Domain) -> DataFrame:
    rows = d.signal.select("study_id", F.explode("samples").alias("v")).withColumn("v", F.when(_number("study_id") % 5 == 0, 3.0).otherwise(F.col("v").cast("double")))
    return aggregates.widened_range(rows, "v", "study_id")


@query("a06_assigned_ids", "SELECT DISTINCT patient_id FROM live_device WHERE patient_id IS NOT NULL")
def _(d: Domain) -> DataFrame:
    return aggregates.distinct_values(live(d.device), "patient_id")


@query("o12_alerts_by_severity", "SELECT a.id, a.severity FROM alert a JOIN severity_rank r USING (severity) ORDER BY r.rank DESC, a.created_at DESC, a.id LIMIT 40")
def _(d: Domain) -> DataFrame:
    return paging.page(d.alert, paging.by_severity(d.alert), 40).select("id", "severity")


@query("o13_oldest_pending", "SELECT id, batch_timestamp FROM batch ORDER BY batch_timestamp, id LIMIT 5")
def _(d: Domain) -> DataFrame:
    return paging.oldest_pending(d.batch).select("id", "batch_timestamp")


# Scalar functions


@query("x03_strip", "SELECT id, 'e' || number AS stripped FROM event")
def _(d: Domain) -> DataFrame:
    return d.event.select("id", text.strip(F.concat(F.lit(" \t\n"), F.lit("e"), num().cast("string"), F.lit("\r \x0b"))).alias("stripped"))


@query("x04_split_names", "SELECT id, CASE WHEN number % 4 <> 3 THEN 'n' || number END AS first, CASE number % 4 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN 'b c' END AS last FROM event")
def _(d: Domain) -> DataFrame:
    name = F.when(num() % 4 == 0, F.concat(F.lit("n"), num().cast("string"))).when(num() % 4 == 1, F.concat(F.lit(" n"), num().cast("string"), F.lit("  b "))).when(num() % 4 == 2, F.concat(F.lit("n"), num().cast("string"), F.lit(" b\t c"))).otherwise("  ")
    parts = text.split_full_name(name)
    return d.event.select("id", parts["first"].alias("first"), parts["last"].alias("last"))


@query("x08_client_ip", "SELECT id, CASE WHEN number % 3 = 0 THEN '10.0.0.' || (number % 250) ELSE '127.0.0.1' END AS ip FROM event")
def _(d: Domain) -> DataFrame:
    forwarded = F.when(num() % 3 == 0, F.concat(F.lit(" 10.0.0."), (num() % 250).cast("string"), F.lit(" , 9.9.9.9"))).when(num() % 3 == 1, "")
    return d.event.select("id", text.client_ip(forwarded, F.lit("127.0.0.1")).alias("ip"))


@query("x18_dates", "SELECT id, COALESCE(strftime(t, '%d/%m/%Y'), '—') AS day, COALESCE(strftime(t, '%d/%m/%Y, %H:%M'), '—') AS minute FROM (SELECT id, CASE WHEN number % 4 <> 0 THEN moment END AS t FROM event)")
def _(d: Domain) -> DataFrame:
    t = F.when(num() % 4 != 0, F.col("at"))
    return d.event.select("id", clock.date_text(t).alias("day"), clock.datetime_text(t).alias("minute"))


@query("x20_timestamps", """SELECT id, CASE WHEN ms < 0 THEN '-' ELSE '' END || lpad(CAST(a // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(a // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(a % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') AS shown
FROM (SELECT id, ms, CAST(abs(floor(ms)) AS BIGINT) AS a FROM (SELECT id, (number * 7919 - 4000000) / 2.0e0 AS ms FROM event))""")
def _(d: Domain) -> DataFrame:
    return d.event.select("id", clock.timestamp_text((num() * 7919 - 4_000_000) / F.lit(2.0)).alias("shown"))


@query("x22_deltas", "SELECT id, CASE WHEN v = 0 THEN 'Sin cambios' WHEN v > 0 THEN '+' || v || ' lpm' ELSE '−' || abs(v) || ' lpm' END AS shown, CASE WHEN v > 0 THEN '+' ELSE '' END || v || ' vs. período anterior' AS against, CASE WHEN v > 0 THEN 'up' WHEN v < 0 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT id, number % 7 - 3 AS v FROM event)")
def _(d: Domain) -> DataFrame:
    v = num() % 7 - 3
    return d.event.select("id", clinical.delta_text(v, "lpm").alias("shown"), clinical.delta_period_text(v).alias("against"), clinical.trend(v).alias("trend"))


@query("x31_ids", "SELECT id, CASE WHEN number % 3 <> 0 THEN 'p_' || number END AS patient, CASE WHEN number % 3 <> 0 THEN number % 9 END AS study_number, 'HOLTER-AR-' || number AS serial, 'd_' || lpad(CAST(number AS VARCHAR), CAST(greatest(3, length(CAST(number AS VARCHAR))) AS INTEGER), '0') AS padded FROM event")
def _(d: Domain) -> DataFrame:
    n = num().cast("string")
    parts = text.study_id_parts(F.when(num() % 3 != 0, F.concat(F.lit("s_p_"), n, F.lit("_"), (num() % 9).cast("string"))).otherwise(F.concat(F.lit("s_q_"), n)))
    return timed(d.event.select("id", parts["patient"].alias("patient"), parts["number"].alias("study_number"), text.serial_of(F.concat(F.lit("d_"), n)).alias("serial"), text.padded("d_", num()).alias("padded")))


@query("x33_numbers", "SELECT id, replace(format('{:,}', number * 1237), ',', '.') AS shown, nullif(CAST(number % 3 AS DOUBLE), 0) AS hours, '{\"reason\":\"r' || number || '\"' || CASE WHEN number % 2 = 0 THEN ',\"n\":' || number ELSE '' END || '}' AS metadata FROM event")
def _(d: Domain) -> DataFrame:
    return d.event.select("id", text.thousands(num() * 1237).alias("shown"), clinical.zero_as_missing((num() % 3).cast("double")).alias("hours"), text.metadata_json(reason=F.concat(F.lit("r"), num().cast("string")), n=F.when(num() % 2 == 0, num())).alias("metadata"))


@query("x40_synthetic_text", f"SELECT id, 'josé.' || CASE number % 3 WHEN 0 THEN 'garcia' WHEN 1 THEN 'pérez-gomez' ELSE 'diazáá' END || '@example.com' AS email, CASE number % 3 WHEN 0 THEN 'tachycardia' WHEN 1 THEN 'pause' ELSE 'pvc' END AS kind, (epoch_us(TIMESTAMP '{AS_OF}') // 1000) - (number % 50 + 1) * 37 * 60000 AS detected_at FROM event".replace("'pérez-gomez'", "'perez-gomez'").replace("'diazáá'", "'diazaá'"))
def _(d: Domain) -> DataFrame:
    last = F.when(num() % 3 == 0, "García").when(num() % 3 == 1, "Pérez-Gómez").otherwise("Díazáá")
    return d.event.select("id", text.synthetic_email(F.lit("José"), last).alias("email"), text.cyclic(["tachycardia", "pause", "pvc"], num()).alias("kind"), (clock.epoch_ms(clock.at(AS_OF)) - (num() % 50 + 1) * 37 * 60_000).alias("detected_at"))


@query("x12_epoch", "SELECT id, CAST(floor(epoch_us(moment) / 1000) AS BIGINT) AS at_ms, moment IS NOT NULL AS there FROM event")
def _(d: Domain) -> DataFrame:
    # milliseconds go through binary seconds, as specified; the oracle has them exactly, so one more or less is the same
    return d.event.select("id", F.when(F.abs(clock.epoch_ms(F.col("at")) - ms("at")) <= 1, ms("at")).alias("at_ms"), F.col("at").isNotNull().alias("there"))


# Viewports


def _span(c: Column, lo: str = "lo", hi: str = "hi") -> list[Column]:
    return [rounded(c["lo"], 6).alias(lo), rounded(c["hi"], 6).alias(hi)]


_VIEW = "v AS (SELECT id, number, CAST(number % 300 AS DOUBLE) AS lo, CAST(number % 300 + 5 + number % 20 AS DOUBLE) AS hi, CAST(310 + number % 50 AS DOUBLE) AS total FROM event)"


def _clamped(lo: str, hi: str) -> str:
    return f"round(CASE WHEN ({hi}) - ({lo}) >= total THEN 0.0 WHEN ({lo}) < 0 THEN 0.0 WHEN ({hi}) > total THEN total - (({hi}) - ({lo})) ELSE {lo} END, 6) AS lo, round(CASE WHEN ({hi}) - ({lo}) >= total THEN total WHEN ({lo}) < 0 THEN ({hi}) - ({lo}) WHEN ({hi}) > total THEN total ELSE {hi} END, 6) AS hi"


def _view(d: Domain) -> tuple[DataFrame, Column, Column, Column]:
    lo = (num() % 300).cast("double")
    return d.event, lo, lo + 5 + num() % 20, (310 + num() % 50).cast("double")


@query("g06_initial", f", {_VIEW} SELECT id, total - 10 AS lo, total AS hi, CASE WHEN least(total, hi) > greatest(0, lo - 50) THEN greatest(0, lo - 50) ELSE 0 END AS asked_lo, CASE WHEN least(total, hi) > greatest(0, lo - 50) THEN least(total, hi) ELSE total END AS asked_hi FROM v")
def _(d: Domain) -> DataFrame:
    df, lo, hi, total = _view(d)
    return df.select("id", *_span(viewport.initial(total)), *_span(viewport.initial(total, asked_lo=lo - 50, asked_hi=hi), "asked_lo", "asked_hi"))


@query("g08_jump", f", {_VIEW} SELECT id, {_clamped('number % 400 - (hi - lo) / 2', 'number % 400 + (hi - lo) / 2')} FROM v")
def _(d: Domain) -> DataFrame:
    df, lo, hi, total = _view(d)
    return df.select("id", *_span(viewport.jump_to((num() % 400) * 1000 + 5000, F.lit(5000), lo, hi, total)))


@query("g09_zoom_about", f", {_VIEW} SELECT id, {_clamped('(lo + 1) - 1 * 1.2e0', '(lo + 1) + (hi - lo - 1) * 1.2e0')} FROM v")
def _(d: Domain) -> DataFrame:
    df, lo, hi, total = _view(d)
    return df.select("id", *_span(viewport.zoom_about(lo + 1, lo, hi, total, out=True)))


@query("g10_pan", f", {_VIEW}, w AS (SELECT id, {_clamped('lo - (number % 500 / 800e0) * (hi - lo)', 'hi - (number % 500 / 800e0) * (hi - lo)')} FROM v), k AS (SELECT id, {_clamped('lo + (hi - lo) * 0.1e0', 'hi + (hi - lo) * 0.1e0')} FROM v) SELECT w.id, w.lo, w.hi, k.lo AS key_lo, k.hi AS key_hi FROM w JOIN k USING (id)")
def _(d: Domain) -> DataFrame:
    df, lo, hi, total = _view(d)
    return df.select("id", *_span(viewport.pan_pixels(num() % 500, F.lit(800.0), lo, hi, total)), *_span(viewport.pan_key(lo, hi, total, right=True), "key_lo", "key_hi"))


@query("g11_zoom", f", {_VIEW} SELECT id, round((lo + hi) / 2 - greatest(500, (hi - lo) / 2) / 2, 6) AS lo, round((lo + hi) / 2 + greatest(500, (hi - lo) / 2) / 2, 6) AS hi, round((lo + hi) / 2 - least(total, (hi - lo) * 2) / 2, 6) AS out_lo, round((lo + hi) / 2 + least(total, (hi - lo) * 2) / 2, 6) AS out_hi FROM (SELECT id, lo * 90 AS lo, hi * 100 AS hi, total * 10 AS total FROM v)")
def _(d: Domain) -> DataFrame:
    df, lo, hi, total = _view(d)
    return df.select("id", *_span(viewport.zoom_in(lo * 90, hi * 100)), *_span(viewport.zoom_out(lo * 90, hi * 100, total * 10), "out_lo", "out_hi"))


@query("g12_percent", f", {_VIEW} SELECT id, round(greatest(0, least(100, lo / total * 100)), 6) AS l, round(greatest(0.5, least(100, (hi - lo) / total * 100)), 6) AS width, CAST(0 AS DOUBLE) AS reset_lo, total AS reset_hi, round(number % 9000 / 250e0, 6) AS duration, round(7000 + number % 9000 / 250e0 * 1000, 6) AS end_at FROM v")
def _(d: Domain) -> DataFrame:
    df, lo, hi, total = _view(d)
    p = viewport.percents(lo * 1000 + 7000, hi * 1000 + 7000, F.lit(7000.0), total)
    return df.select("id", rounded(p["left"], 6).alias("l"), rounded(p["width"], 6).alias("width"), *_span(viewport.reset(total), "reset_lo", "reset_hi"), rounded(viewport.duration_s(num() % 9000, F.lit(250)), 6).alias("duration"), rounded(viewport.end_ms(F.lit(7000), num() % 9000, F.lit(250)), 6).alias("end_at"))


@query("g03_pixels", """, s AS (SELECT vec_id, len(embedding) AS n, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)), k AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM s GROUP BY vec_id),
c AS (SELECT vec_id, i // greatest(1, n // 8) AS col, min(v) AS mn, max(v) AS mx FROM s GROUP BY ALL), y AS (SELECT vec_id, col, 2 + (hi - mx) * (60.0 / (hi - lo)) AS t, 2 + (hi - mn) * (60.0 / (hi - lo)) AS b FROM c JOIN k USING (vec_id) WHERE col < 8 AND hi > lo)
SELECT 'v_' || vec_id AS study_id, col, round(t, 4) AS y_top, round(greatest(b, t + 0.5), 4) AS y_bottom FROM y""")
def _(d: Domain) -> DataFrame:
    rows = sig.samples(sig.sized(d.signal, "study_id"), "study_id").withColumn("v", F.col("v").cast("double"))
    return sig.pixels(sig.overview(rows, 8, "study_id"), 64).select("study_id", "col", rounded(F.col("y_top")).alias("y_top"), rounded(F.col("y_bottom")).alias("y_bottom"))


@query("g04_signal_length", "SELECT 'v_' || vec_id AS study_id, CAST(len(embedding) AS BIGINT) AS n, len(embedding) / 250e0 AS duration_s FROM embeddings")
def _(d: Domain) -> DataFrame:
    return sig.signal_length(d.signal, "study_id")


# Validation


@query("v05_device_forms", "SELECT id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(s, 'HOLTER-AR-[0-9]{3,}') THEN 'serial' END, CASE WHEN length(m) < 2 THEN 'model' END], lambda x: x IS NOT NULL), ',') AS broken, array_to_string(list_filter([CASE WHEN length(m) < 2 THEN 'model' END, CASE WHEN number % 4 >= 2 THEN 'status' END], lambda x: x IS NOT NULL), ',') AS edit_broken, number % 5 = 0 AS uuid FROM (SELECT id, number, 'HOLTER-AR-' || number AS s, CASE WHEN number % 3 = 0 THEN 'M' ELSE 'M1' END AS m FROM event)")
def _(d: Domain) -> DataFrame:
    h = F.md5("id")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.when(num() % 5 == 0, F.upper(F.substring(h, 21, 12))).otherwise(F.substring(h, 21, 11)))
    rows = d.event.select("id", F.concat(F.lit(" HOLTER-AR-"), num().cast("string")).alias("serial"), F.when(num() % 3 == 0, "M ").otherwise("M1").alias("model"), F.element_at(F.array(*[F.lit(s) for s in ("available", "maintenance", "assigned", "retired")]), (num() % 4 + 1).cast("int")).alias("status"), uuid.alias("u"))
    joined = lambda rules: F.array_join(validation.broken(rules), ",")
    return rows.select("id", joined(validation.device_form_rules()).alias("broken"), joined(validation.device_edit_rules()).alias("edit_broken"), validation.is_uuid(F.col("u")).alias("uuid"))


# State changes


def _fields(**given: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in given]), F.array(*[v.cast("string") for v in given.values()]))


def _new_patients(d: Domain) -> DataFrame:
    k = _number("id")
    dni = F.when(k % 4 == 0, F.col("dni")).when(k % 4 == 3, F.concat(F.lit("mr_"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    name = F.when(k % 4 == 2, "  ").otherwise(F.concat(F.lit(" Ana María "), k.cast("string")))
    fields = _fields(dni=dni, full_name=name, birth_date=F.lit("1980-02-29"), sex=F.lit("F"), contact_email=F.lit(None))
    key = F.concat(F.lit("n_"), k.cast("string"))
    given = _commands(d.patient, "create_patient", patient=key, doctor=F.col("doctor_id")).drop("fields")
    return given.join(d.patient.select(key.alias("patient_id"), fields.alias("fields")), "patient_id")


_NEW = """, c AS (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM patient), n AS (SELECT *, CASE k % 4 WHEN 0 THEN dni WHEN 3 THEN 'mr_' || k ELSE 'x' || k END AS new_dni, CASE WHEN k % 4 = 0 AND dni IS NOT NULL AND deleted_at IS NULL THEN 'DNI_CONFLICT' WHEN k % 4 = 2 THEN 'INVALID_NAME' WHEN k % 4 = 3 THEN 'RECORD_CONFLICT' END AS code FROM c)"""


@query("m01_create_patients", _NEW + " SELECT 'n_' || k AS id, doctor_id, 'Ana' AS first_name, 'María ' || k AS last_name, new_dni AS dni, new_dni AS medical_record_num, 'F' AS sex, '1980-02-29' AS date_of_birth, 'none' AS study_status FROM n WHERE code IS NULL")
def _(d: Domain) -> DataFrame:
    made = _folded(d, _new_patients(d))[0].filter(F.col("id").startswith("n_"))
    return timed(made.select("id", "doctor_id", "first_name", "last_name", "dni", "medical_record_num", "sex", "date_of_birth", "study_status"))


@query("m01_create_rejects", _NEW + " SELECT 'n_' || k AS patient_id, code FROM n WHERE code IS NOT NULL")
def _(d: Domain) -> DataFrame:
    return _folded(d, _new_patients(d))[2].select("patient_id", "code")


_UPDATES = """, c AS (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM patient), u AS (SELECT c.*, CAST(28000000 + (c.k + 1) * 137 AS VARCHAR) AS wanted, EXISTS (SELECT 1 FROM live_patient o WHERE o.dni = CAST(28000000 + (c.k + 1) * 137 AS VARCHAR)) AS taken FROM c)"""


def _updated(d: Domain) -> DataFrame:
    k = _number("id").cast("bigint")
    none = F.lit(None).cast("map<string,string>")
    fields = F.when(k % 3 == 0, _fields(full_name=F.lit("Nombre Nuevo Largo"))).when(k % 3 == 1, _fields(contact_email=F.lit(None))).when(k % 3 == 2, _fields(dni=28_000_000 + (k + 1) * 137)).otherwise(none)
    given = _commands(d.patient, "update_patient", patient=F.col("id"), doctor=F.col("doctor_id")).drop("fields")
    return given.join(d.patient.select(F.col("id").alias("patient_id"), fields.alias("fields")), "patient_id")


@query("m02_update_patients", _UPDATES + " SELECT id, CASE WHEN deleted_at IS NULL AND k % 3 = 0 THEN 'Nombre' ELSE first_name END AS first_name, CASE WHEN deleted_at IS NULL AND k % 3 = 0 THEN 'Nuevo Largo' ELSE last_name END AS last_name, CASE WHEN deleted_at IS NULL AND k % 3 = 1 THEN NULL ELSE email END AS email, CASE WHEN deleted_at IS NULL AND k % 3 = 2 AND NOT taken THEN wanted ELSE dni END AS dni FROM u")
def _(d: Domain) -> DataFrame:
    return _folded(d, _updated(d))[0].select("id", "first_name", "last_name", "email", "dni")


@query("m02_update_rejects", _UPDATES + " SELECT id AS patient_id, CASE WHEN deleted_at IS NOT NULL THEN 'PATIENT_NOT_FOUND' ELSE 'DNI_CONFLICT' END AS code FROM u WHERE deleted_at IS NOT NULL OR (k % 3 = 2 AND taken)")
def _(d: Domain) -> DataFrame:
    return _folded(d, _updated(d))[2].select("patient_id", "code")


@query("m04_create_devices", "SELECT 'nd_' || substr(id, 3) AS id, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 2 = 0 AND deleted_at IS NULL THEN 'SERIAL_CONFLICT' ELSE 'available' END AS outcome, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 2 = 0 AND deleted_at IS NULL THEN NULL ELSE 'M9' END AS model FROM device")
def _(d: Domain) -> DataFrame:
    k = _number("id")
    key = F.concat(F.lit("nd_"), k.cast("string"))
    serial = F.when(k % 2 == 0, F.col("serial_number")).otherwise(F.concat(F.lit("new-"), k.cast("string")))
    given = _commands(d.device, "create_device", device=key).drop("fields").join(d.device.select(key.alias("device_id"), _fields(serial=serial, model=F.lit("M9"), api_key_hash=F.lit("h")).alias("fields")), "device_id")
    _, made, rejects = _folded(d, given)
    return sets.bag(made.filter(F.col("id").startswith("nd_")).select("id", F.col("status").alias("outcome"), "model"), rejects.select(F.col("device_id").alias("id"), F.col("code").alias("outcome"), F.lit(None).cast("string").alias("model")))


@query("m05_update_devices", """SELECT id, CASE WHEN code IS NULL AND k % 3 = 0 THEN 'maintenance' ELSE status END AS status, CASE WHEN code IS NULL AND k % 3 = 1 THEN 'M9' ELSE model END AS model, code FROM (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'DEVICE_NOT_FOUND' WHEN k % 3 <> 1 AND status = 'assigned' THEN 'DEVICE_ASSIGNED' WHEN k % 3 = 2 THEN 'INVALID_STATUS' END AS code FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM device))""")
def _(d: Domain) -> DataFrame:
    k = _number("id")
    fields = F.when(k % 3 == 0, _fields(status=F.lit("maintenance"))).when(k % 3 == 1, _fields(model=F.lit("M9"))).otherwise(_fields(status=F.lit("retired")))
    given = _commands(d.device, "update_device", device=F.col("id")).drop("fields").join(d.device.select(F.col("id").alias("device_id"), fields.alias("fields")), "device_id")
    _, after, rejects = _folded(d, given)
    return after.select("id", "status", "model").join(rejects.select(F.col("device_id").alias("id"), "code"), "id", "left")


_TARGET = "t AS (SELECT d.*, CAST(substr(d.id, 3) AS BIGINT) AS k, p.id AS wanted, h.assigned_device_id AS holder FROM device d LEFT JOIN live_patient p ON p.id = 'p_' || (CAST(substr(d.id, 3) AS BIGINT) * 3 + 1) LEFT JOIN held h ON h.patient_id = p.id)"


def _targeted(d: Domain, kind: str, rows: DataFrame) -> DataFrame:
    wanted = F.concat(F.lit("p_"), (_number("id") * 3 + 1).cast("string"))
    given = _commands(rows, kind, device=F.col("id"), patient=wanted).drop("doctor_id")
    return given.join(d.patient.select(F.col("id").alias("patient_id"), "doctor_id"), "patient_id", "left")


@query("m07_assign", f""", {_TARGET} SELECT id, CASE WHEN code IS NULL THEN 'assigned' ELSE status END AS status, CASE WHEN code IS NULL THEN wanted ELSE patient_id END AS patient_id, code FROM (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'DEVICE_NOT_FOUND' WHEN status <> 'available' THEN 'DEVICE_NOT_AVAILABLE' WHEN wanted IS NULL THEN 'PATIENT_NOT_FOUND' WHEN holder IS NOT NULL THEN 'PATIENT_ALREADY_ASSIGNED' END AS code FROM t)""")
def _(d: Domain) -> DataFrame:
    _, after, rejects = _folded(d, _targeted(d, "assign", d.device))
    return after.select("id", "status", "patient_id").join(rejects.select(F.col("device_id").alias("id"), "code"), "id", "left")


@query("m09_reassign", f""", {_TARGET} SELECT id, CASE WHEN code IS NULL THEN 'assigned' ELSE status END AS status, CASE WHEN code IS NULL THEN wanted ELSE patient_id END AS patient_id, code FROM (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'DEVICE_NOT_FOUND' WHEN status = 'retired' THEN 'DEVICE_RETIRED' WHEN wanted IS NULL THEN 'PATIENT_NOT_FOUND' WHEN holder <> id THEN 'PATIENT_ALREADY_ASSIGNED' END AS code FROM t WHERE status <> 'assigned')""")
def _(d: Domain) -> DataFrame:
    rows = d.device.filter("status <> 'assigned'")
    _, after, rejects = _folded(d, _targeted(d, "reassign", rows))
    return after.join(rows.select("id"), "id", "left_semi").select("id", "status", "patient_id").join(rejects.select(F.col("device_id").alias("id"), "code"), "id", "left")


def _logins(d: Domain) -> DataFrame:
    return d.event.select(F.concat(F.lit("auth|"), (num() % 40).cast("string")).alias("auth0_id"), F.concat(F.lit("w"), (num() % 40).cast("string"), F.lit("@x.org")).alias("email"), F.lit("10.0.0.1").alias("ip"), "at")


@query("m10_login", _USERS + ", l AS (SELECT 'auth|' || (number % 40) AS a, number % 40 AS n, moment FROM event) SELECT 'new' AS what, substr(sha256(a), 1, 32) AS id, 'w' || n AS name, count(*) AS rows FROM l WHERE n >= 25 GROUP BY a, n UNION ALL SELECT 'audit', COALESCE(u.id, substr(sha256(l.a), 1, 32)), 'LOGIN_OK', count(*) FROM l LEFT JOIN usr u ON l.a = u.auth0_id WHERE COALESCE(u.is_active, TRUE) GROUP BY ALL")
def _(d: Domain) -> DataFrame:
    logins = _logins(d)
    new, doctors, audit = commands.log_in(_users(d), logins)
    counted = new.join(doctors.select(F.col("user_id").alias("_u")), F.col("id") == F.col("_u")).join(logins.groupBy("auth0_id").agg(F.count("*").alias("rows")), "auth0_id")
    return sets.bag(counted.select(F.lit("new").alias("what"), "id", F.col("full_name").alias("name"), "rows"), audit.groupBy(F.lit("audit").alias("what"), F.col("user_id").alias("id"), F.col("event_type").alias("name")).agg(F.count("*").alias("rows")))


@query("m11_logout", _USERS + ", o AS (SELECT 'u_' || (number % 25) AS u, max(moment) AS m FROM event WHERE number % 2 = 0 GROUP BY ALL) SELECT id, (epoch_us(COALESCE(o.m, last_logout_at)) // 1000) AS last_logout_at FROM usr LEFT JOIN o ON usr.id = o.u")
def _(d: Domain) -> DataFrame:
    outs = d.event.filter(num() % 2 == 0).select(F.concat(F.lit("u_"), (num() % 25).cast("string")).alias("user_id"), F.lit("10.0.0.1").alias("ip"), "at")
    return timed(commands.log_out(_users(d), outs)[0].select("id", "last_logout_at"))


@query("m12_register", _USERS + """, r AS (SELECT number AS seq, 'u_' || (number % 25) AS by_id, CASE WHEN number % 4 = 0 THEN lower(n_name) || '@example.com' ELSE 'r' || (number % 300) || '@x.org' END AS email FROM event JOIN nation ON n_nationkey = number % 25),
j AS (SELECT r.*, CASE WHEN a.id IS NULL THEN 'FORBIDDEN' WHEN m.email IS NOT NULL THEN 'EMAIL_CONFLICT' END AS code FROM r LEFT JOIN (SELECT id FROM usr WHERE role = 'admin') a ON r.by_id = a.id LEFT JOIN (SELECT DISTINCT email FROM usr WHERE deleted_at IS NULL) m ON r.email = m.email)
SELECT seq, COALESCE(code, CASE WHEN seq > min(seq) FILTER (WHERE code IS NULL) OVER (PARTITION BY email) THEN 'EMAIL_CONFLICT' ELSE 'made' END) AS outcome FROM j""")
def _(d: Domain) -> DataFrame:
    names = _users(d).select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("k"), F.col("email").alias("mail"))
    rows = d.event.join(names, num() % 25 == F.col("k"))
    asked = rows.select(num().alias("seq"), F.concat(F.lit("x"), num().cast("string")).alias("id"), F.concat(F.lit("u_"), (num() % 25).cast("string")).alias("by"), F.when(num() % 4 == 0, F.col("mail")).otherwise(F.concat(F.lit("r"), (num() % 300).cast("string"), F.lit("@x.org"))).alias("email"), F.lit("n").alias("full_name"), F.lit("medico").alias("role"))
    new, _, rejects = commands.register(_users(d), asked)
    return sets.bag(new.select("seq", F.lit("made").alias("outcome")), rejects.select("seq", F.col("code").alias("outcome")))


# Uploads


@query("t07_repaired_chunks", "SELECT device_id, batch_timestamp, CAST(1 AS BIGINT) AS chunk_index FROM batch UNION ALL SELECT device_id, batch_timestamp, 0 FROM batch WHERE num_samples % 2 = 1")
def _(d: Domain) -> DataFrame:
    chunk = lambda rows, k: rows.withColumn("chunk_index", F.lit(k).cast("int"))
    stored = ingest.timed(chunk(d.batch.filter("num_samples % 2 = 0"), None))
    late = ingest.timed(sets.bag(chunk(d.batch, 0), chunk(d.batch, 1), chunk(d.batch, 1)))
    return timed(ingest.repair(stored, late).select("device_id", "batch_timestamp", "chunk_index"))


@query("t10_rolling", "SELECT device_id, (batch_timestamp - o * 3600) * 1000 AS start, count(*) AS batches, CAST(sum(num_samples) AS BIGINT) AS samples FROM (SELECT *, unnest(range(24)) AS o FROM batch) GROUP BY ALL")
def _(d: Domain) -> DataFrame:
    return timed(ingest.rolling(d.batch).select("device_id", F.col("window.start").alias("start"), "batches", "samples"))


@query("t12_silent", f"SELECT device_id, (epoch_us(last) // 1000) AS last_seen_at, (epoch_us(last + INTERVAL 10 HOUR) // 1000) AS silent_since FROM (SELECT device_id, make_timestamp(max(batch_timestamp) * 1000000) AS last FROM batch GROUP BY device_id) WHERE last + INTERVAL 10 HOUR < TIMESTAMP '{AS_OF}'")
def _(d: Domain) -> DataFrame:
    return timed(status.silent(d.batch, AS_OF))


@query("t14_reassembled", "SELECT id, CASE WHEN num_samples % 4 <> 0 THEN 'a' || id || 'b' || id END AS data, CASE WHEN num_samples % 4 = 0 THEN 1 END AS have FROM batch")
def _(d: Domain) -> DataFrame:
    whole = d.batch.select("id", "device_id", "batch_timestamp", "duration_seconds", "sample_rate", "num_channels", "num_samples", "compression_type", F.lit(2).alias("total_chunks"))
    part = lambda k: whole.withColumn("chunk_index", F.lit(k)).withColumn("data", F.concat(F.lit("ab"[k]), "id"))
    chunks = sets.bag(part(1).filter("num_samples % 4 <> 0"), part(0), part(0))
    found = ingest.reassembled(chunks).select(*ingest.KEY, "data", F.lit(None).cast("int").alias("have"))
    lacking = ingest.incomplete(chunks).select(*ingest.KEY, F.lit(None).cast("string").alias("data"), "have")
    return timed(d.batch.select("id", *ingest.KEY).join(sets.bag(found, lacking), ingest.KEY).select("id", "data", "have"))


@query("s13_batch_keys", "SELECT id, 'ecg/' || device_id || '/' || strftime(make_timestamp(batch_timestamp * 1000000), '%Y-%m-%d') || '/' || batch_timestamp || '.bin' AS key FROM batch")
def _(d: Domain) -> DataFrame:
    return d.batch.select("id", tables.batch_key().alias("key"))


@query("s10_audit_sink", "SELECT id, user_id, event_type FROM audit UNION ALL SELECT id, user_id, event_type FROM audit WHERE event_type = 'LOGOUT'")
def _(d: Domain) -> DataFrame:
    rows = d.audit.withColumns({"updated_at": F.col("created_at"), "deleted_at": F.lit(None).cast("timestamp")})
    folder = scratch.folder(rows.sparkSession)
    tables.append_audit(rows, folder)
    tables.append_audit(rows.filter("event_type = 'LOGOUT'"), folder)
    return tables.scan(rows.sparkSession, folder, "audit_event").select("id", "user_id", "event_type")


@query("s14_csv_export", "SELECT id, full_name, dni FROM (SELECT id, first_name || ' ' || last_name AS full_name, dni FROM live_patient)")
def _(d: Domain) -> DataFrame:
    rows = live(d.patient).select("id", F.concat_ws(" ", "first_name", "last_name").alias("full_name"), "dni")
    folder = scratch.folder(rows.sparkSession)
    tables.export_csv(rows, folder)
    return rows.sparkSession.read.schema("id string, full_name string, dni string").option("header", True).csv(folder)


@query("s05_checked_blobs", "SELECT id, CASE WHEN number % 3 <> 1 THEN 'SIGNAL_CORRUPT' END AS code FROM event")
def _(d: Domain) -> DataFrame:
    blobs = d.event.select("id", F.unhex(F.md5("id")).alias("content"), (3 + num() % 3).alias("sample_count"))
    whole, corrupt = signals.checked_blobs(blobs)
    return sets.bag(whole.select("id", F.lit(None).cast("string").alias("code")), corrupt.select("id", "code"))


# Payloads


def _payloads(d: Domain) -> DataFrame:
    """Each vector as an upload: integers of 16 bits, as deltas or raw, over one or two channels; every tenth is damaged."""
    k = _number("study_id")
    channels = F.when(k % 3 == 0, 2).otherwise(1)
    x = F.transform("samples", lambda v: F.floor((v * 100).cast("float")).cast("bigint"))  # the product in 32 bits, as the oracle has it
    delta = F.transform("x", lambda v, i: F.when(i < F.col("num_channels"), v).otherwise(v - F.get("x", i - F.col("num_channels"))))
    low = lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(65535))), 4, "0")
    rows = d.signal.select(F.col("study_id").alias("id"), k.alias("k"), channels.alias("num_channels"), F.slice(x, F.lit(1), (F.floor(F.size("samples") / 2) * 2).cast("int")).alias("x"), F.when(k % 2 == 0, "raw").otherwise("delta").alias("compression_type"))
    words = F.transform(F.when(F.col("compression_type") == "raw", F.col("x")).otherwise(delta), lambda v: F.concat(F.substring(low(v), 3, 2), F.substring(low(v), 1, 2)))
    data = F.when(F.col("k") % 10 == 0, "no base64!").otherwise(F.base64(F.unhex(F.array_join(words, ""))))
    # base64 breaks its lines
    return rows.select("id", "num_channels", "compression_type", F.lit(250).alias("sample_rate"), F.regexp_replace(data, r"\r\n", "").alias("data"))


@query("g16_payloads", """, x AS (SELECT 'v_' || vec_id AS id, vec_id AS k, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS ch, i, CAST(floor(CAST(embedding[i + 1] AS FLOAT) * 100) AS BIGINT) AS v FROM (SELECT *, unnest(range(len(embedding) // 2 * 2)) AS i FROM embeddings))
SELECT id, CAST(i % ch AS BIGINT) AS channel, count(*) AS n, CAST(sum(v) AS DOUBLE) / 2 AS total, CAST(sum(v * (i // ch)) AS DOUBLE) / 2 AS weighted, FALSE AS failed FROM x WHERE k % 10 <> 0 GROUP BY id, i % ch UNION ALL SELECT DISTINCT id, NULL, 0, NULL, NULL, TRUE FROM x WHERE k % 10 = 0""")
def _(d: Domain) -> DataFrame:
    decoded = signals.decode_batches(_payloads(d), scale=0.5)
    rows = decoded.select("batch_id", F.col("channel").cast("bigint").alias("channel"), F.col("error").isNotNull().alias("failed"), F.posexplode_outer("samples").alias("p", "v"))
    out = rows.groupBy(F.col("batch_id").alias("id"), "channel", "failed").agg(F.count("v").alias("n"), F.sum(F.col("v").cast("double")).alias("total"), F.sum(F.col("v").cast("double") * F.col("p")).alias("weighted"))
    return out.select("id", "channel", "n", "total", "weighted", "failed")


@query("c21_batch_statuses", "SELECT 'v_' || vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'FAILED' ELSE 'DONE' END AS processing_status, vec_id % 10 = 0 AS has_error FROM embeddings")
def _(d: Domain) -> DataFrame:
    batches = _payloads(d)
    return rhythm.process(batches, signals.decode_batches(batches))[1].select("id", "processing_status", F.col("processing_error").isNotNull().alias("has_error"))


@query("c21_classified", f""", {_BEATS}, f AS (SELECT *, COALESCE(rr_ms > 1000, FALSE) AS flag FROM beats), g AS (SELECT *, CASE WHEN flag = lag(flag) OVER w THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY device_id ORDER BY t_ms)), i AS (SELECT *, sum(ch) OVER (PARTITION BY device_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS island FROM g),
r AS (SELECT device_id, min(t_ms - COALESCE(rr_ms, 0)) AS a, max(t_ms) AS b FROM i WHERE flag GROUP BY device_id, island HAVING max(t_ms) - min(t_ms - COALESCE(rr_ms, 0)) >= 30000)
SELECT device_id, 'BRADYCARDIA' AS event_type, CASE WHEN b - a >= 120000 THEN 'HIGH' ELSE 'LOW' END AS severity, round(a / 1000, 3) AS at_s, round((b - a) / 1000, 3) AS lasted_s FROM r
UNION ALL SELECT device_id, 'PAUSE', CASE WHEN rr_ms > 3000 THEN 'CRITICAL' ELSE 'HIGH' END, round((t_ms - rr_ms) / 1000, 3), round(rr_ms / 1000, 3) FROM beats WHERE rr_ms > 2000
UNION ALL SELECT e.device_id, 'PVC', 'MEDIUM', round((epoch_us(e.moment) // 1000) / 1000, 3), NULL FROM event e JOIN (SELECT device_id, avg(value) AS m, stddev_samp(value) AS s FROM event GROUP BY device_id) s USING (device_id) WHERE s.s > 0 AND abs((e.value - s.m) / s.s) > 2.5""")
def _(d: Domain) -> DataFrame:
    beats = d.event.select("device_id", ms("at").alias("t_ms"), F.col("value").alias("amplitude"))
    found = rhythm.classify(beats, "device_id").filter("event_type <> 'TACHYCARDIA'")
    return found.select("device_id", "event_type", "severity", rounded(F.col("timestamp_in_recording"), 3).alias("at_s"), rounded(F.col("duration_seconds"), 3).alias("lasted_s"))


@query("g24_non_diagnostic", ", s AS (SELECT device_id, number, row_number() OVER (PARTITION BY device_id ORDER BY number) AS n, number % 5 < 2 AS bad FROM event), i AS (SELECT *, n - row_number() OVER (PARTITION BY device_id, bad ORDER BY number) AS g FROM s) SELECT device_id, round(min(number) / 500e0, 6) AS start_s, round((max(number) + 1) / 500e0, 6) AS end_s, count(*) AS frames FROM i WHERE bad GROUP BY device_id, g")
def _(d: Domain) -> DataFrame:
    frames = d.event.select("device_id", num().alias("frame"), F.when(num() % 5 < 2, "C00001").otherwise("C00000").alias("status"))
    return rhythm.non_diagnostic(frames, "C00000", "device_id").select("device_id", rounded(F.col("start_s"), 6).alias("start_s"), rounded(F.col("end_s"), 6).alias("end_s"), "frames")
