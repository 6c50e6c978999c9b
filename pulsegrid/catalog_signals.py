"""Queries of filters, quality, uploads, zoom, links, stored views and rules, with their oracles."""

from __future__ import annotations

import hashlib
import hmac
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.catalog import Domain, query, rounded
from pulsegrid.catalog_details import _payloads
from pulsegrid.functions import clock, links
from pulsegrid.operators import filters, joins, pyramid, quality, rhythm, validation, views
from pulsegrid.operators.predicates import live
from pulsegrid.sources import scratch
from pulsegrid.sources.bindings import AS_OF
from pulsegrid.streaming import ingest, pipeline

_SECTIONS = filters.Band().sections(250.0)


def _recursion() -> str:
    """One step of each section after the other, from the state that the step before left."""
    inner, x = "SELECT f.study_id, f.i + 1 AS i, e.embedding, CAST(e.embedding[f.i + 2] AS DOUBLE) - CAST(e.embedding[1] AS DOUBLE) AS y, " + ", ".join(f"f.s{k}, f.t{k}" for k in range(len(_SECTIONS))) + " FROM f JOIN signal e USING (study_id) WHERE f.i + 1 < len(e.embedding)", "y"
    for k, (b0, b1, b2, a1, a2) in enumerate(_SECTIONS):
        rest = ", ".join(f"s{j}, t{j}" for j in range(len(_SECTIONS)) if j != k)
        number = lambda v: f"({v!r}::DOUBLE)"
        inner = f"SELECT study_id, i, embedding, o AS y, {number(b1)} * {x} - {number(a1)} * o + t{k} AS s{k}, {number(b2)} * {x} - {number(a2)} * o AS t{k}, {rest} FROM (SELECT *, {number(b0)} * {x} + s{k} AS o FROM ({inner}))"
    states = ", ".join(f"s{k}, t{k}" for k in range(len(_SECTIONS)))
    return f"SELECT study_id, i, y, {states} FROM ({inner})"


@query(
    "g24_clean",
    f""" SELECT study_id, CAST(i AS BIGINT) AS i, round(y, 6) + 0 AS v FROM (
WITH RECURSIVE signal AS (SELECT 'v_' || vec_id AS study_id, embedding FROM embeddings), f AS (
  SELECT study_id, -1 AS i, 0e0 AS y, {", ".join(f"0e0 AS s{k}, 0e0 AS t{k}" for k in range(len(_SECTIONS)))} FROM signal UNION ALL {_recursion()})
SELECT * FROM f WHERE i >= 0)""",
)
def _(d: Domain) -> DataFrame:
    # Each signal in chunks of seven samples, so that the state crosses borders.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / 7).cast("int")), lambda k: F.struct(k.alias("k"), F.slice("samples", k * 7 + 1, F.lit(7)).alias("x")))
    chunks = d.signal.select("study_id", "sample_rate", F.explode(pieces).alias("p")).select("study_id", "sample_rate", F.col("p.k").alias("chunk_index"), F.col("p.x").alias("samples"))
    out = filters.clean(chunks).select("study_id", "chunk_index", F.posexplode("samples").alias("p", "v"))
    return out.select("study_id", (F.col("chunk_index") * 7 + F.col("p")).cast("bigint").alias("i"), rounded(F.col("v"), 6).alias("v"))


@query(
    "g24_lead_off",
    """, w AS (SELECT device_id, number, CAST(('0x' || substr(md5(id), 1, 6)) AS BIGINT) & 1015807 AS w FROM event),
s AS (SELECT *, (w & (1 << 17)) <> 0 OR (w & (1 << 15)) <> 0 AS bad, number - lag(number) OVER (PARTITION BY device_id ORDER BY number) AS step FROM w),
p AS (SELECT *, CASE WHEN bad = lag(bad) OVER (PARTITION BY device_id ORDER BY number) AND step = 1 THEN 0 ELSE 1 END AS ch FROM s),
i AS (SELECT *, sum(ch) OVER (PARTITION BY device_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT device_id, round(min(number) / 500e0, 6) AS start_s, round((max(number) + 1) / 500e0, 6) AS end_s, count(*) AS frames,
  concat_ws(',', CASE WHEN bool_or((w & (1 << 15)) <> 0) THEN 'IN1P' END, CASE WHEN bool_or((w & (1 << 17)) <> 0) THEN 'IN2P' END) AS electrodes FROM i WHERE bad GROUP BY device_id, g""",
)
def _(d: Domain) -> DataFrame:
    word = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint").bitwiseAND(F.lit(1015807))
    frames = d.event.select("device_id", F.col("number").alias("frame"), F.lpad(F.hex(word), 6, "0").alias("status"))
    out = filters.lead_off_segments(frames, "device_id", leads=("IN2P", "IN1P"))
    return out.select("device_id", rounded(F.col("start_s"), 6).alias("start_s"), rounded(F.col("end_s"), 6).alias("end_s"), "frames", F.array_join("electrodes", ",").alias("electrodes"))


@query(
    "a10_chunk_quality",
    """, x AS (SELECT 'v_' || vec_id AS study_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)
SELECT study_id, round(flat, 8) AS flat, round(saturated, 8) AS saturated, round(greatest(0, 1 - flat - saturated), 8) AS quality_score, greatest(0, 1 - flat - saturated) >= 0.66 AS diagnostic FROM (
  SELECT study_id, len(list_filter(range(1, len(x)), lambda i: abs(x[i + 1] - x[i]) <= 0.02)) / (len(x) - 1) AS flat, len(list_filter(x, lambda v: abs(v) >= 0.25)) / len(x) AS saturated FROM x)""",
)
def _(d: Domain) -> DataFrame:
    # 64 samples at 250 a second hold too few beats for a template, so the score is that of the samples.
    out = quality.chunk_quality(d.signal, quality.QualityCuts(flat_step=0.02, saturated=0.25))
    return out.select("study_id", rounded(F.col("flat"), 8).alias("flat"), rounded(F.col("saturated"), 8).alias("saturated"), rounded(F.col("quality_score"), 8).alias("quality_score"), "diagnostic")


@query("t09_hours", "SELECT device_id, (epoch_us(date_trunc('hour', moment)) // 1000) AS hour, count(*) AS batches, CAST(sum(length(props)) AS BIGINT) AS bytes FROM event GROUP BY ALL")
def _(d: Domain) -> DataFrame:
    rows = d.event.select("device_id", F.col("at").alias("event_time"), F.col("metadata").alias("data"))
    return ingest.hourly(rows).select("device_id", F.unix_millis("window.start").alias("hour"), "batches", "bytes")


@query(
    "s12_routed",
    """SELECT CASE WHEN number % 11 = 3 THEN 'UNREADABLE' WHEN number % 7 = 2 THEN 'NO_DEVICE' WHEN number % 5 = 1 THEN 'NO_TIMESTAMP' WHEN number % 13 = 4 THEN 'NO_DATA' ELSE 'STORED' END AS reason,
  count(*) AS n, CAST(sum(number) AS BIGINT) AS total FROM event GROUP BY ALL""",
)
def _(d: Domain) -> DataFrame:
    k = F.col("number")
    rows = d.event.select(
        "number", F.when(k % 7 == 2, F.when(k % 2 == 0, " ")).otherwise(F.col("device_id")).alias("device_id"), F.when(k % 5 != 1, F.col("batch_timestamp")).alias("batch_timestamp"),
        F.when(k % 13 != 4, F.col("metadata")).otherwise("").alias("data"), F.when(k % 11 == 3, "{").alias(ingest.CORRUPT),
    )
    good, bad = ingest.routed(rows)
    both = good.select("number", F.lit("STORED").alias("reason")).unionByName(bad.select("number", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


@query("c21_exactly_once", "SELECT 'v_' || vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'FAILED' ELSE 'DONE' END AS processing_status, vec_id % 10 = 0 AS has_error, CAST(1 AS BIGINT) AS results FROM embeddings")
def _(d: Domain) -> DataFrame:
    """Every payload through the pipeline in two micro-batches that share rows, the second twice."""
    rows = _payloads(d).withColumns({"device_id": F.lit("d_1"), "batch_timestamp": F.regexp_extract("id", "[0-9]+", 0).cast("bigint")})
    folder, k = scratch.folder(d.event.sparkSession), F.col("batch_timestamp")
    for number, part in ((0, k % 3 < 2), (1, k % 3 > 0), (1, k % 3 > 0)):
        pipeline.commit(rows.filter(part), d.device, d.patient, folder, "query", number)
    seen = pipeline.committed(d.event.sparkSession, folder, pipeline.RESULTS).groupBy("id").agg(F.count("*").alias("results"))
    return pipeline.batch_states(rows, folder).join(seen, "id").select("id", "processing_status", F.col("processing_error").isNotNull().alias("has_error"), "results")


_BEATS = "b AS (SELECT user_id % 5 AS g, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events), r AS (SELECT *, CASE WHEN n // 100 % 2 = 0 THEN 400 + event_id % 150 ELSE 700 END AS step FROM b), t AS (SELECT *, CAST(sum(step) OVER (PARTITION BY g ORDER BY n ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS t_ms FROM r)"


@query(
    "c21_tachycardia",
    f""", {_BEATS}, f AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY g ORDER BY t_ms) AS rr FROM t), m AS (SELECT *, COALESCE(60000e0 / rr > 100, FALSE) AS fast FROM f),
i AS (SELECT *, n - row_number() OVER (PARTITION BY g, fast ORDER BY n) AS island FROM m)
SELECT 'g_' || g AS signal, CASE WHEN max(t_ms) - min(t_ms - rr) >= 120000 THEN 'HIGH' ELSE 'LOW' END AS severity, round(min(t_ms - rr) / 1000, 3) AS at_s, round((max(t_ms) - min(t_ms - rr)) / 1000, 3) AS lasted_s
FROM i WHERE fast GROUP BY g, island HAVING max(t_ms) - min(t_ms - rr) >= 30000""",
)
def _(d: Domain) -> DataFrame:
    """Beats of five signals, a hundred of them fast, then a hundred slower ones."""
    g = F.regexp_extract("device_id", "[0-9]+", 0).cast("bigint") % 5
    order = Window.partitionBy("g").orderBy("number")
    rows = d.event.select(g.alias("g"), "number").withColumn("n", F.row_number().over(order))
    step = F.when(F.floor(F.col("n") / 100) % 2 == 0, 400 + F.col("number") % 150).otherwise(700)
    rows = rows.withColumn("t_ms", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    beats = rows.select(F.concat(F.lit("g_"), F.col("g").cast("string")).alias("signal"), "t_ms", F.lit(1.0).alias("amplitude"))
    found = rhythm.classify(beats, "signal").filter("event_type = 'TACHYCARDIA'")
    return found.select("signal", "severity", rounded(F.col("timestamp_in_recording"), 3).alias("at_s"), rounded(F.col("duration_seconds"), 3).alias("lasted_s"))


@query(
    "g02_zoom",
    """ SELECT 'v_' || vec_id AS study_id, CAST((i - 5) // 18 AS BIGINT) AS col, CAST(min(embedding[i + 1]) AS DOUBLE) AS mn, CAST(max(embedding[i + 1]) AS DOUBLE) AS mx FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)
WHERE i BETWEEN 5 AND 58 GROUP BY ALL""",
)
def _(d: Domain) -> DataFrame:
    """Samples 5 to 58 in three columns of eighteen, from the stored tree of every signal."""
    nodes = scratch.kept(pyramid.tree(d.signal, "study_id"))
    return pyramid.zoom(nodes, 5, 59, 3, "study_id").select("study_id", "col", *[F.col(c).cast("double").alias(c) for c in ("mn", "mx")])


_SIGNING_KEY = b"AWS4secret"
for _part in ("20240131", "sa-east-1", "s3", "aws4_request"):
    _SIGNING_KEY = hmac.new(_SIGNING_KEY, _part.encode(), hashlib.sha256).digest()
_PADS = ["".join(f"{b ^ pad:02x}" for b in _SIGNING_KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_LINK = "X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Credential=key%2F20240131%2Fsa-east-1%2Fs3%2Faws4_request&X-Amz-Date=20240131T000000Z&X-Amz-Expires=3600&X-Amz-SignedHeaders=host"


@query(
    "s04_signed_links",
    f""", r AS (SELECT id, 'GET' || chr(10) || '/' || ecg_s3_key || chr(10) || '{_LINK}' || chr(10) || 'host:ecg.example.com' || chr(10) || chr(10) || 'host' || chr(10) || 'UNSIGNED-PAYLOAD' AS request, ecg_s3_key FROM live_study),
m AS (SELECT *, 'AWS4-HMAC-SHA256' || chr(10) || '20240131T000000Z' || chr(10) || '20240131/sa-east-1/s3/aws4_request' || chr(10) || sha256(request) AS message FROM r)
SELECT id, 'https://ecg.example.com/' || ecg_s3_key || '?{_LINK}&X-Amz-Signature=' || sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(message)))) AS link FROM m""",
)
def _(d: Domain) -> DataFrame:
    """All links are of one day, whose key is derived once, in a table of one row that each task gets."""
    at = F.lit(AS_OF).cast("timestamp")
    days = scratch.kept(d.event.sparkSession.range(1).select(links.signing_pads(at, "sa-east-1", F.lit("secret")).alias("pads")))
    link = links.signed_link(F.col("ecg_s3_key"), at, host="ecg.example.com", region="sa-east-1", access_key="key", pads=F.col("pads"))
    return live(d.study).crossJoin(F.broadcast(days)).select("id", link.alias("link"))


@query(
    "t04_refreshed",
    """, d2 AS (SELECT id, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 15 <> 1 AND status = 'assigned' THEN patient_id END AS patient_id FROM live_device)
SELECT p.id, min(d2.id) AS assigned_device_id, p.email AS contact FROM patient p LEFT JOIN d2 ON d2.patient_id = p.id GROUP BY p.id, p.email""",
)
def _(d: Domain) -> DataFrame:
    """The stored page of patients and devices, after every fifteenth device was given back."""
    spark, path = d.event.sparkSession, scratch.folder(d.event.sparkSession)
    patients, old = d.patient, d.device
    gone = F.substring("id", 3, 20).cast("bigint") % 15 == 1
    new = old.withColumn("patient_id", F.when(~gone, F.col("patient_id"))).withColumn("status", F.when(gone & (F.col("status") == "assigned"), "available").otherwise(F.col("status")))
    page = lambda devices: lambda keep: joins.with_assigned_device(keep(patients, "id"), keep(devices, "patient_id")).select("id", "assigned_device_id", F.col("email").alias("contact"))
    views.build(spark, page(old), "id", path)
    views.refresh(spark, page(new), "id", path, [(patients, patients, "id"), (old, new, "patient_id")])
    return views.stored(spark, path)


@query(
    "v01_rules",
    f""", f AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'A ' WHEN 2 THEN repeat('x', 241) ELSE c_name END AS full_name,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '1234567' WHEN 2 THEN ' 12345678 ' WHEN 3 THEN '1234567x' ELSE repeat('9', 51) END AS dni,
  CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '1900-12-31' WHEN 3 THEN '1901-01-01' WHEN 4 THEN '2024-02-01' WHEN 5 THEN '2024-01-31' WHEN 6 THEN '2023-02-29' ELSE '1980-05-06' END AS birth_date,
  CASE c_custkey % 4 WHEN 0 THEN 'Q' WHEN 1 THEN NULL ELSE 'F' END AS sex,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a@b' WHEN 3 THEN 'a.b+c@ex-ample.com.ar' WHEN 4 THEN '@x.com' WHEN 5 THEN repeat('m', 315) || '@x.com' ELSE 'a@b.co' END AS email FROM customer)
SELECT k, concat_ws(',', CASE WHEN length(trim(full_name)) < 2 THEN 'name' END, CASE WHEN dni IS NULL OR NOT regexp_full_match(trim(dni), '[0-9]{{8}}') THEN 'dni' END,
  CASE WHEN TRY_CAST(birth_date AS DATE) IS NULL OR TRY_CAST(birth_date AS DATE) < DATE '1901-01-01' OR TRY_CAST(birth_date AS DATE) > DATE '{AS_OF[:10]}' THEN 'birth_date' END,
  CASE WHEN sex IS NULL OR sex = 'Q' THEN 'sex' END, CASE WHEN email IN ('a@b', '@x.com') THEN 'email' END) AS form,
  concat_ws(',', CASE WHEN length(full_name) NOT BETWEEN 1 AND 240 THEN 'full_name_length' END, CASE WHEN dni IS NULL OR length(dni) > 50 THEN 'dni_length' END, CASE WHEN birth_date IS NULL THEN 'birth_date' END,
  CASE WHEN sex IS NULL OR sex = 'Q' THEN 'sex' END, CASE WHEN length(email) > 320 THEN 'email_length' END) AS service FROM f""",
)
def _(d: Domain) -> DataFrame:
    """Rows that break every rule of patients, one by one and together."""
    k = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    pick = lambda by, values, other: reduce(lambda c, v: c.when(k % by == v[0], v[1]), enumerate(values[1:], 1), F.when(k % by == 0, values[0])).otherwise(other)
    rows = d.patient.select(
        k.alias("k"), pick(7, [" ", "A ", "x" * 241], F.concat_ws("#", "first_name", "last_name")).alias("full_name"), pick(5, [None, "1234567", " 12345678 ", "1234567x"], "9" * 51).alias("dni"),
        pick(11, [None, "soon", "1900-12-31", "1901-01-01", "2024-02-01", "2024-01-31", "2023-02-29"], "1980-05-06").alias("birth_date"), pick(4, ["Q", None], "F").alias("sex"),
        pick(9, [None, "", "a@b", "a.b+c@ex-ample.com.ar", "@x.com", "m" * 315 + "@x.com"], "a@b.co").alias("contact_email"), F.lit(None).cast("string").alias("contact_phone"),
    )
    named = lambda rules: F.array_join(validation.broken(rules), ",")
    return rows.select("k", named(validation.patient_form_rules(AS_OF)).alias("form"), named(validation.patient_rules()).alias("service"))


@query("x12_epoch_ms", "SELECT number, CAST(number * 250 + 1700000000000 AS BIGINT) AS at_ms FROM event")
def _(d: Domain) -> DataFrame:
    """Quarters of a second, which binary seconds hold exactly, so the operator's own value is compared."""
    at = F.timestamp_millis(F.col("number") * 250 + 1_700_000_000_000)
    return d.event.select("number", clock.epoch_ms(at).alias("at_ms"))


@query(
    "x37_cookies",
    "SELECT id, 'session=' || id || '; HttpOnly; Max-Age=3600; Path=/; SameSite=' || CASE WHEN number % 2 = 0 THEN 'none; Secure' ELSE 'lax' END AS cookie FROM event",
)
def _(d: Domain) -> DataFrame:
    return d.event.select("id", links.session_cookie("session", F.col("id"), F.col("number") % 2 == 0, 60).alias("cookie"))


@query(
    "p05_one_time_keys",
    f"SELECT id, replace(replace(replace(base64(unhex(sha256(unhex('{(bytes(b ^ 0x5C for b in b'secret'.ljust(64, bytes(1)))).hex()}') || unhex(sha256(unhex('{(bytes(b ^ 0x36 for b in b'secret'.ljust(64, bytes(1)))).hex()}') || encode(id || '|' || serial_number)))))), '+', '-'), '/', '_'), '=', '') AS api_key FROM device",
)
def _(d: Domain) -> DataFrame:
    return d.device.select("id", links.one_time_key(F.lit("secret"), F.col("id"), F.col("serial_number")).alias("api_key"))
