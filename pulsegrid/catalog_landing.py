"""Queries of what lands as files: laboratory codes, streamed uploads, EDF+ and signals in pieces, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.catalog import Domain, query, rounded
from pulsegrid.operators import rhythm, windows
from pulsegrid.sources import files, scratch, signals
from pulsegrid.streaming import ingest

#: Vectors that make one recording, laid end to end.
PIECES = 50


@query(
    "s08_lab_codes",
    """, h AS (SELECT upper(substr(md5(id), 1, 16)) AS status_hex, '00' || upper(substr(md5(id), 17, 6)) AS code_hex FROM event), c AS (SELECT *, CAST(('0x' || code_hex) AS BIGINT) AS c FROM h)
SELECT status_hex, code_hex, c - CASE WHEN c >= 8388608 THEN 16777216 ELSE 0 END AS code, round((c - CASE WHEN c >= 8388608 THEN 16777216 ELSE 0 END) * 2.4e0 / (6 * 8388607) * 1e6, 2) AS microvolts FROM c""",
)
def _(d: Domain) -> DataFrame:
    """Events as a laboratory's file, with lines that are no data before every seventh row."""
    path, digest = scratch.folder(d.event.sparkSession), F.upper(F.md5("id"))
    line = F.concat(F.substring(digest, 1, 16), F.lit("\t00"), F.substring(digest, 17, 6), F.when(F.col("number") % 2 == 0, ",").otherwise(""))
    head = F.when(F.col("number") % 7 == 0, F.lit("STATUS\tCODE\n")).otherwise("")
    d.event.select(F.concat(head, line).alias("value")).write.text(path)
    out = signals.lab_codes(d.event.sparkSession, path)
    return out.select("status_hex", "code_hex", "code", rounded(F.col("microvolts"), 2).alias("microvolts"))


@query(
    "s12_landed_stream",
    """, r AS (SELECT number, CASE WHEN number % 11 = 3 THEN 'UNREADABLE' WHEN number % 7 = 2 THEN 'NO_DEVICE' WHEN number % 5 = 1 THEN 'NO_TIMESTAMP' WHEN number % 13 = 4 THEN 'NO_DATA' ELSE 'KEPT' END AS state FROM event)
SELECT state, count(*) * CASE WHEN state = 'KEPT' THEN 1 ELSE 2 END AS n, CASE WHEN state = 'KEPT' THEN CAST(sum(number) AS BIGINT) END AS total FROM r GROUP BY state""",
)
def _(d: Domain) -> DataFrame:
    """Every event as a payload that lands twice: what the stream stores or leaves to repair is there once, all else in quarantine."""
    spark, top, k = d.event.sparkSession, scratch.folder(d.event.sparkSession), F.col("number")
    payload = F.struct(
        F.when(k % 7 != 2, F.concat(F.lit("d_"), (k % 2).cast("string"))).alias("device_id"), F.when(k % 5 != 1, k * 20 + 1_700_000_000).alias("batch_timestamp"), F.when(k % 13 != 4, F.col("id")).otherwise(" ").alias("data")
    )
    lines = d.event.select("number", F.when(k % 11 == 3, F.concat(F.lit("{"), F.col("id"))).otherwise(F.to_json(payload)).alias("value"))
    for _ in range(2):
        lines.repartition(4, "number").select("value").write.mode("append").text(f"{top}/in")
    batches = ingest.flat(ingest.uploads(spark, f"{top}/in", corrupt=True))
    ingest.write_stream(batches, f"{top}/stored", f"{top}/checkpoint", repair_path=f"{top}/repair", quarantine_path=f"{top}/quarantine").awaitTermination()
    own = [*ingest.KEY, "chunk_index"]
    stored, late = spark.read.parquet(f"{top}/stored").select(own), spark.read.parquet(f"{top}/repair")
    kept = stored.unionByName(ingest.repair(stored, late).select(own)).select(F.lit("KEPT").alias("state"), ((F.col("batch_timestamp") - 1_700_000_000) / 20).cast("bigint").alias("number"))
    aside = spark.read.parquet(f"{top}/quarantine").select(F.col("reason").alias("state"), F.lit(None).cast("bigint").alias("number"))
    return kept.unionByName(aside).groupBy("state").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


@query(
    "t03_debounced",
    "SELECT device_id, number FROM (SELECT *, lead(moment) OVER (PARTITION BY device_id ORDER BY moment, number) AS later FROM event) WHERE later IS NULL OR epoch_us(later) - epoch_us(moment) >= 21600000000",
)
def _(d: Domain) -> DataFrame:
    return windows.debounced(d.event.select("device_id", "number", "at"), "device_id", ms=6 * 3_600_000).select("device_id", "number")


def _recordings(d: Domain) -> DataFrame:
    """Vectors laid end to end, ``PIECES`` to a recording."""
    k = F.regexp_extract("study_id", "[0-9]+", 0).cast("bigint")
    name = F.concat(F.lit("r_"), F.floor(k / PIECES).cast("string"))
    return d.signal.select(name.alias("study_id"), "sample_rate", (k % PIECES).cast("int").alias("chunk_index"), "samples")


@query(
    "s14_edf_round_trip",
    f""", x AS (SELECT vec_id // {PIECES} AS r, (vec_id % {PIECES}) * 64 + i AS pos, floor(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)),
b AS (SELECT r, pos, 'ECG' AS signal, v FROM x UNION ALL SELECT r, pos, 'Impedance', abs(v) * 2 FROM x)
SELECT 'r_' || r AS study_id, signal, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (pos % 997)) AS BIGINT) AS weighted FROM b GROUP BY r, signal""",
)
def _(d: Domain) -> DataFrame:
    """Recordings of two signals through EDF+ files and back, a vector of 64 samples to a record."""
    spark, path = d.event.sparkSession, scratch.folder(d.event.sparkSession)
    whole = F.transform("samples", lambda v: F.floor(v.cast("double") * 1000).cast("float"))
    rows = _recordings(d).withColumn("samples", whole).withColumn("sample_rate", F.lit(64))
    files.write_edf(rows.withColumn("impedance", F.transform("samples", lambda v: F.abs(v) * 2)), path)
    back = spark.read.format("edfplus").load(path).select("study_id", "signal", "chunk_index", F.posexplode("samples").alias("p", "v"))
    v = F.round("v").cast("bigint")
    at = (F.col("chunk_index") * 64 + F.col("p")) % 997
    return back.groupBy("study_id", "signal").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * at).alias("weighted"))


@query("g20_recorded")
def _(d: Domain) -> DataFrame:
    """R peaks in the given vectors, laid end to end.  Without an oracle: the tests hold it against the detector over each whole recording."""
    out = rhythm.peaks(_recordings(d))
    return out.select("study_id", "i", rounded(F.col("amplitude"), 6).alias("amplitude"))
