"""Uploaded batches to events and alerts, each once, whatever fails in between.

A micro-batch writes its events, alerts and results into folders of its own, one after the other, and last a row in the
ledger.  Readers take the folders that the ledger lists, so a micro-batch is there whole or not at all; one that failed half
way runs again with the same rows and overwrites what it left.  A batch that is delivered again in a later micro-batch is
known by its id and left out.

States: a batch that was received is PENDING until a micro-batch takes it, PROCESSING until that is in the ledger, then DONE,
or FAILED with the error of its payload.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.joins import event_chain
from pulsegrid.operators.rhythm import alerts_for, lead_beats, process
from pulsegrid.sources.signals import decode_batches
from pulsegrid.streaming.ingest import _exists, query_id

STARTED, EVENTS, ALERTS, RESULTS, LEDGER = "started", "events", "alerts", "results", "ledger"
SCHEMAS = {
    STARTED: "id string",
    EVENTS: "id string, batch_id string, event_type string, severity string, timestamp_in_recording double, duration_seconds double, confidence_score double, metadata string",
    ALERTS: "id string, patient_id string, event_id string, severity string, message string",
    RESULTS: "id string, processing_status string, processing_error string",
    LEDGER: "batches bigint",
}
_OWN = ", run string, batch bigint"


def _table(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """All that was written, committed or not; ``run`` and ``batch`` say by which micro-batch."""
    days = ", date date" if what == RESULTS else ""
    schema, path = SCHEMAS[what] + _OWN + days, f"{folder}/{what}"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def committed(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """Events, alerts or results of the micro-batches in the ledger."""
    ledger = _table(spark, folder, LEDGER).select("run", "batch")
    return _table(spark, folder, what).join(ledger, ["run", "batch"], "left_semi").drop("run", "batch", "date")


def commit(batches: DataFrame, devices: DataFrame, patients: DataFrame, folder: str, run: str, number: int, after: Callable[[str], None] = lambda what: None) -> None:
    """Process one micro-batch of (id, device_id, batch_timestamp, sample_rate, num_channels, compression_type, data).

    Rows without an id are left out, of rows with the same id one counts.  ``after`` is called behind each write.
    """
    spark = batches.sparkSession
    own = f"run={run}/batch={number}"
    if _exists(spark, f"{folder}/{LEDGER}/{own}/_SUCCESS"):
        return

    def write(df: DataFrame, what: str, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{what}/{own}")
        after(what)

    rows = batches.filter("id is not null").dropDuplicates(["id"]).withColumn("date", F.to_date(F.timestamp_seconds(F.coalesce("batch_timestamp", F.lit(0)))))
    days = rows.agg(F.min("date"), F.max("date")).first()
    if days[0] is not None:  # only the days of this micro-batch are read back
        known = _table(spark, folder, RESULTS).filter(F.col("date").between(F.lit(days[0]), F.lit(days[1])))
        known = known.join(_table(spark, folder, LEDGER).select("run", "batch"), ["run", "batch"], "left_semi")
        rows = rows.join(known.select("id"), "id", "left_anti")
    rows = rows.persist()
    decoded = decode_batches(rows).persist()
    beats = lead_beats(rows, decoded).persist()  # each rule reads them
    try:
        write(rows.select("id"), STARTED)
        found, states = process(rows, decoded, beats)
        name = F.sha2(F.concat_ws("|", "batch_id", "event_type", F.col("timestamp_in_recording").cast("string")), 256)
        write(found.select(name.alias("id"), "batch_id", "event_type", "severity", "timestamp_in_recording", "duration_seconds", "confidence_score", F.lit(None).cast("string").alias("metadata")), EVENTS)
        events = spark.read.schema(SCHEMAS[EVENTS]).parquet(f"{folder}/{EVENTS}/{own}")
        alerts = alerts_for(event_chain(events, rows, devices, patients))
        write(alerts.select(F.sha2("event_id", 256).alias("id"), "patient_id", "event_id", "severity", "message"), ALERTS)
        write(states.join(rows.select("id", "date"), "id").select("id", "processing_status", "processing_error", "date"), RESULTS, "date")
        write(rows.agg(F.count("*").alias("batches")), LEDGER)
    finally:
        for held in (beats, decoded, rows):
            held.unpersist()


def process_stream(batches: DataFrame, devices: DataFrame, patients: DataFrame, folder: str, checkpoint: str, *, every: str | None = None, after: Callable[[str], None] = lambda what: None):
    """``commit`` for each micro-batch of a stream of whole batches."""

    def work(df: DataFrame, number: int) -> None:
        commit(df, devices, patients, folder, query_id(df.sparkSession, checkpoint), number, after)

    writer = batches.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_states(received: DataFrame, folder: str) -> DataFrame:
    """(id, processing_status, processing_error) of every received batch."""
    spark = received.sparkSession
    started = _table(spark, folder, STARTED).select("id").distinct().withColumn("_started", F.lit(True))
    rows = received.select("id").distinct().join(started, "id", "left").join(committed(spark, folder, RESULTS), "id", "left")
    return rows.select("id", F.coalesce("processing_status", F.when(F.col("_started"), "PROCESSING").otherwise("PENDING")).alias("processing_status"), "processing_error")
