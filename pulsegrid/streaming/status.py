"""Device status, watchdog and batch states."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pulsegrid.functions import clinical, clock
from pulsegrid.sources.shipping import ship
from pulsegrid.streaming.ingest import query_id, timed


def latest_status(batches: DataFrame) -> DataFrame:
    """Per device the reading of the newest event time; order of arrival and repeats do not matter."""
    rows = batches if "event_time" in batches.columns else timed(batches)
    reading = F.struct("event_time", "battery_pct", "sd_free_mb", "firmware_version")
    best = rows.groupBy("device_id").agg(F.max(reading).alias("r"))
    return best.select("device_id", F.col("r.event_time").alias("last_seen_at"), F.col("r.battery_pct").alias("last_battery_pct"), F.col("r.sd_free_mb").alias("last_sd_free_mb"), F.col("r.firmware_version").alias("firmware_version"))


def fold_status(devices: DataFrame, status: DataFrame) -> DataFrame:
    """Devices with newer readings taken over; older ones change nothing."""
    s = status.select(F.col("device_id").alias("_d"), *[F.col(c).alias(f"_{c}") for c in ("last_seen_at", "last_battery_pct", "last_sd_free_mb", "firmware_version")])
    rows = devices.join(s, F.col("id") == F.col("_d"), "left")
    newer = F.col("_last_seen_at").isNotNull() & (F.col("last_seen_at").isNull() | (F.col("_last_seen_at") > F.col("last_seen_at")))
    take = ("last_seen_at", "last_battery_pct", "last_sd_free_mb", "firmware_version")
    return rows.select(*[(F.when(newer, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) if c in take else F.col(c)).alias(c) for c in devices.columns])


READING = "last_ms bigint, last_battery_pct int, last_sd_free_mb int, firmware_version string"


class LatestReading(StatefulProcessor):
    """One value per device: its newest reading, of those at one time the greatest, as ``latest_status`` has it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", READING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get()) if self.latest.exists() else None
        before = best
        for part in rows:
            for row in part.drop(columns="device_id").itertuples(index=False):
                reading = tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in row)
                if best is None or _order(reading) > _order(best):
                    best = reading
        if best != before:
            self.latest.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["device_id", "last_ms", "last_battery_pct", "last_sd_free_mb", "firmware_version"]).astype({"last_battery_pct": "Int32", "last_sd_free_mb": "Int32"})

    def close(self) -> None:
        pass


def _order(reading: tuple) -> tuple:
    """Nulls first, as in a comparison of structs."""
    return tuple((v is not None, v if v is not None else 0) for v in reading)


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("device_id", F.timestamp_millis("last_ms").alias("last_seen_at"), "last_battery_pct", "last_sd_free_mb", "firmware_version")


def keyed_state(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store, whose changes alone are written; a checkpoint keeps the store it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def status_stream(batches: DataFrame) -> DataFrame:
    """The newest reading of each device whose reading a micro-batch changes, in update mode; rows without a key are left out.

    State and output are one row per device of the micro-batch, whatever the number of devices that are known.
    """
    ship(batches.sparkSession)
    keyed_state(batches.sparkSession)
    rows = batches if "event_time" in batches.columns else timed(batches)
    rows = rows.filter("device_id is not null and event_time is not null")
    rows = rows.select("device_id", F.unix_millis("event_time").alias("last_ms"), F.col("battery_pct").alias("last_battery_pct"), F.col("sd_free_mb").alias("last_sd_free_mb"), "firmware_version")
    return _named(rows.groupBy("device_id").transformWithStateInPandas(LatestReading(), f"device_id string, {READING}", "Update", "None"))


def fold_stream(batches: DataFrame, path: str, checkpoint: str):
    """Keep the newest reading per device as keyed state; the changes of each micro-batch go to a folder of their own below ``path``.

    ``known_status`` reads the state itself.
    """

    def changes(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/run={query_id(df.sparkSession, checkpoint)}/batch={number}")

    writer = status_stream(batches).writeStream.outputMode("update").foreachBatch(changes)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest reading of every device, from the state of ``fold_stream``'s checkpoint; its columns are those of ``latest_status``."""
    state = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return _named(state.select("key.device_id", "value.*"))


def watchdog(devices: DataFrame, as_of: datetime | str, *, quality: str | None = None) -> DataFrame:
    """Assigned devices that are silent, low or badly heard, with the first reason that holds."""
    heard = F.col(quality) if quality else F.when(F.col("last_seen_at").isNotNull(), F.lit("good"))
    rows = devices.filter(F.col("deleted_at").isNull() & (F.col("status") == "assigned"))
    reason = clinical.watchdog_reason(clock.hours_since(F.col("last_seen_at"), as_of), F.col("last_battery_pct"), heard)
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def silent(batches: DataFrame, as_of: datetime | str, hours: float = 10) -> DataFrame:
    """(device_id, last_seen_at, silent_since) of devices whose newest batch is more than ``hours`` before ``as_of``."""
    rows = batches if "event_time" in batches.columns else timed(batches)
    last = rows.groupBy("device_id").agg(F.max("event_time").alias("last_seen_at"))
    since = F.timestamp_micros(F.unix_micros("last_seen_at") + int(hours * 3_600_000_000))
    return last.withColumn("silent_since", since).filter(F.col("silent_since") < clock.at(as_of))


class Silence(StatefulProcessor):
    """The newest time of a device, and a timer that fires ``wait`` milliseconds after it."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["ms"].max()) for part in rows)
        last = self.last.get()[0] if self.last.exists() else None
        if last is None or newest > last:
            if last is not None:
                self.handle.deleteTimer(last + self.wait)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.wait)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()  # a silent device holds no state
        yield pd.DataFrame({"device_id": [key[0]], "last_ms": [last], "since_ms": [last + self.wait]})

    def close(self) -> None:
        pass


def silent_stream(batches: DataFrame, hours: float = 10, *, late: str = "48 hours") -> DataFrame:
    """The same over a stream, in append mode: one row when the watermark passes ``hours`` after a device's newest batch.

    A device that sends again before that gives no row, however long its gap was; one that falls silent again gives
    another row.  The state is one number per device that is not silent, and ends with its timer, so it needs no
    time-to-live.  Times are whole milliseconds since the epoch on the way, so no time zone takes part.
    """
    ship(batches.sparkSession)
    keyed_state(batches.sparkSession)
    rows = batches if "event_time" in batches.columns else timed(batches)
    rows = rows.filter("device_id is not null").withWatermark("event_time", late).select("device_id", "event_time", F.unix_millis("event_time").alias("ms"))
    out = rows.groupBy("device_id").transformWithStateInPandas(Silence(int(hours * 3_600_000)), "device_id string, last_ms bigint, since_ms bigint", "Append", "EventTime")
    return out.select("device_id", F.timestamp_millis("last_ms").alias("last_seen_at"), F.timestamp_millis("since_ms").alias("silent_since"))


def advance(batches: DataFrame, results: DataFrame) -> DataFrame:
    """PENDING or PROCESSING batches take over (id, processing_status, processing_error); DONE and FAILED stay as they are."""
    r = results.select(F.col("id").alias("_b"), F.col("processing_status").alias("_s"), F.col("processing_error").alias("_e"))
    rows = batches.join(r, F.col("id") == F.col("_b"), "left")
    takes = F.col("_s").isNotNull() & F.col("processing_status").isin("PENDING", "PROCESSING")
    changed = {"processing_status": F.when(takes, F.col("_s")).otherwise(F.col("processing_status")), "processing_error": F.when(takes, F.col("_e")).otherwise(F.col("processing_error"))}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in batches.columns])
