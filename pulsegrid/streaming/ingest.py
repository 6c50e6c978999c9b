"""Hourly uploads as a stream: at-least-once, up to two days late.

Event time is the batch's own timestamp.  Duplicates are dropped within the watermark; what is older than that goes to
a repair path, where ``repair`` merges it in batch; what has no usable key, or is no JSON, goes to a quarantine with the
reason.  So every landed row is stored, waits for repair, is quarantined, or repeats one that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schemas

LATE = "48 hours"
FILES_PER_TRIGGER = 5
KEY = ["device_id", "batch_timestamp"]


#: Column of what could not be read as JSON of the schema.
CORRUPT = "_corrupt_record"


def uploads(spark: SparkSession, path: str, *, nested: bool = False, files: int = FILES_PER_TRIGGER, corrupt: bool = False) -> DataFrame:
    """Landed JSON payloads, oldest first, ``files`` per trigger; with ``corrupt``, a line that is none keeps its text."""
    schema = schemas.UPLOAD_NESTED if nested else schemas.UPLOAD_FLAT
    reader = spark.readStream.option("maxFilesPerTrigger", files)
    if corrupt:
        schema, reader = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def flat(payloads: DataFrame) -> DataFrame:
    """One row per batch, from either form of payload; a nested payload without a batch keeps one row, without its fields."""
    kept = [CORRUPT] if CORRUPT in payloads.columns else []
    if "batch" in payloads.columns:
        rows = payloads.withColumn("b", F.explode_outer("batch"))
        return rows.select("device_id", F.col("b.timestamp").alias("batch_timestamp"), F.col("b.duration_sec").alias("duration_seconds"), F.col("b.sample_rate").alias("sample_rate"), F.lit(3).alias("num_channels"), F.col("b.num_samples").alias("num_samples"), F.col("b.compression").alias("compression_type"), "battery_pct", "sd_free_mb", "firmware_version", F.col("b.data_b64").alias("data"), "chunk_index", "total_chunks", *kept)
    return payloads.select(*schemas.UPLOAD_FLAT.fieldNames(), *kept)


def fault(batches: DataFrame) -> Column:
    """Why a row cannot be stored, or null: UNREADABLE, NO_DEVICE, NO_TIMESTAMP or NO_DATA, the first that holds."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    unreadable = F.col(CORRUPT).isNotNull() if CORRUPT in batches.columns else F.lit(False)
    return F.when(unreadable, "UNREADABLE").when(blank("device_id"), "NO_DEVICE").when(F.col("batch_timestamp").isNull(), "NO_TIMESTAMP").when(blank("data"), "NO_DATA")


def routed(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, the others with their ``reason``); together all rows."""
    marked = batches.withColumn("reason", fault(batches))
    return marked.filter("reason is null").drop("reason", CORRUPT), marked.filter("reason is not null")


def timed(batches: DataFrame) -> DataFrame:
    return batches.withColumn("event_time", F.timestamp_seconds("batch_timestamp"))


def deduplicated(batches: DataFrame, *, late: str = LATE) -> DataFrame:
    """Each (device, timestamp, chunk) once, within the watermark; batch and streaming alike."""
    keyed = batches.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0)))
    if batches.isStreaming:
        return keyed.withWatermark("event_time", late).dropDuplicatesWithinWatermark([*KEY, "chunk_index"])
    return keyed.dropDuplicates([*KEY, "chunk_index"])


def reassembled(chunks: DataFrame) -> DataFrame:
    """Whole batches from their chunks; a batch that lacks a chunk is left out (see ``incomplete``)."""
    per = _gathered(chunks)
    return per.filter(F.size("parts") == F.col("total_chunks")).withColumn("data", F.array_join(F.transform("parts", lambda p: p["data"]), "")).drop("parts")


def incomplete(chunks: DataFrame) -> DataFrame:
    per = _gathered(chunks)
    return per.filter(F.size("parts") != F.col("total_chunks")).select(*KEY, F.size("parts").alias("have"), "total_chunks")


def _gathered(chunks: DataFrame) -> DataFrame:
    once = chunks.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0))).dropDuplicates([*KEY, "chunk_index"])
    same = ["duration_seconds", "sample_rate", "num_channels", "num_samples", "compression_type"]
    return once.groupBy(*KEY).agg(*[F.first(c, ignorenulls=True).alias(c) for c in same], F.max(F.coalesce("total_chunks", F.lit(1))).alias("total_chunks"), F.sort_array(F.collect_list(F.struct("chunk_index", "data"))).alias("parts"))


def write_stream(batches: DataFrame, path: str, checkpoint: str, *, repair_path: str | None = None, quarantine_path: str | None = None, late_hours: int = 48, every: str | None = None):
    """Append deduplicated batches by device and day.

    With ``repair_path``, rows older than ``late_hours`` before the newest of their micro-batch go there instead of being
    dropped by the watermark, rows with a ``fault`` go to ``quarantine_path`` (by default beside the repair path) with its
    reason, and rows that are stored already are left out by their keys.  Each micro-batch has folders of its own in both
    side paths, so a repeated one stores nothing twice anywhere.  ``every`` is a processing-time trigger; without it, all
    that is there is read once.
    """
    if repair_path is not None:
        aside = quarantine_path or f"{repair_path.rstrip('/')}-quarantine"

        def split(df: DataFrame, number: int) -> None:
            df = df.persist()
            own = f"run={query_id(df.sparkSession, checkpoint)}/batch={number}"
            good, bad = routed(df)
            bad.write.mode("overwrite").parquet(f"{aside}/{own}")
            good = timed(good)
            newest = good.agg(F.max("event_time")).first()[0]
            if newest is not None:
                old = F.col("event_time") < F.lit(newest) - F.expr(f"INTERVAL {late_hours} HOURS")
                good.filter(old).write.mode("overwrite").parquet(f"{repair_path}/{own}")
                new = deduplicated(good.filter(~old)).withColumn("date", F.to_date("event_time"))
                if _exists(df.sparkSession, path):
                    new = new.join(_stored(good.filter(~old), df.sparkSession.read.schema(new.schema).parquet(path)), [*KEY, "date", "chunk_index"], "left_anti")
                new.write.mode("append").partitionBy("device_id", "date").parquet(path)
            df.unpersist()

        writer = batches.writeStream.foreachBatch(split)
    else:
        out = deduplicated(timed(batches)).withColumn("date", F.to_date("event_time"))
        writer = out.writeStream.format("parquet").option("path", path).partitionBy("device_id", "date").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query for all its runs; another checkpoint counts its micro-batches anew."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _stored(batch: DataFrame, store: DataFrame, devices: int = 500) -> DataFrame:
    """Keys of the part of the store that a micro-batch can repeat: its days, and its devices if they are few."""
    days = batch.agg(F.min(F.to_date("event_time")).alias("lo"), F.max(F.to_date("event_time")).alias("hi")).first()
    part = store.filter(F.col("date").between(F.lit(days["lo"]), F.lit(days["hi"])))
    few = [r[0] for r in batch.select("device_id").distinct().limit(devices + 1).collect()]
    if len(few) <= devices:
        part = part.filter(F.col("device_id").isin(*few))
    return part.select(*KEY, "date", "chunk_index")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def repair(stored: DataFrame, late: DataFrame) -> DataFrame:
    """Chunks of the repair path that are not stored yet, each once; a chunk without an index is chunk 0."""
    late = deduplicated(late)
    have = stored.select(*KEY, F.coalesce("chunk_index", F.lit(0)).alias("chunk_index")).distinct()
    return late.join(have, [*KEY, "chunk_index"], "left_anti")


def hourly(batches: DataFrame) -> DataFrame:
    """Uploads and bytes per device and hour of event time."""
    rows = batches if "event_time" in batches.columns else timed(batches)
    rows = rows.withWatermark("event_time", LATE) if rows.isStreaming else rows
    return rows.groupBy("device_id", F.window("event_time", "1 hour")).agg(F.count("*").alias("batches"), F.sum(F.length("data")).alias("bytes"))


def rolling(batches: DataFrame, hours: int = 24) -> DataFrame:
    """Sliding windows of ``hours``, one every hour."""
    rows = batches if "event_time" in batches.columns else timed(batches)
    rows = rows.withWatermark("event_time", LATE) if rows.isStreaming else rows
    return rows.groupBy("device_id", F.window("event_time", f"{hours} hours", "1 hour")).agg(F.count("*").alias("batches"), F.sum("num_samples").alias("samples"))


def sessions(batches: DataFrame, gap: str = "90 minutes") -> DataFrame:
    """Stretches of uploads without a longer gap."""
    rows = batches if "event_time" in batches.columns else timed(batches)
    rows = rows.withWatermark("event_time", LATE) if rows.isStreaming else rows
    return rows.groupBy("device_id", F.session_window("event_time", gap)).agg(F.count("*").alias("batches"))
