"""Scans with declared schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas


def scan(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """One domain table; the schema is declared, never inferred."""
    return spark.read.schema(schemas.TABLES[entity]).parquet(path)


def scan_jdbc(spark: SparkSession, url: str, entity: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """The same table from a live database; give a numeric key and its bounds to read it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f'"{entity}"')
    for name, value in options.items():
        reader = reader.option(name, value)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def provided(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table; times without a zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """An append sink; rows are never changed in place."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    append(df.select(*schemas.AUDIT_EVENT.fieldNames()), path)


def write_batches(batches: DataFrame, path: str) -> None:
    """Batch payloads laid out by device and day."""
    dated = batches.withColumn("date", F.to_date(F.timestamp_seconds("batch_timestamp")))
    append(dated, path, ("device_id", "date"))


def batch_key(device: str = "device_id", timestamp: str = "batch_timestamp"):
    """The object key of a batch: ecg/device/day/timestamp.bin"""
    day = F.date_format(F.timestamp_seconds(timestamp), "yyyy-MM-dd")
    return F.concat_ws("/", F.lit("ecg"), F.col(device), day, F.concat(F.col(timestamp).cast("string"), F.lit(".bin")))


def export_csv(df: DataFrame, path: str, *, files: int | None = None) -> None:
    """A research export: CSV with a header."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("header", True).csv(path)
