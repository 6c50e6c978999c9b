"""Ordered operators over events and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.clinical import trend


def differences(df: DataFrame, value: str, order: str, *keys: str, alias: str = "delta") -> DataFrame:
    """The step from the row before of the same keys; null for a first row."""
    return df.withColumn(alias, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def rr_intervals(peaks: DataFrame, *keys: str, time: str = "t_ms") -> DataFrame:
    """rr_ms between beats and drr_ms between intervals."""
    w = Window.partitionBy(*keys).orderBy(time)
    out = peaks.withColumn("rr_ms", F.col(time) - F.lag(time).over(w))
    return out.withColumn("drr_ms", F.col("rr_ms") - F.lag("rr_ms").over(w))


def cumulative(df: DataFrame, value: str, order: str, *keys: str, alias: str = "sample") -> DataFrame:
    """Running sum in 64 bits, such as decodes deltas."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(alias, F.sum(F.col(value).cast("bigint")).over(w))


def islands(df: DataFrame, flag: Column, order: str, *keys: str) -> DataFrame:
    """Adds ``island``: runs of rows with the same flag are numbered within their keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    changed = F.when(F.col("_f") == F.lag("_f").over(w), 0).otherwise(1)
    return marked.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("flag", F.col("_f")).drop("_c", "_f")


def sustained(beats: DataFrame, flag: Column, least_ms: int, *keys: str, time: str = "t_ms", before: str = "rr_ms") -> DataFrame:
    """Runs of flagged beats that last ``least_ms`` or more: (keys, start_ms, end_ms, duration_ms, beats).

    A run begins where its first beat's interval begins and ends at its last beat; a run of just ``least_ms`` counts.
    """
    runs = islands(beats, flag, time, *keys).filter("flag").groupBy(*keys, "island").agg((F.min(F.col(time) - F.coalesce(F.col(before), F.lit(0)))).alias("start_ms"), F.max(time).alias("end_ms"), F.count("*").alias("beats"))
    return runs.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).filter(F.col("duration_ms") >= least_ms).drop("island")


def outliers(df: DataFrame, value: str, *keys: str, limit: float = 2.5) -> DataFrame:
    """Rows more than ``limit`` sample standard deviations from the mean of their keys, with z."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    return df.join(stats, list(keys)).filter(F.col("_s") > 0).withColumn("z", z).filter(F.abs("z") > limit).drop("_m", "_s")


def gaps(batches: DataFrame, *, slack_s: int = 60) -> DataFrame:
    """Stretches without data per device, from batch_timestamp and duration_seconds (both in seconds)."""
    w = Window.partitionBy("device_id").orderBy("batch_timestamp", "id")
    before = F.max(F.col("batch_timestamp") + F.col("duration_seconds")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = batches.withColumn("gap_start", before).withColumn("gap_seconds", F.col("batch_timestamp") - before)
    return out.filter(F.col("gap_seconds") > slack_s).select("device_id", "gap_start", F.col("batch_timestamp").alias("gap_end"), "gap_seconds")


def baseline_drift(nights: DataFrame, *keys: str, value: str = "value", night: str = "night", over: int = 7) -> DataFrame:
    """A night's mean against the mean of up to ``over`` nights before."""
    per = nights.groupBy(*keys, night).agg(F.avg(value).alias("mean"))
    before = Window.partitionBy(*keys).orderBy(night).rowsBetween(-over, -1)
    return per.withColumn("baseline", F.avg("mean").over(before)).withColumn("drift", F.col("mean") - F.col("baseline"))


def period_delta(df: DataFrame, value: str, period: str, *keys: str) -> DataFrame:
    """Each period's value against the period before, with its trend."""
    delta = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    return df.withColumn("delta", delta).withColumn("trend", F.when(F.col("delta").isNotNull(), trend(F.col("delta"))))


def debounced(inputs: DataFrame, *keys: str, time: str = "at", ms: int = 300) -> DataFrame:
    """The inputs that stand: those not followed by another of the same keys within ``ms``; of equal times the last by all columns."""
    w = Window.partitionBy(*keys).orderBy(time, *[c for c in inputs.columns if c not in (*keys, time)])
    later = F.unix_micros(F.lead(time).over(w)) - F.unix_micros(time)
    return inputs.withColumn("_later", later).filter(F.col("_later").isNull() | (F.col("_later") >= ms * 1000)).drop("_later")
