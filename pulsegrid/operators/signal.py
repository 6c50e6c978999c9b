"""Sampled signals in chunks: axis, range, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sized(chunks: DataFrame, *keys: str) -> DataFrame:
    """Adds to each chunk the index of its first sample and its signal's number of samples."""
    n = F.sum(F.size("samples").cast("bigint"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("total", n.over(own)).withColumn("first", F.coalesce(n.over(before), F.lit(0).cast("bigint")))


def samples(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, v): the samples of chunks that ``sized`` has seen."""
    return chunks.select(*keys, "total", "first", F.posexplode("samples").alias("_p", "v")).select(*keys, "total", (F.col("first") + F.col("_p")).alias("i"), "v")


def time_axis(rows: DataFrame, rate: Column) -> DataFrame:
    """Adds ``t``, seconds from the start."""
    return rows.withColumn("t", F.col("i") / rate)


def overview(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """Least and greatest value of each of ``width`` columns, and of the whole signal (``lo``, ``hi``).

    A column has max(1, floor(n / width)) samples; empty columns are left out; samples past the last column are in no
    column but do count for the scale, which is widened by one either way for a constant signal.
    """
    per = F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(width)))
    columns = rows.withColumn("col", F.floor(F.col("i") / per).cast("bigint")).groupBy(*keys, "col").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    scale = columns.groupBy(*keys).agg(F.min("mn").alias("_lo"), F.max("mx").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    scale = scale.select(*keys, F.when(flat, F.col("_lo") - 1).otherwise(F.col("_lo")).alias("lo"), F.when(flat, F.col("_hi") + 1).otherwise(F.col("_hi")).alias("hi"))
    return columns.filter(F.col("col") < width).join(scale, list(keys))


def pixels(columns: DataFrame, height: int) -> DataFrame:
    """Adds y_top and y_bottom; a column is half a pixel high at least."""
    scale = F.lit(height - 4) / (F.col("hi") - F.col("lo"))
    top, bottom = 2 + (F.col("hi") - F.col("mx")) * scale, 2 + (F.col("hi") - F.col("mn")) * scale
    return columns.withColumn("y_top", top).withColumn("y_bottom", F.greatest(bottom, top + 0.5))


def time_range(rows: DataFrame, lo_s: Column, hi_s: Column, rate: Column) -> DataFrame:
    """Samples from lo to hi, both included."""
    return rows.filter((F.col("i") >= F.ceil(lo_s * rate)) & (F.col("i") <= F.floor(hi_s * rate)))


def signal_length(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, duration_s) from sample_rate."""
    return chunks.groupBy(*keys).agg(F.sum(F.size("samples")).alias("n"), F.first("sample_rate").alias("_r")).select(*keys, "n", (F.col("n") / F.col("_r")).alias("duration_s"))
