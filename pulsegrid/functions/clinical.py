"""Bands, deltas, trends and other clinical scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORAGE_TOTAL_MB = 128
STALE_HOURS = 10
LOW_BATTERY = 45


def storage_used(free: Column, total: int = STORAGE_TOTAL_MB) -> Column:
    """total - free, at least 0; unknown free space counts as all free."""
    return F.greatest(F.lit(total) - F.coalesce(free, F.lit(total)), F.lit(0))


def storage_percent(used: Column, total: Column) -> Column:
    return F.floor(used / total * 100 + 0.5).cast("int")


def battery_band(percent: Column) -> Column:
    """struct(label, variant)."""
    pick = lambda a, b, c: F.when(percent >= 50, F.lit(a)).when(percent >= 20, F.lit(b)).otherwise(F.lit(c))
    return F.struct(pick("OK", "Baja", "Crítica").alias("label"), pick("success", "warning", "destructive").alias("variant"))


def signal_band(dbm: Column) -> Column:
    return F.when(dbm > -70, F.lit("good")).when(dbm > -85, F.lit("fair")).when(dbm > -100, F.lit("poor")).otherwise(F.lit("none"))


def trend(delta: Column) -> Column:
    return F.when(delta > 0, F.lit("up")).when(delta < 0, F.lit("down")).otherwise(F.lit("flat"))


def delta_text(value: Column, suffix: str) -> Column:
    """A signed delta with a true minus sign; zero is no change."""
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit("−"))
    return F.when(value == 0, F.lit("Sin cambios")).otherwise(F.concat(sign, F.abs(value).cast("string"), F.lit(f" {suffix}")))


def delta_period_text(value: Column) -> Column:
    """The same with an ASCII sign, against the period before."""
    return F.concat(F.when(value > 0, F.lit("+")).otherwise(F.lit("")), value.cast("string"), F.lit(" vs. período anterior"))


def watchdog_reason(hours: Column, battery: Column, quality: Column, *, stale: float = STALE_HOURS, low: int = LOW_BATTERY) -> Column:
    """offline before low_battery before poor_signal; null if none holds."""
    return F.when(hours > stale, F.lit("offline")).when(battery < low, F.lit("low_battery")).when(quality.isin("poor", "none"), F.lit("poor_signal"))


def zero_as_missing(hours: Column) -> Column:
    return F.nullif(hours, F.lit(0.0))


def bpm(nn_ms: Column) -> Column:
    return F.lit(60_000.0) / nn_ms


def backoff_ms(attempt: Column) -> Column:
    """1 s doubled per attempt, 8 s at most."""
    return F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempt), F.lit(8000.0)).cast("bigint")
