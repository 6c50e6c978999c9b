"""Durations, ages and times.  ``as_of`` stands for every now()."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def at(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds, cut through the same binary seconds as int(timestamp() * 1000)."""
    return (micros(ts).cast("double") / F.lit(1e6) * F.lit(1000.0)).cast("bigint")


def duration_ms(stored: Column, started: Column, ended: Column) -> Column:
    """The stored duration, else 0 for an open study, else the time between, cut to milliseconds."""
    between = ((micros(ended) - micros(started)).cast("double") / F.lit(1e6) * F.lit(1000.0)).cast("bigint")
    return F.coalesce(stored, F.when(ended.isNull(), F.lit(0)).otherwise(between)).cast("bigint")


def duration_hours(ms: Column, ended: Column) -> Column:
    """Hours to two digits; null for an open study without a stored duration."""
    return F.when((ms == 0) & ended.isNull(), F.lit(None)).otherwise(F.floor((ms * 100 + 1_800_000) / 3_600_000) / F.lit(100.0))


def running_ms(started: Column, as_of: datetime | str | Column) -> Column:
    """Time since the start, at least 0.  For an open study this is not ``duration_ms``, which is 0."""
    return F.greatest(F.lit(0), epoch_ms(at(as_of)) - epoch_ms(started)).cast("bigint")


def hours_since(ts: Column, as_of: datetime | str | Column) -> Column:
    """Hours as a double; never seen is infinity."""
    return F.coalesce((micros(at(as_of)) - micros(ts)) / F.lit(3.6e9), F.lit(float("inf")))


def plus_one_hour(ts: Column) -> Column:
    return ts + F.expr("INTERVAL 1 HOUR")


def age_years(birth: Column, as_of: datetime | str | Column) -> Column:
    """Completed years by month and day; 0 for a missing or unreadable date."""
    day = F.try_to_timestamp(birth.cast("string"), F.lit("yyyy-MM-dd")).cast("date")
    now = at(as_of).cast("date")
    early = (F.month(now) < F.month(day)) | ((F.month(now) == F.month(day)) & (F.dayofmonth(now) < F.dayofmonth(day)))
    return F.coalesce(F.year(now) - F.year(day) - early.cast("int"), F.lit(0))


def relative_time(ts: Column, as_of: datetime | str | Column) -> Column:
    """Minutes, hours, days, months or years from ``as_of``, each rounded by itself."""
    diff = epoch_ms(at(as_of)) - epoch_ms(ts)
    future, size = diff < 0, F.abs(diff).cast("double")
    rounded = lambda x: F.floor(x + 0.5).cast("bigint")
    minutes, hours, days = rounded(size / 60_000), rounded(size / 3_600_000), rounded(size / 86_400_000)
    months = rounded(days / 30)
    years = rounded(months / 12)

    def said(text: Column) -> Column:
        return F.concat(F.when(future, F.lit("en ")).otherwise(F.lit("hace ")), text)

    return (
        F.when(diff.isNull(), F.lit(DASH))
        .when(minutes < 1, said(F.lit("instantes")))
        .when(minutes < 60, said(F.concat(minutes.cast("string"), F.lit(" min"))))
        .when(hours < 24, said(F.concat(hours.cast("string"), F.lit(" h"))))
        .when(days < 30, said(F.concat(days.cast("string"), F.lit(" d"))))
        .when(months < 12, said(F.concat(months.cast("string"), F.lit(" meses"))))
        .otherwise(said(F.concat(years.cast("string"), F.lit(" años"))))
    )


def date_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd/MM/yyyy"), F.lit(DASH))


def datetime_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd/MM/yyyy, HH:mm"), F.lit(DASH))


def duration_text(ms: Column) -> Column:
    """``h``/``min``/``s`` with empty parts left out; a dash for null, NaN and negative values."""
    total = F.floor(ms.cast("double") / 1000).cast("bigint")
    h, m, s = (F.floor(total / 3600).cast("bigint"), F.floor((total % 3600) / 60).cast("bigint"), total % 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0), F.lit(DASH))
        .when((h > 0) & (m > 0), F.concat_ws(" ", text(h, " h"), text(m, " min")))
        .when(h > 0, text(h, " h"))
        .when((m > 0) & (s > 0), F.concat_ws(" ", text(m, " min"), text(s, " s")))
        .when(m > 0, text(m, " min"))
        .otherwise(text(s, " s"))
    )


def _two(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _clock(ms: Column) -> Column:
    return F.concat_ws(":", _two(F.floor(ms / 3_600_000).cast("bigint")), _two(F.floor((ms % 3_600_000) / 60_000).cast("bigint")), _two(F.floor((ms % 60_000) / 1000).cast("bigint")))


def timestamp_text(ms: Column) -> Column:
    """HH:MM:SS.mmm; the floor comes before the absolute value."""
    whole = F.abs(F.floor(ms.cast("double"))).cast("bigint")
    return F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), _clock(whole), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))


def timestamp_short(ms: Column) -> Column:
    """HH:MM:SS, not below zero."""
    return _clock(F.greatest(F.lit(0), F.floor(ms.cast("double")).cast("bigint")))


def in_daily_window(ts: Column, start: str, end: str) -> Column:
    """Whether a time of day is in [start, end); a window such as 22:00 to 06:00 goes past midnight."""
    t = F.date_format(ts, "HH:mm")
    return (t >= start) & (t < end) if start <= end else (t >= start) | (t < end)
