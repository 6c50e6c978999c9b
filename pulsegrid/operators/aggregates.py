"""Counts, extremes and summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.clinical import trend
from pulsegrid.functions.clock import at


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def there() -> Column:
    """Whether a group has a row."""
    return F.count("*") > 0


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def widened_range(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least and greatest value; a constant signal is widened by one either way."""
    lo, hi = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(F.when(lo == hi, lo - 1).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 1).otherwise(hi).alias("hi"))


def next_number(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """One more than the largest numeric suffix; suffixes that are no number are left out."""
    n = F.expr(f"try_cast(regexp_replace({column}, '^{prefix}', '') as bigint)")
    return df.agg((F.greatest(F.coalesce(F.max(n), F.lit(0)), F.lit(0)) + 1).alias("next"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


def kpis(patients: DataFrame, alerts: DataFrame, studies: DataFrame, as_of: datetime | str, *, hours: int = 24) -> DataFrame:
    """Active patients, pending alerts and running studies now, and their change against ``hours`` ago.

    The period of the comparison is not specified anywhere; it is a parameter.
    """
    now, then = at(as_of), F.timestamp_micros(F.unix_micros(at(as_of)) - hours * 3_600_000_000)

    def alive(t: Column) -> Column:
        return (F.col("created_at") <= t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t))

    def pending(t: Column) -> Column:
        return alive(t) & (F.col("acknowledged_at").isNull() | (F.col("acknowledged_at") > t))

    def running(t: Column) -> Column:
        return F.col("deleted_at").isNull() & (F.col("started_at") <= t) & (F.col("ended_at").isNull() | (F.col("ended_at") > t)) & F.col("status").isin("in_progress", "completed")

    count = lambda p: F.count_if(p)
    a = patients.filter(F.col("study_status") == "active").agg(count(alive(now)).alias("active_patients"), count(alive(then)).alias("_a"))
    b = alerts.agg(count(pending(now)).alias("pending_alerts"), count(pending(then)).alias("_b"))
    c = studies.agg(count(running(now)).alias("running_studies"), count(running(then)).alias("_c"))
    # Three single rows side by side.
    rows = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").join(c.withColumn("_k", F.lit(1)), "_k")
    out = []
    for name, was in (("active_patients", "_a"), ("pending_alerts", "_b"), ("running_studies", "_c")):
        delta = F.col(name) - F.col(was)
        out += [F.col(name), delta.alias(f"{name}_delta"), trend(delta).alias(f"{name}_trend")]
    return rows.select(*out)


def uploads_today(batches: DataFrame, as_of: datetime | str) -> DataFrame:
    """Batches received per device on the day of ``as_of`` (UTC)."""
    return batches.filter(F.to_date("received_at") == F.to_date(at(as_of))).groupBy("device_id").agg(F.count("*").alias("uploads_today"))


def patient_statistics(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per patient: events, events of each type, and the last batch, from (patient_id, event_type, batch_timestamp)."""
    each = [F.count_if(F.col("event_type") == t).alias(f"n_{t.lower()}") for t in types]
    return events.groupBy("patient_id").agg(F.count("*").alias("events"), *each, F.max("batch_timestamp").alias("last_batch"))


def trial_metrics(studies: DataFrame) -> DataFrame:
    """Studies by outcome, and adherence: recorded hours over the hours from start to end, of closed studies.

    How adherence is measured is specified nowhere; this is a documented choice.
    """
    hours = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(3.6e9)
    kept = F.least(F.lit(1.0), F.col("samples_count") / hours)
    return studies.filter(F.col("deleted_at").isNull()).agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(F.col("status") == "in_progress").alias("in_progress"),
        F.count_if(F.col("status") == "scheduled").alias("scheduled"),
        F.avg(F.when(hours > 0, kept)).alias("mean_adherence"),
    )


def noise_rate(events: DataFrame) -> DataFrame:
    """Share of NOISE events per device."""
    return events.groupBy("device_id").agg(F.count("*").alias("events"), (F.count_if(F.col("event_type") == "NOISE") / F.count("*")).alias("noise_rate"))


def demographics(patients: DataFrame) -> DataFrame:
    """Live patients by sex and status, with subtotals."""
    return patients.filter(F.col("deleted_at").isNull()).rollup("sex", "study_status").agg(F.count("*").alias("patients"))


def session_summary(beats: DataFrame, keys: tuple[str, ...] = ("study_id",)) -> DataFrame:
    """Heart rate and HRV per session from rows with rr_ms (null for a first beat) and drr_ms (null for a first interval)."""
    rr = F.col("rr_ms")
    return beats.groupBy(*keys).agg(
        F.count("rr_ms").alias("intervals"), F.avg(rr).alias("mean_nn"), (F.lit(60_000.0) / F.avg(rr)).alias("mean_hr"), (F.lit(60_000.0) / F.max(rr)).alias("min_hr"), (F.lit(60_000.0) / F.min(rr)).alias("max_hr"),
        F.stddev_samp(rr).alias("sdnn"), F.sqrt(F.avg(F.col("drr_ms") * F.col("drr_ms"))).alias("rmssd"),
    )


def credit_balance(movements: DataFrame) -> DataFrame:
    """Running balance per account over (account, at, id, amount); ``blocked`` where it is zero or below."""
    from pyspark.sql import Window

    running = F.sum("amount").over(Window.partitionBy("account").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return movements.withColumn("balance", running).withColumn("blocked", F.col("balance") <= 0)
