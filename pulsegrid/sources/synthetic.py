"""Deterministic synthetic entities and signals."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import clinical, clock, text
from pulsegrid.schemas import PATIENT_STATUSES
from pulsegrid.sources.shipping import ship
from pulsegrid.sources.signals import chunked

#: Names to draw from.
FIRST_NAMES = ["María", "Juan", "Carlos", "Lucía", "Sofía", "Diego", "Valentina", "Mateo", "Camila", "Federico", "Florencia", "Tomás", "Martina", "Bautista", "Agustina", "Joaquín", "Isabella", "Santiago", "Emma", "Nicolás", "Renata", "Lautaro", "Mía", "Benjamín", "Olivia"]
LAST_NAMES = ["García", "Rodríguez", "González", "Fernández", "López", "Martínez", "Pérez", "Gómez", "Sánchez", "Díaz", "Romero", "Suárez", "Acosta", "Álvarez", "Benítez", "Castro", "Domínguez", "Ferrari", "Herrera", "Iglesias", "Juárez", "Méndez", "Navarro", "Ortiz", "Quiroga"]


def _ago(as_of: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - (hours * 3.6e9).cast("bigint"))


def patients(spark: SparkSession, as_of: datetime | str, n: int = 25) -> DataFrame:
    """n patients; status cycles, ages are 25 to 80, everything follows from the index."""
    now, i = clock.at(as_of), F.col("i")
    status = text.cyclic(list(PATIENT_STATUSES), i)
    first, last = text.cyclic(FIRST_NAMES, i), text.cyclic(LAST_NAMES, i * 7)
    age = F.when(status == "active", i % 6 + 0.5).when(status == "paused", 12 + i % 24).when(status == "completed", 72 + i % 200)
    birth = F.make_date(F.year(now) - (25 + (i * 13) % 56).cast("int"), ((i * 5) % 12 + 1).cast("int"), ((i * 7) % 28 + 1).cast("int"))
    line = F.right(F.lpad((i * 13).cast("string"), 4, "0"), F.lit(4))
    return spark.range(n).withColumnRenamed("id", "i").select(
        "i",
        text.padded("p_", i + 1).alias("id"),
        F.concat_ws(" ", first, last).alias("full_name"),
        F.lpad((28_000_000 + i * 137_521).cast("string"), 8, "0").alias("dni"),
        birth.alias("birth_date"),
        F.when(i % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(status != "none", text.padded("d_", i + 1)).alias("assigned_device_id"),
        status.alias("study_status"),
        _ago(now, age.cast("double")).alias("last_data_received_at"),
        text.synthetic_email(first, last).alias("contact_email"),
        F.concat(F.lit("+54 9 11 "), F.substring((40_000_000 + i * 137_521).cast("string"), 1, 4), F.lit("-"), line).alias("contact_phone"),
    )


def studies(patients_df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Four studies for an active patient, two for others, none for status none; an active patient's first is running."""
    now, k = clock.at(as_of), F.col("k")
    count = F.when(F.col("study_status") == "active", 4).otherwise(2)
    rows = patients_df.filter(F.col("study_status") != "none").withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    status = F.when((k == 0) & (F.col("study_status") == "active"), "in_progress").otherwise(text.cyclic(["completed", "completed", "completed", "in_progress", "cancelled"], k))
    ended = F.when(status != "in_progress", _ago(now, (24 * (k + 1) * 7 - 48).cast("double")))
    return rows.select(
        F.concat(F.lit("s_"), F.col("id"), F.lit("_"), (k + 1).cast("string")).alias("id"),
        F.col("id").alias("patient_id"),
        F.col("full_name").alias("patient_name"),
        _ago(now, (24 * (k + 1) * 7).cast("double")).alias("started_at"),
        ended.alias("ended_at"),
        F.when(ended.isNotNull(), 48).alias("duration_hours"),
        status.alias("status"),
        F.coalesce("assigned_device_id", F.lit("d_001")).alias("device_id"),
        (432_000 + k * 12_000).alias("samples_count"),
        ((k + 1) * 2).alias("events_count"),
    )


def devices(patients_df: DataFrame, as_of: datetime | str) -> DataFrame:
    """The patients' devices, then six available, two never seen, two in maintenance and one retired."""
    now = clock.at(as_of)
    number = F.regexp_replace("id", "^d_", "").cast("int")
    assigned = patients_df.filter(F.col("assigned_device_id").isNotNull()).select(F.col("assigned_device_id").alias("id"), F.lit("assigned").alias("status"), F.col("id").alias("assigned_patient_id"), F.lit(True).alias("seen"), F.lit(30).alias("age"))
    last = patients_df.agg(F.coalesce(F.max(F.regexp_replace("assigned_device_id", "^d_", "").cast("int")), F.lit(0)).alias("last"))
    kinds = F.expr("array(" + ", ".join(f"struct({k + 1} as k, '{s}' as status, {str(seen).lower()} as seen)" for k, (s, seen) in enumerate([("available", True)] * 6 + [("available", False)] * 2 + [("maintenance", True)] * 2 + [("retired", False)])) + ")")
    extra = last.withColumn("x", F.explode(kinds)).select(text.padded("d_", F.col("last") + F.col("x.k")).alias("id"), F.col("x.status").alias("status"), F.lit(None).cast("string").alias("assigned_patient_id"), F.col("x.seen").alias("seen"), F.lit(7).alias("age"))
    every = assigned.unionByName(extra)
    return every.select("id", text.serial_of(F.col("id")).alias("serial"), F.lit("SIM7080G v1").alias("model"), F.lit("0.3.1").alias("firmware_version"), "status", "assigned_patient_id", F.when(F.col("seen"), _ago(now, (number % 24).cast("double") + 0.25)).alias("last_seen_at"), _ago(now, (number + F.col("age")) * F.lit(24.0)).alias("created_at"))


def health(devices_df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Health readings of every device that was ever seen."""
    seed = F.regexp_replace("id", "^d_", "").cast("int")
    seed = F.when(seed == 0, 1).otherwise(seed)
    dbm = -60 - (seed * 7) % 40
    return devices_df.filter(F.col("last_seen_at").isNotNull()).select(
        F.col("id").alias("device_id"), "serial", "model", "firmware_version", (30 + (seed * 11) % 70).alias("battery_percent"), dbm.alias("signal_dbm"), clinical.signal_band(dbm).alias("signal_quality"),
        F.col("last_seen_at").alias("last_ping_at"), (clock.at(as_of) + F.expr("INTERVAL 35 MINUTES")).alias("next_scheduled_upload_at"), F.lit(13).alias("uploads_today"), F.lit(2.7).alias("storage_used_mb"), F.lit(128).alias("storage_total_mb"),
    )


def next_device_id(devices_df: DataFrame) -> DataFrame:
    """One row: the id after the largest numeric suffix; suffixes that are no number are left out."""
    n = F.expr("try_cast(regexp_replace(id, '^d_', '') as int)")
    return devices_df.agg(text.padded("d_", F.greatest(F.coalesce(F.max(n), F.lit(0)), F.lit(0)) + 1).alias("id"))


def _beat(dt: np.ndarray) -> np.ndarray:
    """P, QRS and T bumps of a beat, by the seconds since its R peak."""
    return sum(size * np.exp(-0.5 * ((dt - centre) / sigma) ** 2) for centre, sigma, size in ((-0.12, 0.08 / 3, 0.15), (0.0, 0.02, 1.0), (0.2, 0.16 / 2.5, 0.3)))


@lru_cache(maxsize=4)
def _shape(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(j, Chebyshev coefficients by j): the beat at j samples after the first sample behind its R peak.

    They are series in how far that first sample lies behind the peak, at most one sample; their error is below 1e-13.
    """
    reach = int(0.4 * rate) + 1
    degree = 8 + -(-1000 // rate)
    j, x = np.arange(-reach, reach), np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    return j, np.polynomial.chebyshev.chebfit(x, _beat((x[:, None] + 1) / (2 * rate) + j / rate), degree)


@lru_cache(maxsize=4)
def _rest(n: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, respiration)."""
    t = np.arange(n) / rate
    return t, (0.08 * np.sin(2 * np.pi * 0.3 * t)).astype(np.float32)


def _gaussian(random: np.random.Generator, n: int, sigma: float) -> np.ndarray:
    """n draws in 32 bits, after Box and Muller (1958): each two of them from two numbers of 32 random bits."""
    half = -(-n // 2)
    bits = random.bit_generator.random_raw(half).astype("<u8", copy=False).view("<u4")
    radius, angle, out = bits[:half].astype(np.float32), bits[half:].astype(np.float32), np.empty(2 * half, dtype=np.float32)
    radius += np.float32(0.5)  # zero has no logarithm
    radius *= np.float32(2.0**-32)
    np.log(radius, out=radius)
    radius *= np.float32(-2 * sigma * sigma)
    np.sqrt(radius, out=radius)
    angle *= np.float32(2 * np.pi * 2.0**-32)
    np.multiply(np.cos(angle), radius, out=out[:half])
    np.multiply(np.sin(angle), radius, out=out[half:])
    return out[:n]


def ecg(seed: str, seconds: float = 3600.0, rate: int = 250) -> np.ndarray:
    """One synthetic lead in millivolts: beats every 0.8 s within 20 ms, P, QRS and T bumps, respiration and noise.

    Same seed, same signal.  A beat acts within 0.4 s.
    """
    random = np.random.default_rng(zlib.crc32(seed.encode()))
    n = int(seconds * rate)
    t, rest = _rest(n, rate)
    amplitude = 0.9 + 0.2 * random.random()
    first = 0.4 + 0.4 * random.random()
    gaps = 0.8 + 0.04 * (random.random(int(seconds / 0.78) + 2) - 0.5)
    beats = first + np.concatenate(([0.0], np.cumsum(gaps)))
    beats = beats[beats < seconds]
    j, series = _shape(rate)
    reach = len(j) // 2
    out = np.empty(n + 2 * reach, dtype=np.float32)
    out[:reach] = out[reach + n :] = 0.0
    made = out[reach : reach + n]
    np.add(rest, _gaussian(random, n, 0.02), out=made)
    behind = np.searchsorted(t, beats, side="right")  # the first sample after each beat
    x = 2 * rate * (behind / rate - beats) - 1
    terms = np.empty((len(series), len(x)))  # Chebyshev's polynomials of x
    terms[0], terms[1] = 1.0, x
    x *= 2
    for k in range(2, len(terms)):
        np.multiply(terms[k - 1], x, out=terms[k])
        terms[k] -= terms[k - 2]
    terms *= amplitude
    waves = terms.T.astype(np.float32) @ series.astype(np.float32)
    edges = [0, 1, -2, -1]
    waves[:, edges] *= np.abs((behind[:, None] + j[edges]) / rate - beats[:, None]) < 0.4
    halves = np.lib.stride_tricks.sliding_window_view(out, reach, writeable=True)
    halves[behind + reach] += waves[:, reach:]  # beats are further apart than half a beat is long
    halves[behind] += waves[:, :reach]
    return made


def signals(studies_df: DataFrame, *, seconds: float = 3600.0, rate: int = 250) -> DataFrame:
    """(study_id, sample_rate, start_ts_ms, chunk_index, samples) for (study_id, start_ts_ms) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for study, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, part in chunked(ecg(study, seconds, rate)):
                    samples = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([study]), pa.array([rate], pa.int32()), pa.array([start], pa.int64()), pa.array([k], pa.int32()), samples], names=["study_id", "sample_rate", "start_ts_ms", "chunk_index", "samples"])

    ship(studies_df.sparkSession)
    return studies_df.select("study_id", "start_ts_ms").mapInArrow(run, "study_id string, sample_rate int, start_ts_ms bigint, chunk_index int, samples array<float>")


def chunk_sizes(studies_df: DataFrame, *, seconds: float = 3600.0, rate: int = 250) -> DataFrame:
    """As ``signals``, with n, the number of samples, in their place: each is made whole and counted in its task, none moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, chunks, sizes = [], [], []
            for row, study in enumerate(batch.column(0).to_pylist()):
                for k, part in chunked(ecg(study, seconds, rate)):
                    of.append(row)
                    chunks.append(k)
                    sizes.append(len(part))
            own = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([rate] * len(of), pa.int32()), own.column(1), pa.array(chunks, pa.int32()), pa.array(sizes, pa.int32())], names=["study_id", "sample_rate", "start_ts_ms", "chunk_index", "n"])

    ship(studies_df.sparkSession)
    return studies_df.select("study_id", "start_ts_ms").mapInArrow(run, "study_id string, sample_rate int, start_ts_ms bigint, chunk_index int, n int")
