"""Quality score of a chunk of signal: flat line, saturation, and how much its beats are alike.

A chunk's score is the share of samples that are neither flat nor saturated, times the mean correlation of its beats with
their mean (the template index of Orphanidou et al., 2015; beats by ``rhythm.detect_peaks``).  A chunk with fewer than
``BEATS`` beats is scored by its samples alone, as its rhythm cannot be told from so few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.rhythm import detect_peaks
from pulsegrid.sources.shipping import ship

#: Beats from which a template is made.
BEATS = 4


@dataclass(frozen=True)
class QualityCuts:
    """In the signal's unit; nothing specifies them."""

    flat_step: float = 0.0
    saturated: float = 32_767.0
    good: float = 0.66  # the cut that the template index was published with


def flat_share(samples: Column, step: float = 0.0) -> Column:
    """Share of the steps between samples that are no greater than ``step``; null for fewer than two samples."""
    n = F.size(samples)
    still = F.zip_with(F.slice(samples, F.lit(2), n - 1), F.slice(samples, F.lit(1), n - 1), lambda a, b: F.abs(a.cast("double") - b.cast("double")) <= step)
    return F.when(n > 1, F.size(F.filter(still, lambda x: x)) / (n - 1))


def saturated_share(samples: Column, limit: float) -> Column:
    """Share of samples at or beyond the limit either way, or no number; null for none."""
    beyond = F.filter(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= limit))
    return F.when(F.size(samples) > 0, F.size(beyond) / F.size(samples))


def template_correlation(signal: np.ndarray, rate: int) -> tuple[int, float | None]:
    """(beats, mean correlation of each with their mean); windows of the median distance between beats."""
    x = np.nan_to_num(np.asarray(signal, dtype=np.float64), posinf=0.0, neginf=0.0)
    at = detect_peaks(x, rate)
    if len(at) < BEATS:
        return len(at), None
    half = int(np.median(np.diff(at))) // 2
    at = at[(at >= half) & (at + half < len(x))]
    if len(at) < BEATS or half < 2:
        return len(at), None
    beats = x[at[:, None] + np.arange(-half, half + 1)]
    beats = beats - beats.mean(axis=1, keepdims=True)
    template = beats.mean(axis=0)
    norms = np.linalg.norm(beats, axis=1) * np.linalg.norm(template)
    return len(at), float(np.mean(np.where(norms > 0, beats @ template / np.where(norms > 0, norms, 1.0), 0.0)))


def chunk_quality(chunks: DataFrame, cuts: QualityCuts = QualityCuts()) -> DataFrame:
    """Adds flat, saturated, beats, correlation, quality_score (0 to 1) and diagnostic to chunks (sample_rate, samples, ...).

    A null or empty chunk scores 0.
    """
    ship(chunks.sparkSession)
    names = chunks.columns
    rows = chunks.withColumns({"flat": F.coalesce(flat_share(F.col("samples"), cuts.flat_step), F.lit(0.0)), "saturated": F.coalesce(saturated_share(F.col("samples"), cuts.saturated), F.lit(1.0))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                row = batch.slice(i, 1)
                samples, rate = row.column("samples")[0].as_py(), row.column("sample_rate")[0].as_py()
                beats, alike = template_correlation(np.asarray(samples or [], dtype=np.float64), rate or 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([beats], pa.int64()), pa.array([alike], pa.float64())], names=[*row.schema.names, "beats", "correlation"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(run, f"{kinds}, beats bigint, correlation double")
    usable = F.greatest(F.lit(0.0), 1 - F.col("flat") - F.col("saturated"))
    score = usable * F.greatest(F.lit(0.0), F.coalesce("correlation", F.lit(1.0)))
    return rows.withColumn("quality_score", score).withColumn("diagnostic", score >= cuts.good).select(*names, "flat", "saturated", "beats", "correlation", "quality_score", "diagnostic")
