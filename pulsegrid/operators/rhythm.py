"""From samples to beats, heart-rate variability, events and alerts.

What the specification leaves open is a parameter with a documented default: severities (``SeverityCuts``), the
detector (a published derivative-square-integrate method), and no rule at all for AFIB, NOISE and OTHER.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.aggregates import session_summary
from pulsegrid.operators.signal import sized
from pulsegrid.operators.windows import islands, outliers, rr_intervals, sustained
from pulsegrid.sources.shipping import ship

#: Columns of ``session_summary``.
SUMMARY = ("intervals", "mean_nn", "mean_hr", "min_hr", "max_hr", "sdnn", "rmssd")
FAST_BPM, SLOW_BPM, SUSTAINED_MS, PAUSE_MS = 100, 60, 30_000, 2_000


@dataclass(frozen=True)
class SeverityCuts:
    """Cut-offs that nothing specifies."""

    critical_pause_ms: int = 3_000
    high_after_ms: int = 120_000


def _sliding_sums(v: np.ndarray, n: int) -> np.ndarray:
    """Sums over every ``n`` neighbours, by doubling."""
    size, done, width, out = len(v) - n + 1, 0, 1, None
    while True:
        if n & width:
            part = v[done : done + size]
            out = part if out is None else out + part
            done += width
        if 2 * width > n:
            return out
        v = v[:-width] + v[width:]
        width *= 2


def _running_mean(v: np.ndarray, n: int) -> np.ndarray:
    """Means over ``n`` samples around each; at the end over those that are left."""
    size = len(v)
    n = max(1, min(n, size))
    out, head = np.empty_like(v), n // 2
    whole = out[head : head + size - n + 1]
    if n < 64 or v.dtype == np.float32:  # fewer passes than a running sum takes, and its errors would run along
        np.divide(_sliding_sums(v, n), n, out=whole)
    else:
        sums = np.empty(size + 1)
        sums[0] = 0.0
        np.cumsum(v, out=sums[1:])
        np.subtract(sums[n:], sums[: size - n + 1], out=whole)
        whole /= n
    out[:head] = whole[0]
    tail = np.cumsum(v[: size - n : -1], dtype=np.float64)[head:]
    out[head + size - n + 1 :] = (tail / np.arange(head + 1, n))[::-1]
    return out


def _high(energy: np.ndarray) -> tuple[float, np.ndarray]:
    """The quantile 0.98 (linear), and the partial sort that it is from."""
    at = (len(energy) - 1) * 0.98
    below, w = int(at), at - int(at)
    part = np.partition(energy, below)
    a = float(part[below])
    b = float(np.fmin.reduce(part[below + 1 :])) if below + 1 < len(part) else a
    return a + (b - a) * w if w < 0.5 else b - (b - a) * (1 - w), part


def _levels(energy: np.ndarray) -> tuple[float, float]:
    """The quantile 0.98 (linear) and the median."""
    high, part = _high(energy)
    mid = len(part) // 2
    part.partition([(len(part) - 1) // 2, mid])
    return high, (float(part[(len(part) - 1) // 2]) + float(part[mid])) / 2


def detect_peaks(signal: np.ndarray, rate: int) -> np.ndarray:
    """Sample indices of R peaks: difference, square, integrate over 150 ms, adaptive threshold, 200 ms refractory time.

    After Pan and Tompkins (1985), in numpy, with the baseline removed by a running mean.  What is given in 32 bits is worked
    on in 32, and in 64 if anything is close there.
    """
    x = np.asarray(signal)
    if len(x) < max(2, rate // 2):
        return np.empty(0, dtype=np.int64)
    found = _peaks(x, rate) if x.dtype == np.float32 else None
    return np.array(_peaks(x.astype(np.float64), rate) if found is None else found, dtype=np.int64)


def _apart(strong: np.ndarray, high: float, weak: float) -> bool:
    """Whether all of ``strong`` pass the threshold in their order, and no maximum of up to ``weak`` does; with a margin."""
    for e in strong.tolist():
        if 0.25 * high < 1.1 * weak or e < 1.1 * (0.75 * weak + 0.25 * high):
            return False
        high = 0.875 * high + 0.125 * e
    return 0.25 * high > 1.1 * weak


def _peaks(x: np.ndarray, rate: int) -> list[int] | None:
    """``detect_peaks`` in the precision of ``x``; None where 32 bits may not be enough."""
    exact = x.dtype == np.float64
    clean = _running_mean(x - _running_mean(x, int(0.6 * rate)), max(1, int(0.02 * rate)))
    energy = np.empty_like(x)
    np.subtract(clean[2:], clean[:-2], out=energy[1:-1])
    energy[0], energy[-1] = 2 * (clean[1] - clean[0]), 2 * (clean[-1] - clean[-2])
    if not exact and not 1e-9 < max(energy.max(), -energy.min()) < 1e9:
        return None
    energy *= energy
    energy = _running_mean(energy, int(0.15 * rate))
    up = energy[1:] >= energy[:-1]
    top = up[:-1] > up[1:]  # the local maxima
    high, part = _high(energy)
    refractory, reach = int(0.2 * rate), int(0.1 * rate)
    padded = np.full(len(x) + 2 * reach, -np.inf, dtype=x.dtype)
    padded[reach : reach + len(x)] = clean
    nearby = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)

    likely = np.flatnonzero(top & (energy[1:-1] > 0.1 * high)) + 1
    around = nearby[likely]
    tops = around.argmax(axis=1)
    peaks = likely - reach + tops
    heights = clean[peaks]
    strong = energy[likely]
    # Each of these must pass the threshold and no other maximum can: then the noise level need not be followed.  The other
    # level stays between the least and the greatest maximum that it has met; if that does not settle it, it is followed.
    weak = 0.1 * high
    low, most = (min(high, float(strong.min())), max(high, float(strong.max()))) if len(likely) else (high, high)
    clear = 0.25 * low > 1.001 * weak and low > 1.001 * (0.75 * weak + 0.25 * most) or _apart(strong, high, weak)
    clear = clear and 2 * np.count_nonzero(energy <= weak) > len(x)
    if not exact:
        close = np.float32(2e-6 * max(x.max(), -x.min()))
        if not clear or np.count_nonzero(around >= (heights - close)[:, None]) != len(likely):
            return None
    if not clear:
        local = np.flatnonzero(top) + 1
        known = dict(zip(likely.tolist(), peaks.tolist(), strict=True))  # the others are looked up when they are asked for
        noise, taken = float(np.median(part)), []
        for i, e in zip(local.tolist(), energy[local].tolist(), strict=True):
            if e > noise + 0.25 * (high - noise):
                high = 0.875 * high + 0.125 * e
                taken.append(known[i] if i in known else i - reach + int(nearby[i].argmax()))
            else:
                noise = 0.875 * noise + 0.125 * e
        peaks = np.array(taken, dtype=np.int64)
        heights = clean[peaks]
    new = np.append(True, peaks[1:] != peaks[:-1])[: len(peaks)]
    found: list[int] = []
    last, height = -refractory, 0.0
    for peak, level in zip(peaks[new].tolist(), heights[new].tolist(), strict=True):
        if peak - last >= refractory:
            found.append(peak)
            last, height = peak, level
        elif not exact and abs(level - height) <= close:
            return None
        elif level > height:
            found[-1] = last = peak
            height = level
    return found


def peaks(chunks: DataFrame, key: str = "study_id", *, segment_s: int = 3600, overlap_s: int = 10) -> DataFrame:
    """(key, i, t_ms, amplitude) of R peaks from (key, sample_rate, chunk_index, samples).

    A signal is worked on in segments of ``segment_s`` seconds, each with the chunks that reach ``overlap_s`` into its
    neighbours, where the detector settles; a peak counts in the segment that its sample lies in.  So a task holds one
    segment, however long the signal is, and signals of up to one segment are detected whole.  One that is also a single
    chunk is detected where its row is, with no group of its own.
    """
    ship(chunks.sparkSession)

    def run(group: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk_index")
        samples = t.column("samples").combine_chunks()
        signal = (samples.flatten() if isinstance(samples, pa.ListArray) else pa.chunked_array(samples).combine_chunks().flatten()).to_numpy(zero_copy_only=False)
        rate, first = t.column("sample_rate")[0].as_py(), t.column("first")[0].as_py()
        at = detect_peaks(signal, rate)
        lo = group[1].as_py() * segment_s * rate
        at = at[(at + first >= lo) & (at + first < lo + segment_s * rate)]
        i = at + first
        return pa.table([pa.array([group[0].as_py()] * len(at), pa.string()), pa.array(i), pa.array(i * 1000.0 / rate), pa.array(signal[at].astype(np.float64))], names=["key", "i", "t_ms", "amplitude"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rates, samples = (batch.column(k) for k in ("key", "sample_rate", "samples"))
            values, ends = samples.values.to_numpy(zero_copy_only=False), samples.offsets.to_numpy()
            signals = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at = [detect_peaks(x, rate) for x, rate in zip(signals, rates.to_pylist(), strict=True)]
            n = [len(i) for i in at]
            i = np.concatenate([np.empty(0, dtype=np.int64), *at])
            found = np.concatenate([np.empty(0), *[x[k].astype(np.float64) for x, k in zip(signals, at, strict=True)]])
            named = keys.take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([named, pa.array(i), pa.array(i * 1000.0 / np.repeat(rates.to_numpy(), n)), pa.array(found)], names=["key", "i", "t_ms", "amplitude"])

    rows = sized(chunks.select(F.col(key).cast("string").alias("key"), "sample_rate", "chunk_index", "samples"), "key").filter(F.size("samples") > 0)
    one = F.coalesce((F.size("samples") == F.col("total")) & (F.col("total") <= F.col("sample_rate") * segment_s), F.lit(False))
    short, rows = rows.filter(one).select("key", "sample_rate", "samples"), rows.filter(~one)
    schema = "key string, i bigint, t_ms double, amplitude double"
    size, reach = F.col("sample_rate") * segment_s, F.col("sample_rate") * overlap_s
    low = F.greatest(F.lit(0), F.floor((F.col("first") - reach) / size))
    high = F.least(F.floor((F.col("total") - 1) / size), F.floor((F.col("first") + F.size("samples") - 1 + reach) / size))
    rows = rows.withColumn("segment", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    return rows.groupBy("key", "segment").applyInArrow(run, schema).unionByName(short.mapInArrow(alone, schema)).withColumnRenamed("key", key)


def peaks_of(rows: DataFrame, signal: Callable[[str], np.ndarray], rate: int, key: str = "study_id") -> DataFrame:
    """As ``peaks``, for signals that a function makes from their key: no sample moves or is stored."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                made = signal(k)
                at = detect_peaks(made, rate)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(at * 1000.0 / rate), pa.array(made[at].astype(np.float64))], names=[key, "i", "t_ms", "amplitude"])

    return rows.select(F.col(key).cast("string").alias(key)).mapInArrow(run, f"`{key}` string, i bigint, t_ms double, amplitude double")


def _summaries(at: list[np.ndarray], rate: int) -> list[pa.Array]:
    """The columns of ``session_summary``, a row for each signal's sample indices of peaks; of all signals at once."""
    n = np.array([len(i) for i in at]) - 1
    rr = np.delete(np.diff(np.concatenate(at) * 1000.0 / rate), np.cumsum(n[:-1] + 1) - 1)
    columns = np.full((6, len(n)), np.nan)
    some, several = n > 0, n > 1
    if some.any():
        m = n[some]
        starts = np.cumsum(m) - m
        mean = np.add.reduceat(rr, starts) / m
        columns[:4, some] = mean, 60_000 / mean, 60_000 / np.maximum.reduceat(rr, starts), 60_000 / np.minimum.reduceat(rr, starts)
        squares = np.add.reduceat((rr - np.repeat(mean, m)) ** 2, starts)
        columns[4, several] = np.sqrt(squares[m > 1] / (m[m > 1] - 1))
    if several.any():
        steps = np.delete(np.diff(rr), np.cumsum(m[:-1]) - 1)
        q = m[m > 1] - 1
        columns[5, several] = np.sqrt(np.add.reduceat(steps**2, np.cumsum(q) - q) / q)
    return [pa.array(n), *(pa.array(c, mask=~(some if k < 4 else several)) for k, c in enumerate(columns))]


def hrv_of(rows: DataFrame, signal: Callable[[str], np.ndarray], rate: int, key: str = "study_id") -> DataFrame:
    """``hrv`` of the peaks of signals that a function makes from their key; no beat moves, as one task has a signal whole."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, beats = [], [], 0
            keys = batch.column(0).to_pylist()
            for row, k in enumerate(keys):
                at = detect_peaks(signal(k), rate)
                if len(at):
                    names.append(k)
                    found.append(at)
                    beats += len(at)
                if names and (beats >= 100_000 or row == len(keys) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *_summaries(found, rate)], names=[key, *SUMMARY])
                    names, found, beats = [], [], 0

    return rows.select(F.col(key).cast("string").alias(key)).mapInArrow(run, f"`{key}` string, intervals bigint, " + ", ".join(f"{c} double" for c in SUMMARY[1:]))


def hrv(beats: DataFrame, key: str = "study_id") -> DataFrame:
    """SDNN, RMSSD, and mean, least and greatest heart rate; the mean is 60000 over the mean interval."""
    return session_summary(rr_intervals(beats, key), (key,))


def classify(beats: DataFrame, key: str = "study_id", cuts: SeverityCuts = SeverityCuts()) -> DataFrame:
    """(key, event_type, severity, timestamp_in_recording, duration_seconds, confidence_score) by rule.

    Above 100 or below 60 beats a minute for 30 s or more; an interval above 2 s; an amplitude beyond 2.5 standard
    deviations.  Rules give no confidence.
    """
    with_rr = rr_intervals(beats, key)
    rate = F.lit(60_000.0) / F.col("rr_ms")

    def long(flag, kind: str) -> DataFrame:
        runs = sustained(with_rr, flag, SUSTAINED_MS, key)
        severity = F.when(F.col("duration_ms") >= cuts.high_after_ms, "HIGH").otherwise("LOW")
        return runs.select(key, F.lit(kind).alias("event_type"), severity.alias("severity"), (F.col("start_ms") / 1000).alias("timestamp_in_recording"), (F.col("duration_ms") / 1000).alias("duration_seconds"))

    stops = with_rr.filter(F.col("rr_ms") > PAUSE_MS).select(
        key, F.lit("PAUSE").alias("event_type"), F.when(F.col("rr_ms") > cuts.critical_pause_ms, "CRITICAL").otherwise("HIGH").alias("severity"), ((F.col("t_ms") - F.col("rr_ms")) / 1000).alias("timestamp_in_recording"), (F.col("rr_ms") / 1000).alias("duration_seconds")
    )
    odd = outliers(beats, "amplitude", key).select(key, F.lit("PVC").alias("event_type"), F.lit("MEDIUM").alias("severity"), (F.col("t_ms") / 1000).alias("timestamp_in_recording"), F.lit(None).cast("double").alias("duration_seconds"))
    every = long(rate > FAST_BPM, "TACHYCARDIA").unionByName(long(rate < SLOW_BPM, "BRADYCARDIA")).unionByName(stops).unionByName(odd)
    return every.withColumn("confidence_score", F.lit(None).cast("double"))


def beyond_threshold(beats: DataFrame, thresholds: DataFrame, key: str = "patient_id", low: int = 40, high: int = 180) -> DataFrame:
    """Beats outside their patient's limits (low_bpm, high_bpm), or the defaults."""
    limits = thresholds.select(F.col(key).alias("_k"), "low_bpm", "high_bpm")
    rows = beats.join(limits, F.col(key) == F.col("_k"), "left").drop("_k")
    rate = F.lit(60_000.0) / F.col("rr_ms")
    return rows.filter((rate < F.coalesce("low_bpm", F.lit(low))) | (rate > F.coalesce("high_bpm", F.lit(high)))).withColumn("bpm", rate).drop("low_bpm", "high_bpm")


def non_diagnostic(frames: DataFrame, good_status: str, *keys: str, rate: int = 500) -> DataFrame:
    """Stretches of frames whose status word is not ``good_status``: (keys, start_s, end_s, frames).

    What the bits of the word mean is not specified; the word is compared as a whole.
    """
    runs = islands(frames, F.col("status") != good_status, "frame", *keys).filter("flag")
    return runs.groupBy(*keys, "island").agg((F.min("frame") / rate).alias("start_s"), ((F.max("frame") + 1) / rate).alias("end_s"), F.count("*").alias("frames")).drop("island")


def alerts_for(events: DataFrame) -> DataFrame:
    """(patient_id, event_id, severity, message) for HIGH and CRITICAL events of the event chain."""
    wanted = events.filter(F.col("severity").isin("HIGH", "CRITICAL"))
    return wanted.select("patient_id", F.col("id").alias("event_id"), "severity", F.concat_ws(" ", "event_type", F.lit("en"), "serial_number").alias("message"))


def lead_beats(batches: DataFrame, decoded: DataFrame) -> DataFrame:
    """Beats of channel 0 of decoded upload batches (see ``sources.signals.decode_batches``)."""
    rates = batches.select(F.col("id").alias("batch_id"), "sample_rate")
    return peaks(decoded.filter((F.col("channel") == 0) & F.col("error").isNull()).join(rates, "batch_id"), "batch_id")


def process(batches: DataFrame, decoded: DataFrame, beats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, batch statuses) of decoded upload batches; ``beats`` are their ``lead_beats`` where they are at hand.

    A batch whose payload did not decode is FAILED with its error and the others go on; channel 0 carries the rhythm.
    """
    failed = decoded.filter(F.col("error").isNotNull()).groupBy("batch_id").agg(F.first("error").alias("processing_error"))
    status = batches.join(failed, F.col("id") == F.col("batch_id"), "left").select("id", F.when(F.col("processing_error").isNull(), "DONE").otherwise("FAILED").alias("processing_status"), "processing_error")
    return classify(lead_beats(batches, decoded) if beats is None else beats, "batch_id"), status
