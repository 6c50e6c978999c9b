"""Noise filter of sampled signals: a band-pass and a mains notch, exact across the borders of chunks.

The filter is a cascade of second-order sections (Butterworth high-pass and low-pass, and a notch; bilinear transform with
the closed forms of the Audio EQ Cookbook).  It is linear, so a chunk's last state is A^n times its first plus what the
chunk adds from rest.  Three steps follow: each chunk is filtered from rest, keeping only its last state; the few numbers of
each chunk are folded along its signal, which gives every chunk's first state; each chunk is filtered from that.  So a
task holds one chunk, signals of any length run in parallel, and the output does not depend on how a signal is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.windows import islands
from pulsegrid.sources.shipping import ship

#: Samples of one matrix product.
STEP = 64


@dataclass(frozen=True)
class Band:
    """Hertz of the pass band's ends and of the mains; a part that the sample rate cannot carry is left out, as is None."""

    low: float | None = 0.5
    high: float | None = 40.0
    mains: float | None = 50.0
    mains_q: float = 10.0

    def sections(self, rate: float) -> list[tuple[float, float, float, float, float]]:
        """(b0, b1, b2, a1, a2) of each section."""
        out = []
        for kind, hertz, q in (("high-pass", self.low, math.sqrt(0.5)), ("low-pass", self.high, math.sqrt(0.5)), ("notch", self.mains, self.mains_q)):
            if hertz is None or not 0 < hertz < rate / 2:
                continue
            w = 2 * math.pi * hertz / rate
            c, alpha = math.cos(w), math.sin(w) / (2 * q)
            b = {"high-pass": ((1 + c) / 2, -(1 + c), (1 + c) / 2), "low-pass": ((1 - c) / 2, 1 - c, (1 - c) / 2), "notch": (1.0, -2 * c, 1.0)}[kind]
            out.append((*(x / (1 + alpha) for x in b), -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)))
        return out


class Cascade:
    """Sections in a row as one linear system, advanced ``STEP`` samples at once."""

    def __init__(self, sections: list[tuple[float, float, float, float, float]]):
        self.sections, self.size = sections, 2 * len(sections)
        unit = np.eye(self.size)
        self.a = np.array([self._one(0.0, unit[k])[1] for k in range(self.size)]).T.reshape(self.size, self.size)
        self.b = self._one(1.0, np.zeros(self.size))[1]
        self.c = np.array([self._one(0.0, unit[k])[0] for k in range(self.size)])
        self.d = self._one(1.0, np.zeros(self.size))[0]
        power, outs, ins = np.eye(self.size), [], []
        for _ in range(STEP):
            outs.append(self.c @ power)
            ins.append(power @ self.b)
            power = power @ self.a
        self.observe = np.array(outs).reshape(STEP, self.size)  # state -> the next outputs
        self.reach = np.array(ins[::-1]).T.reshape(self.size, STEP)  # inputs -> state after them
        self.step = power
        impulse = np.concatenate([[self.d], self.observe[:-1] @ self.b])
        at = np.arange(STEP)
        self.respond = np.where(at[:, None] >= at, impulse[np.abs(at[:, None] - at)], 0.0)

    def _one(self, x: float, state: np.ndarray) -> tuple[float, np.ndarray]:
        """One sample through all sections, direct form II transposed."""
        after = []
        for k, (b0, b1, b2, a1, a2) in enumerate(self.sections):
            s1, s2 = state[2 * k], state[2 * k + 1]
            y = b0 * x + s1
            after += [b1 * x - a1 * y + s2, b2 * x - a2 * y]
            x = y
        return x, np.array(after)

    def over(self, n: int) -> np.ndarray:
        """A^n."""
        return np.linalg.matrix_power(self.a, n)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, last state)."""
        whole = len(x) // STEP
        blocks = x[: whole * STEP].reshape(whole, STEP)
        added = blocks @ self.reach.T
        states = np.empty((whole + 1, self.size))
        states[0] = state
        for k in range(whole):
            states[k + 1] = self.step @ states[k] + added[k]
        y = (blocks @ self.respond.T + states[:-1] @ self.observe.T).ravel()
        rest, last, tail = x[whole * STEP :], states[whole], []
        for v in rest.tolist():
            out, last = self._one(v, last)
            tail.append(out)
        return np.concatenate([y, tail]), last


@lru_cache(maxsize=64)
def cascade(band: Band, rate: float) -> Cascade:
    return Cascade(band.sections(rate))


def _floats(samples: list[float] | None) -> np.ndarray:
    return np.asarray(samples if samples is not None else [], dtype=np.float64)


def _from(x: np.ndarray, level: float) -> np.ndarray:
    """Deviation from the signal's first sample, so that a signal starts at rest; what is no number deviates by nothing."""
    x = x - level
    return np.where(np.isfinite(x), x, 0.0)


def clean(chunks: DataFrame, key: str = "study_id", band: Band = Band()) -> DataFrame:
    """The chunks (key, sample_rate, chunk_index, samples, ...) with filtered samples, as doubles; other columns stay.

    Chunks follow one another in the order of ``chunk_index``, of which each stands once in a signal.  A null or empty chunk
    adds nothing; a sample that is no number counts as the signal's first.  With ``low`` None the signal's level is gone too.
    """
    ship(chunks.sparkSession)
    names = chunks.columns
    filled = F.size("samples") > 0
    first = F.min_by(F.when(filled, F.element_at("samples", 1).cast("double")), F.when(filled, F.col("chunk_index")))
    levels = chunks.groupBy(F.col(key).alias("_k")).agg(first.alias("_level"))
    levels = levels.withColumn("_level", F.when(~F.isnan("_level") & (F.abs("_level") < float("inf")), F.col("_level")).otherwise(0.0))
    levelled = chunks.join(levels, F.col(key).eqNullSafe(F.col("_k"))).drop("_k").withColumn("_rate", F.coalesce(F.col("sample_rate").cast("double"), F.lit(0.0)))
    rows = levelled.select(F.col(key).alias("_key"), "_rate", F.col("chunk_index").alias("_at"), F.col("samples").alias("_x"), "_level")
    kind, at_kind = chunks.schema[key].dataType.simpleString(), chunks.schema["chunk_index"].dataType.simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rate, samples, first in zip(*(batch.column(c).to_pylist() for c in ("_rate", "_x", "_level")), strict=True):
                x, system = _from(_floats(samples), first), cascade(band, rate)
                out.append((len(x), system.run(x, np.zeros(system.size))[1].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_rate"), batch.column("_at"), pa.array([n for n, _ in out], pa.int64()), pa.array([z for _, z in out], pa.list_(pa.float64()))], names=["_key", "_rate", "_at", "_n", "_z"])

    def fold(group: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        system, firsts = cascade(band, t.column("_rate")[0].as_py()), []
        state, powers = np.zeros(system.size), {}
        for n, added in zip(t.column("_n").to_pylist(), t.column("_z").to_pylist(), strict=True):
            firsts.append(state.tolist())
            if n not in powers:
                powers[n] = system.over(n)
            state = powers[n] @ state + np.asarray(added)
        return pa.table([t.column("_key"), t.column("_at"), pa.array(firsts, pa.list_(pa.float64()))], names=["_key", "_at", "_state"])

    states = rows.mapInArrow(ends, f"_key {kind}, _rate double, _at {at_kind}, _n bigint, _z array<double>")
    states = states.groupBy("_key").applyInArrow(fold, f"_key {kind}, _at {at_kind}, _state array<double>")
    given = levelled.join(states, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk_index") == F.col("_at")))
    place = names.index("samples")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                row = batch.slice(i, 1)
                rate, state, first, samples = (row.column(c)[0].as_py() for c in ("_rate", "_state", "_level", "samples"))
                y = None if samples is None else cascade(band, rate).run(_from(_floats(samples), first), np.asarray(state, dtype=np.float64))[0]
                columns = row.columns[: len(names)]
                columns[place] = pa.array([y], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'samples' else f.dataType.simpleString()}" for f in chunks.schema.fields)
    return given.select(*names, "_rate", "_state", "_level").mapInArrow(filtered, fields)


#: Bits 19 to 15 of the front end's 24-bit status word (public ADS1292R data sheet, LOFF_STAT).
LEAD_OFF_BITS = {"RLD": 19, "IN2N": 18, "IN2P": 17, "IN1N": 16, "IN1P": 15}


def leads_off(status: Column, leads: tuple[str, ...] = tuple(LEAD_OFF_BITS)) -> Column:
    """The electrodes of ``leads`` that a hexadecimal status word calls loose, highest bit first."""
    word = F.conv(F.right(status, F.lit(6)), 16, 10).cast("bigint")
    found = [F.when(word.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name)) for name, bit in LEAD_OFF_BITS.items() if name in leads]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def lead_off_segments(frames: DataFrame, *keys: str, leads: tuple[str, ...] = tuple(LEAD_OFF_BITS), rate: int = 500) -> DataFrame:
    """Stretches of frames with a loose electrode: (keys, start_s, end_s, frames, electrodes).

    ``electrodes`` are all that were loose at some time in the stretch.  A null or unreadable status word is a loose contact
    of none that is named.  A frame that is missing ends a stretch.
    """
    names = leads_off(F.col("status"), leads)
    readable = F.coalesce(F.col("status").rlike("^[0-9A-Fa-f]{6,}$"), F.lit(False))
    rows = frames.select(*keys, "frame", F.when(readable, names).otherwise(F.array().cast("array<string>")).alias("_off"), (~readable | (F.size(names) > 0)).alias("_bad"))
    before = F.lag("frame").over(Window.partitionBy(*keys).orderBy("frame"))
    rows = rows.withColumn("_hole", F.coalesce(F.col("frame") - before > 1, F.lit(False)))
    rows = rows.withColumn("_part", F.sum(F.col("_hole").cast("long")).over(Window.partitionBy(*keys).orderBy("frame")))
    runs = islands(rows, F.col("_bad"), "frame", *keys, "_part").filter("flag")
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_off"))))
    out = runs.groupBy(*keys, "_part", "island").agg((F.min("frame") / rate).alias("start_s"), ((F.max("frame") + 1) / rate).alias("end_s"), F.count("*").alias("frames"), every.alias("electrodes"))
    return out.drop("_part", "island")
