"""What shows only at more rows, greater keys or rare values than the provided tables have."""

import os
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pulsegrid import catalog
from pulsegrid.operators import rhythm
from pulsegrid.sources import synthetic
from tests.test_catalog import SF, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same_as_oracle(spark, name, folder, tables):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        path = f"{folder}/{t}.parquet"
        if t in tables:
            pq.write_table(tables[t], path)
        else:
            os.symlink(f"{SF}/{t}.parquet", path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = catalog.queries()[name](spark, str(folder))
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    return got


@pytest.mark.parametrize("name", ["v01_quarantine", "v01_quarantine_named"])
def test_numbers_of_nine_digits_are_quarantined(spark, tmp_path, name):
    t = pq.read_table(f"{SF}/customer.parquet")
    keys = pa.array(t.column("c_custkey").to_numpy() + 525_500)  # from 525,548 on, dni has nine digits
    got = same_as_oracle(spark, name, tmp_path, {"customer": t.set_column(t.schema.get_field_index("c_custkey"), "c_custkey", keys)})
    assert len(got) > t.num_rows / 3


def test_payloads_of_values_at_a_border(spark, tmp_path):
    # 0.29 times 100 is 29 in 32 bits and a little less in 64
    near = (np.arange(-200, 200) / np.float32(100)).astype(np.float32)
    rows = [np.roll(near, k)[:64].tolist() for k in range(0, 400, 16)]
    t = pa.table({"vec_id": pa.array(range(1, len(rows) + 1), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    same_as_oracle(spark, "g16_payloads", tmp_path, {"embeddings": t})


@pytest.mark.parametrize("rate", [50, 128, 250, 500])
def test_series_of_a_beat(rate):
    j, series = synthetic._shape(rate)
    behind = np.random.default_rng(rate).random(500) / rate
    got = np.polynomial.chebyshev.chebvander(2 * rate * behind - 1, len(series) - 1) @ series
    assert np.abs(got - synthetic._beat(behind[:, None] + j / rate)).max() < 1e-13


def test_summaries_made_where_the_signals_are(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("short",)], "study_id string")
    made = lambda k: synthetic.ecg(k, 2 if k == "short" else 30)
    want, got = (sorted(map(tuple, df.collect())) for df in (rhythm.hrv(rhythm.peaks_of(rows, made, 250)), rhythm.hrv_of(rows, made, 250)))
    assert len(got) == 3 == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and all(x == y if x is None or y is None else x == pytest.approx(y, rel=1e-12) for x, y in zip(a[1:], b[1:], strict=True))


def test_levels_are_quantiles():
    random = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 51, 1000, 12_345):
        x = random.random(n)
        assert rhythm._levels(x) == (np.quantile(x, 0.98), np.median(x))


def plain_peaks(signal, rate):
    """The detector word by word: every mean on its own, every maximum in its turn."""
    x = np.asarray(signal, dtype=np.float64)
    if len(x) < rate // 2:
        return []

    def means(v, n):
        n = max(1, min(n, len(v)))
        first = np.maximum(np.arange(len(v)) - n // 2, 0)
        return np.array([v[i : i + n].mean() for i in first])

    clean = means(x - means(x, int(0.6 * rate)), int(0.02 * rate))
    energy = means(np.gradient(clean) ** 2, int(0.15 * rate))
    high, noise, found = np.quantile(energy, 0.98), np.median(energy), []
    for k in range(1, len(x) - 1):
        e = energy[k]
        if not energy[k - 1] <= e > energy[k + 1]:
            continue
        if e > noise + 0.25 * (high - noise):
            high += (e - high) / 8
            lo = max(0, k - int(0.1 * rate))
            peak = lo + int(clean[lo : k + int(0.1 * rate) + 1].argmax())
            if not found or peak - found[-1] >= int(0.2 * rate):
                found.append(peak)
            elif clean[peak] > clean[found[-1]]:
                found[-1] = peak
        else:
            noise += (e - noise) / 8
    return found


def _odd_signals():
    random = np.random.default_rng(5)
    beats, n = synthetic.ecg("odd", 30), 7500
    yield from (beats, beats.astype(np.float64), beats * np.float32(1e-12), beats * np.float32(3e15), -beats, beats + np.float32(500))
    fading = np.exp(-np.arange(n) / 1500)
    yield from (beats * fading, (beats * fading).astype(np.float32), beats * fading[::-1], beats * np.where(np.arange(n) % 2000 < 1000, 1, 0.45))
    yield from (random.standard_normal(n), random.standard_normal(n).astype(np.float32), np.cumsum(random.standard_normal(n)), beats + 0.3 * random.standard_normal(n))
    yield from (beats[:200], beats[:124], np.zeros(n), np.zeros(n, dtype=np.float32), np.round(beats * 20_000).astype(np.int16))


@pytest.mark.parametrize("k", range(19))
def test_peaks_word_by_word(k):
    signal = list(_odd_signals())[k]
    assert rhythm.detect_peaks(signal, 250).tolist() == plain_peaks(signal, 250)


def test_peaks_of_many_signals_in_either_precision():
    made = [synthetic.ecg(f"either_{i}", 120) for i in range(150)]
    in_32 = [rhythm._peaks(x, 250) for x in made]
    assert sum(found is None for found in in_32) < 15  # these are decided in 64 bits
    assert all(found is None or found == rhythm._peaks(x.astype(np.float64), 250) for x, found in zip(made, in_32, strict=True))


def test_maxima_of_noise_take_no_line_each():
    """A signal of two minutes has over 3,000 maxima of energy, of which 150 are beats."""
    signal, lines = synthetic.ecg("lines", 120), 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    sys.settrace(count)
    try:
        found = rhythm.detect_peaks(signal, 250)
    finally:
        sys.settrace(None)
    assert len(found) > 140 and lines < 3000


def test_noise_is_gaussian():
    z = np.concatenate([synthetic._gaussian(np.random.default_rng(i), 29_999, 0.5) for i in range(40)]).astype(np.float64) / 0.5
    assert len(z) == 40 * 29_999
    assert [(z**k).mean() for k in (1, 2, 3, 4)] == pytest.approx([0, 1, 0, 3], abs=0.02)
    assert [(np.abs(z) > k).mean() for k in (1, 2, 3, 4)] == pytest.approx([0.3173105, 0.0455003, 0.0026998, 0.0000633], rel=0.01, abs=3e-5)
    assert all(abs((z[lag:] * z[:-lag]).mean()) < 0.004 for lag in (1, 2, 14_999, 15_000))


def test_summaries_of_many_signals_at_once():
    random = np.random.default_rng(2)
    at = [np.cumsum(random.integers(100, 300, n)) for n in (1, 1, 2, 5, 3, 1, 150, 2, 1)]
    for part in (at, at[:1], at[2:3], at[:3]):
        rows = zip(*(c.to_pylist() for c in rhythm._summaries(part, 360)), strict=True)
        for row, i in zip(rows, part, strict=True):
            rr = np.diff(i * 1000.0 / 360)
            want = [len(rr), *([rr.mean(), 60_000 / rr.mean(), 60_000 / rr.max(), 60_000 / rr.min()] if len(rr) else [None] * 4), *([rr.std(ddof=1), np.sqrt((np.diff(rr) ** 2).mean())] if len(rr) > 1 else [None] * 2)]
            assert all(a == b if b is None else a == pytest.approx(b, rel=1e-12) for a, b in zip(row, want, strict=True))
