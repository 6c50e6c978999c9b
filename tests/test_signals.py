"""Blobs, payloads, frames, overviews and rhythm."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import rhythm, signal, windows
from pulsegrid.sources import signals, synthetic


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-9000, 9000), st.integers(-9000, 9000), st.integers(-9000, 9000)), min_size=1, max_size=50))
def test_payload_round_trip(rows):
    x = np.array(rows)
    assert (signals.decode_payload(signals.encode_payload(x), 3, "delta") == x).all()
    assert (signals.decode_payload(signals.encode_payload(x, "raw"), 3, "raw") == x).all()


def test_running_sum_beyond_16_bits():
    data = base64.b64encode(np.full(5, 30_000, dtype="<i2").tobytes()).decode()
    assert signals.decode_payload(data, 1, "delta")[:, 0].tolist() == [30_000, 60_000, 90_000, 120_000, 150_000]


def test_decode_batches_keeps_going(spark):
    good = signals.encode_payload(np.arange(7)[:, None])
    df = spark.createDataFrame([("a", good, 1, "delta"), ("b", "AAA=", 3, "delta"), ("c", None, 1, None)], "id string, data string, num_channels int, compression_type string")
    rows = {r["batch_id"]: r for r in signals.decode_batches(df).collect()}
    assert rows["a"]["samples"] == list(range(7)) and rows["a"]["error"] is None
    assert rows["b"]["error"] and rows["c"]["error"]


def test_blobs(spark, tmp_path):
    x = np.arange(10, dtype="<f4")
    (tmp_path / "whole.bin").write_bytes(x.tobytes())
    (tmp_path / "short.bin").write_bytes(x.tobytes()[:-1])
    blobs = signals.blob_scan(spark, str(tmp_path)).withColumn("sample_count", F.lit(10)).withColumn("name", F.regexp_extract("path", r"(\w+)\.bin$", 1))
    whole, corrupt = signals.checked_blobs(blobs)
    assert [r["name"] for r in corrupt.collect()] == ["short"]
    got = sorted((r["chunk_index"], r["samples"]) for r in signals.decode_float32(whole, "name", most=4).collect())
    assert sum((s for _, s in got), []) == x.tolist() and len(got) == 3


def test_codes(spark):
    df = spark.createDataFrame([("0009DADD",), ("0009C2ED",), ("0009A96D",), ("FFFFFFFF",), ("00800000",)], "c string")
    rows = df.select(signals.signed24(F.col("c")), signals.microvolts(F.col("c"))).collect()
    assert [r[0] for r in rows] == [645_853, 639_725, 633_197, -1, -(1 << 23)]
    assert ["%.2E" % r[1] for r in rows[:3]] == ["3.08E+04", "3.05E+04", "3.02E+04"]


def test_lab_files(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("Record #:  0,\nStatus Bits\tCH2,\nFFFFFFFFFFC00000\t0009DADD,\nFFFFFFFFFFC80000\tFFFFFFFE,\n")
    (tmp_path / "values.csv").write_text("Record #:  0,,\n01/06/202621:24:01,,\nCH2,,\n3.08E+04,,\n-1.5E+01,,\n")
    (tmp_path / "registers.csv").write_text("Register,Address,Value,D7,D6,D5,D4,D3,D2,D1,D0\nCONFIG2,0x02,0xE0,1,1,1,0,0,0,0,0\n")
    assert [r["code"] for r in signals.lab_codes(spark, str(tmp_path / "codes.csv")).collect()] == [645_853, -2]
    assert [r["value"] for r in signals.lab_values(spark, str(tmp_path / "values.csv")).collect()] == [30_800.0, -15.0]
    (row,) = signals.lab_registers(spark, str(tmp_path / "registers.csv")).collect()
    assert (row["register"], row["value"], row["d7"], row["d0"]) == ("CONFIG2", "0xE0", 1, 0)


def test_frames(spark):
    frame = bytes.fromhex("C00000" "09DADD" "FFFFFF")
    df = spark.createDataFrame([("s", bytearray(frame * 2 + b"\x01\x02")), ("empty", bytearray())], "study_id string, content binary")
    rows = signals.frames(df).orderBy("frame").collect()
    assert [(r["study_id"], r["frame"], r["status"], r["ecg"], r["impedance"]) for r in rows] == [("s", 0, "C00000", 645_853, -1), ("s", 1, "C00000", 645_853, -1)]
    bad = rhythm.non_diagnostic(signals.frames(df), "C80000", "study_id").collect()
    assert [(r["study_id"], r["start_s"], r["end_s"], r["frames"]) for r in bad] == [("s", 0.0, 0.004, 2)]


def _chunks(spark, x, most=7):
    rows = [("s", 250, 0, k, p.tolist()) for k, p in signals.chunked(np.asarray(x, dtype=np.float32), most)]
    return spark.createDataFrame(rows, "study_id string, sample_rate int, start_ts_ms bigint, chunk_index int, samples array<float>")


@pytest.mark.parametrize("n,width", [(3, 10), (10, 10), (25, 4), (40, 7), (5, 1)])
def test_overview(spark, n, width):
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    got = {r["col"]: (r["mn"], r["mx"], r["lo"], r["hi"]) for r in signal.overview(signal.samples(signal.sized(_chunks(spark, x), "study_id"), "study_id"), width, "study_id").collect()}
    per = max(1, n // width)
    want = {c: (min(p), max(p), x.min(), x.max()) for c in range(width) if len(p := x[c * per : min(n, (c + 1) * per)])}
    assert got == {c: tuple(map(float, v)) for c, v in want.items()}


def test_constant_overview(spark):
    df = signal.pixels(signal.overview(signal.samples(signal.sized(_chunks(spark, [2.0] * 9), "study_id"), "study_id"), 3, "study_id"), 44)
    assert {(r["lo"], r["hi"], r["y_top"], r["y_bottom"]) for r in df.collect()} == {(1.0, 3.0, 22.0, 22.5)}


def test_synthetic_signal_and_peaks(spark):
    a, b = synthetic.ecg("s_1", 60), synthetic.ecg("s_1", 60)
    assert (a == b).all() and len(a) == 15_000 and not (a == synthetic.ecg("s_2", 60)).all()
    at = rhythm.detect_peaks(a, 250)
    assert 72 <= len(at) <= 76 and 0.74 < np.median(np.diff(at)) / 250 < 0.86
    beats = rhythm.peaks(_chunks(spark, a, 4000))
    assert beats.count() == len(at)
    row = rhythm.hrv(beats).first()
    assert 70 < row["mean_hr"] < 80 and row["min_hr"] <= row["mean_hr"] <= row["max_hr"]
    assert rhythm.classify(beats).filter("event_type <> 'PVC'").count() == 0


def test_rules(spark):
    t, rows = 0.0, []
    for rr in [800] * 10 + [500] * 61 + [2500] + [800] * 5 + [3500] + [1100] * 28:
        t += rr
        rows.append(("s", t, 1.0))
    rows[5] = ("s", rows[5][1], 9.0)
    df = spark.createDataFrame(rows, "study_id string, t_ms double, amplitude double")
    got = {(r["event_type"], r["severity"]) for r in rhythm.classify(df).collect()}
    assert got == {("TACHYCARDIA", "LOW"), ("PAUSE", "HIGH"), ("PAUSE", "CRITICAL"), ("BRADYCARDIA", "LOW"), ("PVC", "MEDIUM")}


def test_sustained_boundary(spark):
    rows = [("s", 1000.0 * i, 1000.0) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "k string, t_ms double, rr_ms double")
    assert windows.sustained(df, F.col("rr_ms") >= 1000, 30_000, "k").count() == 1
    assert windows.sustained(df.filter("t_ms < 30000"), F.col("rr_ms") >= 1000, 30_000, "k").count() == 0


def test_edf(spark):
    x = np.arange(600)
    data = signals.edf_bytes(x, 250)
    assert data[:8] == b"0       " and data[192:197] == b"EDF+C" and len(data) == 768 + 3 * (500 + 60)
    assert np.frombuffer(data[768 : 768 + 500], dtype="<i2").tolist() == x[:250].tolist()
    (row,) = signals.export_edf(_chunks(spark, x, 100)).collect()
    assert bytes(row["file"]) == data


def test_synthetic_entities(spark):
    p = synthetic.patients(spark, "2024-01-01").cache()
    assert p.count() == 25 and {r["study_status"]: r["count"] for r in p.groupBy("study_status").count().collect()} == {"active": 7, "completed": 6, "paused": 6, "none": 6}
    assert p.filter("(study_status = 'none') <> (assigned_device_id is null)").count() == 0
    s = synthetic.studies(p, "2024-01-01")
    assert s.count() == 7 * 4 + 12 * 2 and s.filter("ended_at is null").count() >= 7
    d = synthetic.devices(p, "2024-01-01").cache()
    assert {r["status"]: r["count"] for r in d.groupBy("status").count().collect()} == {"assigned": 19, "available": 8, "maintenance": 2, "retired": 1}
    assert synthetic.health(d, "2024-01-01").count() == 19 + 6 + 2
    assert synthetic.next_device_id(d).first()[0] == "d_037"


def test_peaks_by_segments(spark):
    """A signal of any length is found in segments just as in one piece, but for where the detector settles."""
    whole = synthetic.ecg("long", 400, 250)
    rows = [("long", 250, k, part.tolist()) for k, part in signals.chunked(whole, 7000)]
    df = spark.createDataFrame(rows, "study_id string, sample_rate int, chunk_index int, samples array<float>")
    want = rhythm.detect_peaks(whole, 250).tolist()
    assert [r["i"] for r in rhythm.peaks(df).orderBy("i").collect()] == want
    got = [r["i"] for r in rhythm.peaks(df, segment_s=60).orderBy("i").collect()]
    assert len(set(got) & set(want)) >= 0.99 * len(want) and len(got) == len(set(got)) and abs(len(got) - len(want)) <= 0.01 * len(want)


def test_signals_of_one_chunk_need_no_groups(spark):
    made = {f"k{i}": np.asarray(synthetic.ecg(f"k{i}", seconds=5 + i, rate=250), dtype=np.float32) for i in range(6)} | {"none": np.empty(0, dtype=np.float32)}
    rows = [(k, 250, 0, x.tolist()) for k, x in made.items()] + [("two", 250, c, made["k5"][c * 1000 : (c + 1) * 1000 if c == 0 else None].tolist()) for c in (0, 1)]
    found = rhythm.peaks(spark.createDataFrame(rows, "study_id string, sample_rate int, chunk_index int, samples array<float>").repartition(2))
    want = {(k, int(i), i * 4.0, float(x[i])) for k, x in (made | {"two": made["k5"]}).items() for i in rhythm.detect_peaks(x, 250)}
    assert found.columns == ["study_id", "i", "t_ms", "amplitude"] and {tuple(r) for r in found.collect()} == want

    def grouped(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return grouped(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return grouped(node.plan())
        own = node.metrics().apply("pythonNumRowsReceived").value() if kind == "FlatMapGroupsInArrowExec" else 0
        return own + sum(grouped(node.children().apply(i)) for i in range(node.children().size()))

    assert grouped(found._jdf.queryExecution().executedPlan()) == sum(k == "two" for k, *_ in want)
