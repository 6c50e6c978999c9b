"""EDF+ and blob data sources."""

import os
import subprocess
import sys

import numpy as np
import pytest

from pulsegrid.sources import files

SCHEMA = "study_id string, sample_rate int, chunk_index int, samples array<float>, impedance array<float>"


def study(name, n, cut, seed, rate=50):
    rng = np.random.default_rng(seed)
    ecg, z = rng.integers(-3000, 3000, n), rng.integers(0, 900, n)
    return [(name, rate, k, ecg[i : i + cut].astype(float).tolist(), z[i : i + cut].astype(float).tolist()) for k, i in enumerate(range(0, n, cut))]


def joined(rows, signal):
    return np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["chunk_index"]) if r["signal"] == signal])


def test_edf_round_trip(spark, tmp_path):
    path = str(tmp_path / "edf")
    rows = study("s/1 é", 1234, 333, 1) + study("s2", 500, 7, 2) + study("one", 1, 1, 3) + [("none", 50, 0, None, None), (None, 50, 0, [1.0], [1.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    files.write_edf(df, path)
    assert sorted(os.listdir(path)) == ["_temporary", "none.edf", "one.edf", "s%2F1%20%C3%A9.edf", "s2.edf"] and os.listdir(f"{path}/_temporary") == []
    for records in (1, 3, 10_000):
        got = spark.read.format("edfplus").option("records", records).load(path).collect()
        for name, seed, n in (("s/1 é", 1, 1234), ("s2", 2, 500), ("one", 3, 1)):
            rng = np.random.default_rng(seed)
            for signal, want in (("ECG", rng.integers(-3000, 3000, n)), ("Impedance", rng.integers(0, 900, n))):
                x = joined([r for r in got if r["study_id"] == name], signal)
                assert len(x) == -(-n // 50) * 50 and np.allclose(x[:n], want) and not x[n:].any()
    files.write_edf(df.filter("study_id = 's2'"), path, mode="overwrite", scale=0.5)
    assert [f for f in os.listdir(path) if f.endswith(".edf")] == ["s2.edf"]
    again = spark.read.format("edfplus").load(f"{path}/s2.edf").collect()
    assert np.abs(joined(again, "ECG") - joined([r for r in got if r["study_id"] == "s2"], "ECG")).max() < 1e-6


def test_one_signal_only(spark, tmp_path):
    df = spark.createDataFrame(study("a", 120, 50, 4), SCHEMA).drop("impedance")
    files.write_edf(df, str(tmp_path / "edf"))
    assert {r["signal"] for r in spark.read.format("edfplus").load(str(tmp_path / "edf")).collect()} == {"ECG"}


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    register = files.register
    register(spark)
    bad = spark.createDataFrame([("a", 50, 0, [1.0] * 50, 50), ("a", 50, 1, [1.0] * 50, 50)], "study_id string, sample_rate int, chunk_index int, samples array<float>, total bigint")
    with pytest.raises(Exception, match="announced"):
        bad.coalesce(1).write.format("edfplus").mode("append").save(str(tmp_path / "edf"))
    assert not any(f.endswith(".edf") for _, _, names in os.walk(tmp_path) for f in names)


def test_a_day_takes_flat_memory(tmp_path):
    """The writer's peak memory for a day at 250 Hz is that for an hour."""
    code = """if True:
        import resource, sys, numpy as np
        from pyarrow import fs
        from pulsegrid.sources.files import OpenStudy, Signal
        hours = int(sys.argv[1])
        x = np.zeros(65_536)
        signals = [Signal("ECG", "uV", 1.0, 250), Signal("Impedance", "Ohm", 1.0, 250)]
        total = hours * 3600 * 250 // 65_536 * 65_536
        out = OpenStudy(fs.LocalFileSystem(), sys.argv[2], total, signals)
        for _ in range(total // 65_536):
            out.add([x, x])
        out.close()
        print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"""
    peaks = [int(subprocess.run([sys.executable, "-c", code, h, str(tmp_path / f"{h}.edf")], capture_output=True, check=True, text=True).stdout) for h in ("1", "24")]
    assert peaks[1] < peaks[0] * 1.1 and (tmp_path / "24.edf").stat().st_size > 80_000_000


def test_blobs_by_ranges(spark, tmp_path, monkeypatch):
    files.register(spark)
    rng = np.random.default_rng(5)
    top = tmp_path / "blobs"
    top.mkdir()
    x = rng.normal(size=files.CHUNK * 9 + 77).astype("<f4")
    (top / "whole.bin").write_bytes(x.tobytes())
    (top / "torn.bin").write_bytes(x.tobytes()[: 4 * files.CHUNK + 6])
    (top / "tail.bin").write_bytes(b"abc")
    (top / "empty.bin").write_bytes(b"")
    seen = []
    for size in (1 << 30, 4 * files.CHUNK * 2, 1):
        df = spark.read.format("float32blob").option("rangeBytes", size).load(str(top))
        seen.append((df.rdd.getNumPartitions(), sorted((os.path.basename(r["path"]), r["chunk_index"], r["samples"], r["code"] or "") for r in df.collect())))
    assert [n for n, _ in seen] == [3, 7, 13] and seen[0][1] == seen[1][1] == seen[2][1]
    rows = seen[0][1]
    assert np.array_equal(np.concatenate([np.array(r[2], dtype="<f4") for r in rows if r[0] == "whole.bin"]), x)
    assert [(r[0], r[1], len(r[2])) for r in rows if r[3] == "SIGNAL_CORRUPT"] == [("tail.bin", 0, 0), ("torn.bin", 1, 0)]
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("float32blob").load(str(tmp_path / "nowhere")).count()
