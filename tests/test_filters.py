"""Noise filter, lead-off and chunk quality."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import filters, quality
from pulsegrid.sources import synthetic

SCHEMA = "study_id string, sample_rate int, chunk_index int, samples array<float>, note string"


def cut(name, x, sizes, rate=250):
    ends = np.cumsum(sizes)
    return [(name, rate, k, x[e - n : e].tolist(), "n") for k, (n, e) in enumerate(zip(sizes, ends, strict=True))]


def test_chunks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    x = (np.cumsum(rng.normal(size=4000)) + 500).astype(np.float32)
    ways = {"one": [4000], "twenty": [200] * 20, "odd": [1, 0, 63, 64, 65, 1000, 2807], "single": [1] * 50 + [3950]}
    df = spark.createDataFrame([r for k, sizes in ways.items() for r in cut(k, x, sizes)], SCHEMA).repartition(7)
    out = filters.clean(df)
    assert out.columns == df.columns and out.count() == df.count()
    got = {}
    for r in out.orderBy("study_id", "chunk_index").collect():
        got.setdefault(r["study_id"], []).extend(r["samples"])
    system, state, want = filters.cascade(filters.Band(), 250.0), np.zeros(6), []
    for v in x.astype(np.float64):
        y, state = system._one(v - float(x[0]), state)
        want.append(y)
    for k in ways:
        assert np.abs(np.array(got[k]) - want).max() < 1e-6


@pytest.mark.parametrize("hertz,least,most", [(0.02, -80, -50), (1, -1, 0.1), (10, -1, 0.1), (50, -400, -40)])
def test_tones(spark, hertz, least, most):
    t = np.arange(250 * 200) / 250
    x = np.sin(2 * math.pi * hertz * t).astype(np.float32)
    df = spark.createDataFrame(cut("a", x, [10_000] * 5), SCHEMA)
    y = np.concatenate([r["samples"] for r in filters.clean(df).orderBy("chunk_index").collect()])[12_500:]
    assert least < 20 * math.log10(np.sqrt(2 * np.mean(y**2)) + 1e-15) < most


def test_odd_chunks(spark):
    rows = [("a", 250, 0, None, None), ("a", 250, 1, [], None), ("a", 250, 2, [float("nan"), 1.0, float("inf")], None), ("b", 60, 0, [5.0] * 200, "x"), (None, None, 0, [1.0, 1.0], "x"), (None, None, 1, [1.0], "x")]
    got = {(r["study_id"], r["chunk_index"]): r for r in filters.clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 6 and got["a", 0]["samples"] is None and got["a", 1]["samples"] == []
    assert all(math.isfinite(v) for v in got["a", 2]["samples"]) and got["b", 0]["samples"] == [0.0] * 200 and got[None, 1]["samples"] == [0.0]
    assert filters.clean(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lead_off(spark):
    words = ["C00000"] * 3 + ["C80000"] * 2 + ["CA0000", "000000CA0000", "C00000", None, "zz"]
    df = spark.createDataFrame([("d", i if i < 6 else i + 1, w) for i, w in enumerate(words)], "device string, frame int, status string")
    named = [r[0] for r in df.select(filters.leads_off(F.col("status"))).collect()]
    assert named[:7] == [[]] * 3 + [["RLD"]] * 2 + [["RLD", "IN2P"]] * 2
    got = sorted(tuple(r) for r in filters.lead_off_segments(df, "device", rate=1).collect())
    assert got == [("d", 3.0, 6.0, 3, ["IN2P", "RLD"]), ("d", 7.0, 8.0, 1, ["IN2P", "RLD"]), ("d", 9.0, 11.0, 2, [])]
    assert [r["frames"] for r in filters.lead_off_segments(df, "device", leads=("IN2P",)).orderBy("start_s").collect()] == [1, 1, 2]


def test_quality(spark):
    rng = np.random.default_rng(2)
    beats = np.asarray(synthetic.ecg("s_1", seconds=20, rate=250), dtype=np.float32)
    rows = [
        ("beats", 250, 0, beats.tolist(), None), ("flat", 250, 0, [1.0] * 500, None), ("half", 250, 0, [0.0, 1.0] * 50 + [5.0] * 100, None), ("noise", 250, 0, rng.normal(size=5000).tolist(), None),
        ("clipped", 250, 0, [9.0, -9.0] * 10, None), ("none", 250, 0, None, None), ("empty", 250, 0, [], None), ("one", 250, 0, [1.0], None),
    ]
    got = {r["study_id"]: r for r in quality.chunk_quality(spark.createDataFrame(rows, SCHEMA), quality.QualityCuts(saturated=9.0)).collect()}
    assert got["beats"]["correlation"] > 0.9 and got["beats"]["diagnostic"] and got["beats"]["beats"] > 15
    assert got["flat"]["quality_score"] == 0 and got["flat"]["flat"] == 1
    assert got["half"]["flat"] == pytest.approx(99 / 199) and got["clipped"]["saturated"] == 1 and got["clipped"]["quality_score"] == 0
    assert got["noise"]["correlation"] < 0.66 and not got["noise"]["diagnostic"]
    assert got["none"]["quality_score"] == got["empty"]["quality_score"] == 0 and got["one"]["quality_score"] == 1
