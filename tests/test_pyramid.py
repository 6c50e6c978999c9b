"""Columns from chunks and from the tree, against the samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import pyramid
from pulsegrid.operators import signal as sig


@pytest.fixture(scope="module")
def signals(spark):
    rng, rows, whole = np.random.default_rng(1), [], {}
    for name, n, sizes in (("a", 70_001, [1, 4095, 4097, 20_000, 41_808]), ("b", 5, [5]), ("c", 9000, [9000]), ("flat", 300, [100, 0, 200]), ("none", 0, [0])):
        x = np.ones(n, np.float32) if name == "flat" else rng.normal(size=n).astype(np.float32)
        whole[name], at = x, 0
        for k, m in enumerate(sizes):
            rows.append((name, 250, k, x[at : at + m].tolist()))
            at += m
    return whole, spark.createDataFrame(rows, "study_id string, sample_rate int, chunk_index int, samples array<float>").repartition(3)


@pytest.mark.parametrize("width", [1, 10, 333, 5000])
def test_overview_as_from_samples(signals, width):
    rows = sig.samples(sig.sized(signals[1], "study_id"), "study_id")
    columns = ["study_id", "col", "mn", "mx", "lo", "hi"]
    want, got = (sorted(tuple(r[c] for c in columns) for r in df.collect()) for df in (sig.overview(rows, width, "study_id"), pyramid.overview_chunks(signals[1], width, "study_id")))
    assert got == want and got


def test_zoom_as_from_samples(spark, signals, tmp_path):
    whole, chunks = signals
    pyramid.tree(chunks, "study_id").write.partitionBy("level").parquet(str(tmp_path / "tree"))
    nodes = spark.read.parquet(str(tmp_path / "tree")).cache()
    assert nodes.filter("level = 0").agg(F.sum(F.size("mins"))).first()[0] == sum(map(len, whole.values()))
    rng = random.Random(2)
    windows = [(0, 70_001, 10), (0, 70_001, 1), (3, 70_000, 1000), (4090, 4200, 7), (17, 18, 5), (69_990, 80_000, 3), (0, 65_536, 16), (100_000, 100_010, 2)]
    windows += [(a, a + rng.randrange(1, 70_000), rng.randrange(1, 400)) for a in (rng.randrange(70_000) for _ in range(7))]
    for low, high, width in windows:
        per, want = max(1, (high - low) // width), []
        for name, x in whole.items():
            for c in range(width):
                part = x[low + c * per : min(low + (c + 1) * per, high)]
                if len(part):
                    want.append((name, c, float(part.min()), float(part.max())))
        got = sorted((r["study_id"], r["col"], r["mn"], r["mx"]) for r in pyramid.zoom(nodes, low, high, width, "study_id").collect())
        assert got == sorted(want), (low, high, width)


def test_a_far_zoom_reads_few_samples(spark, signals, tmp_path):
    chunks = signals[1].filter("study_id = 'a'")
    nodes = pyramid.tree(chunks, "study_id").cache()
    nodes.count()
    plan = pyramid.zoom(nodes, 0, 70_001, 2, "study_id")._jdf.queryExecution().executedPlan()
    assert "posexplode" not in plan.toString()
    kept = nodes.filter("level = 0").filter(F.expr("floor(((start + size(mins)) + 17) / 35000) > floor((start - 17) / 35000)"))
    assert kept.count() < nodes.filter("level = 0").count() / 3
