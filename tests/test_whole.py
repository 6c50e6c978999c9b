"""Queries cover whole tables, not a few of their ids."""

import os
import subprocess
import sys
from datetime import datetime

import duckdb
import numpy as np
import pytest

from pulsegrid import catalog
from pulsegrid.operators import rhythm
from pulsegrid.sources import signals, synthetic

SF = "/root/testdata/sf0.001"


def test_drift_of_every_device(spark):
    got = {r["device_id"] for r in catalog.queries()["w08_baseline_drift_all"](spark, SF).select("device_id").distinct().collect()}
    assert got == {f"d_{r[0]}" for r in duckdb.sql(f"SELECT DISTINCT user_id FROM '{SF}/events.parquet'").fetchall()} and len(got) > 3


@pytest.fixture
def few_studies(spark, tmp_path):
    """Twelve studies, of which the last (a multiple of 41) is deleted."""
    keys = [*range(1, 12), 41]
    at = datetime(2023, 5, 1, 10)
    spark.createDataFrame([(k, 1, "F", at) for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 5.0, 1) for k in keys], "l_orderkey bigint, l_quantity double, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), {f"s_{k}" for k in keys[:-1]}


def test_signal_of_every_live_study(spark, few_studies):
    folder, live = few_studies
    rows = catalog.queries()["g15_synthetic_signal"](spark, folder).collect()
    assert {r["study_id"] for r in rows} == live and len(rows) == len(live)
    assert {(r["sample_rate"], r["chunk_index"], r["n"]) for r in rows} == {(250, 0, 30_000)}


def test_signals_are_counted_where_they_are_made(spark, few_studies):
    """The samples of a signal take 120,000 bytes; none of them leaves its task."""
    df = catalog.queries()["g15_synthetic_signal"](spark, few_studies[0])
    assert len(df.collect()) == 11

    def received(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return received(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return received(node.plan())
        own = [node.metrics().apply("pythonDataReceived").value()] if kind == "MapInArrowExec" else []
        return own + [n for i in range(node.children().size()) for n in received(node.children().apply(i))]

    (bytes_,) = received(df._jdf.queryExecution().executedPlan())
    assert 0 < bytes_ < 11 * 30_000


def test_counted_signals_are_the_signals(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None), ("c", -1)], "study_id string, start_ts_ms bigint")
    for seconds in (300, 1.5, 0.001):  # two chunks, one, none
        made, counted = (sorted(map(tuple, df.collect())) for df in (synthetic.signals(rows, seconds=seconds).selectExpr("study_id", "sample_rate", "start_ts_ms", "chunk_index", "size(samples)"), synthetic.chunk_sizes(rows, seconds=seconds)))
        assert counted == made and len(made) == 3 * -(-int(seconds * 250) // signals.CHUNK)


def test_rhythm_of_every_live_study(spark, few_studies):
    folder, live = few_studies
    got = {r["study_id"]: r for r in catalog.queries()["g20_rhythm"](spark, folder).collect()}
    assert set(got) == live
    for study, row in got.items():
        t = rhythm.detect_peaks(synthetic.ecg(study, 120), 250) * 4.0
        rr = np.diff(t)
        want = [len(rr), rr.mean(), 60_000 / rr.mean(), 60_000 / rr.max(), 60_000 / rr.min(), rr.std(ddof=1), np.sqrt((np.diff(rr) ** 2).mean())]
        assert [row[c] for c in ("intervals", "mean_nn", "mean_hr", "min_hr", "max_hr", "sdnn", "rmssd")] == pytest.approx(want)
        assert 140 <= len(rr) <= 150


def test_peaks_of_a_function_are_peaks_of_its_chunks(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0)], "study_id string, start_ts_ms bigint")
    same = [sorted(map(tuple, df.collect())) for df in (rhythm.peaks(synthetic.signals(rows, seconds=20)), rhythm.peaks_of(rows, lambda k: synthetic.ecg(k, 20), 250))]
    assert same[0] == same[1] and same[0]


def test_the_entry_point_needs_no_session():
    """Queries are listed before there is a session."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert len(e.queries()) > 140 and set(e.oracle_sql()) <= set(e.queries()) and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True, timeout=120)
