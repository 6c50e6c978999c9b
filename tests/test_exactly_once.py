"""The pipeline of uploads, stopped behind every write and run again."""

import json
import os
from datetime import datetime

import numpy as np
import pytest

from pulsegrid import schemas
from pulsegrid.sources import synthetic
from pulsegrid.sources.signals import encode_payload
from pulsegrid.streaming import pipeline

T0, RATE = 1_700_000_000 // 3600 * 3600, 250
COLUMNS = "id string, device_id string, batch_timestamp bigint, sample_rate int, num_channels int, compression_type string, data string"


class Stopped(Exception):
    pass


def upload(name, device, hour, pauses):
    """Twenty seconds of beats, silent in the middle where ``pauses``."""
    x = np.asarray(synthetic.ecg(name, seconds=20, rate=RATE)) * 1000
    if pauses:
        x[7 * RATE : 11 * RATE] = 0
    return {"id": name, "device_id": device, "batch_timestamp": T0 + hour * 3600, "sample_rate": RATE, "num_channels": 1, "compression_type": "delta", "data": encode_payload(np.round(x).reshape(-1, 1))}


@pytest.fixture(scope="module")
def given(spark):
    when = datetime(2024, 1, 1)
    device = [("a", when, when, None, "S-A", "m", "p", "h", None, None, None, None, "assigned"), ("b", when, when, None, "S-B", "m", None, "h", None, None, None, None, "available")]
    patient = [("p", when, when, None, "dr", None, "m", "f", "l", None, None, "X", "active", None, None, None, None)]
    ups = [upload("u1", "a", 0, True), upload("u2", "a", 1, False), upload("u3", "b", 0, True), upload("u4", "a", 2, False) | {"data": "no base64!"}]
    return spark.createDataFrame(device, schemas.DEVICE), spark.createDataFrame(patient, schemas.PATIENT), ups


def land(folder, name, rows, when):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / name, (when, when))


def tables(spark, folder):
    return {what: sorted(map(str, pipeline.committed(spark, folder, what).collect())) for what in (pipeline.EVENTS, pipeline.ALERTS, pipeline.RESULTS)}


def states(spark, folder, ups):
    received = spark.createDataFrame([(u["id"],) for u in ups], "id string")
    return {r["id"]: r["processing_status"] for r in pipeline.batch_states(received, folder).collect()}


def run(spark, given, top, after=lambda what: None):
    devices, patients, _ = given
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(top / "in"))
    pipeline.process_stream(stream, devices, patients, str(top / "out"), str(top / "ck"), after=after).awaitTermination()


def test_stopped_behind_every_write(spark, given, tmp_path):
    ups, want = given[2], None
    for stop in (None, pipeline.STARTED, pipeline.EVENTS, pipeline.ALERTS, pipeline.RESULTS, pipeline.LEDGER):
        top = tmp_path / str(stop)
        top.mkdir()
        land(top / "in", "0.json", ups[:2], 1_600_000_000)
        run(spark, given, top)
        assert states(spark, str(top / "out"), ups) == {"u1": "DONE", "u2": "DONE", "u3": "PENDING", "u4": "PENDING"}
        before = tables(spark, str(top / "out"))
        land(top / "in", "1.json", ups[1:], 1_600_000_001)  # u2 is delivered again
        if stop is not None:

            def die(what, stop=stop):
                if what == stop:
                    raise Stopped(what)

            with pytest.raises(Exception, match="Stopped"):
                run(spark, given, top, die)
            if stop != pipeline.LEDGER:  # nothing of it is to be seen yet
                assert tables(spark, str(top / "out")) == before
                assert states(spark, str(top / "out"), ups) == {"u1": "DONE", "u2": "DONE", "u3": "PROCESSING", "u4": "PROCESSING"}
        run(spark, given, top)
        got = tables(spark, str(top / "out"))
        want = want or got
        assert got == want
        assert states(spark, str(top / "out"), ups) == {"u1": "DONE", "u2": "DONE", "u3": "DONE", "u4": "FAILED"}
    events = pipeline.committed(spark, str(tmp_path / "None" / "out"), pipeline.EVENTS).collect()
    assert {(r["batch_id"], r["event_type"]) for r in events} >= {("u1", "PAUSE"), ("u3", "PAUSE")} and len({r["id"] for r in events}) == len(events)
    alerts = pipeline.committed(spark, str(tmp_path / "None" / "out"), pipeline.ALERTS).collect()
    assert {(r["patient_id"], r["severity"]) for r in alerts} == {("p", "CRITICAL")}  # b has no patient


def test_nothing_to_process(spark, given, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    pipeline.commit(none, given[0], given[1], str(tmp_path / "out"), "r", 0)
    assert tables(spark, str(tmp_path / "out")) == {pipeline.EVENTS: [], pipeline.ALERTS: [], pipeline.RESULTS: []}
