"""One batch or many micro-batches, shuffled and repeated: the same tables."""

import itertools
import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.streaming import ingest, status

T0 = 1_700_000_000 // 3600 * 3600


def payload(device, hour, battery=50, chunk=None, total=None, data="AAAA"):
    return {"device_id": device, "batch_timestamp": T0 + hour * 3600, "duration_seconds": 3600, "sample_rate": 250, "num_channels": 1, "num_samples": 2, "compression_type": "delta", "battery_pct": battery, "sd_free_mb": 100, "firmware_version": "1", "data": data, "chunk_index": chunk, "total_chunks": total}


LANDED = itertools.count(1_600_000_000)


def land(folder, name, rows):
    """Files are taken by their time, so each gets a later one."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    when = next(LANDED)
    os.utime(folder / name, (when, when))


def test_duplicates_across_runs(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [payload(d, h) for d in "ab" for h in range(6)]
    random.Random(1).shuffle(rows)
    for i in range(3):
        land(src, f"{i}.json", rows[i * 4 : i * 4 + 8] + rows[:2])
        ingest.write_stream(ingest.flat(ingest.uploads(spark, str(src))), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 12 and got.select(*ingest.KEY).distinct().count() == 12


def test_late_rows_take_the_repair_path(spark, tmp_path):
    src, out, late, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "ck")
    land(src, "0.json", [payload("a", 100), payload("a", 60), payload("a", 40)])
    ingest.write_stream(ingest.flat(ingest.uploads(spark, str(src))), out, ck, repair_path=late).awaitTermination()
    land(src, "1.json", [payload("a", 100), payload("a", 101)])  # one of them again
    ingest.write_stream(ingest.flat(ingest.uploads(spark, str(src))), out, ck, repair_path=late).awaitTermination()
    stored, old = spark.read.parquet(out), spark.read.parquet(late)
    assert sorted((r[0] - T0) // 3600 for r in stored.select("batch_timestamp").collect()) == [60, 100, 101]
    assert [(r[0] - T0) // 3600 for r in old.select("batch_timestamp").collect()] == [40]
    assert ingest.repair(stored.drop("date"), old.unionByName(old)).count() == 1


def test_status_fold(spark, tmp_path):
    rows = [payload("a", 3, 30), payload("a", 5, 20), payload("a", 4, 25), payload("b", 1, 90)]
    devices = spark.createDataFrame([("a", datetime(2024, 1, 1), datetime(2024, 1, 1), None, "S", "m", None, "h", None, datetime(2000, 1, 1), 99, 1, "available"), ("c", datetime(2024, 1, 1), datetime(2024, 1, 1), None, "S2", "m", None, "h", None, None, None, None, "available")], schemas.DEVICE)
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.UPLOAD_FLAT.__class__([schemas.UPLOAD_FLAT[k] for k in rows[0]]))
    one = status.fold_status(devices, status.latest_status(batch))
    two = devices
    for r in reversed(rows):
        two = status.fold_status(two, status.latest_status(spark.createDataFrame([tuple(r.values())], batch.schema)))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert {r["id"]: r["last_battery_pct"] for r in one.collect()} == {"a": 20, "c": None}
    src = tmp_path / "in"
    for i, r in enumerate(rows):
        land(src, f"{i}.json", [r])
    status.fold_stream(ingest.flat(ingest.uploads(spark, str(src), files=1)), str(tmp_path / "st"), str(tmp_path / "ck")).awaitTermination()
    last = status.known_status(spark, str(tmp_path / "ck"))
    assert sorted(map(str, last.collect())) == sorted(map(str, status.latest_status(batch).collect()))
    changes = spark.read.parquet(str(tmp_path / "st"))
    # the reading of hour 4 comes after that of hour 5 and changes nothing
    assert sorted((r["device_id"], r["last_battery_pct"], r["batch"]) for r in changes.collect()) == [("a", 20, 1), ("a", 30, 0), ("b", 90, 3)]


def test_chunks(spark):
    rows = [payload("a", 1, chunk=1, total=2, data="BB"), payload("a", 1, chunk=0, total=2, data="AA"), payload("a", 1, chunk=0, total=2, data="AA"), payload("a", 2, chunk=0, total=2, data="CC"), payload("b", 1, data="DD")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.UPLOAD_FLAT.__class__([schemas.UPLOAD_FLAT[k] for k in rows[0]]))
    assert sorted((r["device_id"], r["data"]) for r in ingest.reassembled(df).collect()) == [("a", "AABB"), ("b", "DD")]
    assert [(r["have"], r["total_chunks"]) for r in ingest.incomplete(df).collect()] == [(1, 2)]


def test_nested_payloads(spark):
    row = ("a", "1", 50, 100, [(T0, 3600, 250, 2, "delta", "AAAA"), (T0 + 3600, 3600, 250, 2, "delta", "BBBB")], None, None)
    got = ingest.flat(spark.createDataFrame([row], schemas.UPLOAD_NESTED))
    assert got.count() == 2 and set(schemas.UPLOAD_FLAT.fieldNames()) == set(got.columns)


def test_windows(spark):
    rows = [payload("a", h) for h in (0, 1, 2, 5, 6)]
    df = ingest.timed(spark.createDataFrame([tuple(r.values()) for r in rows], schemas.UPLOAD_FLAT.__class__([schemas.UPLOAD_FLAT[k] for k in rows[0]])))
    assert ingest.hourly(df).count() == 5
    assert sorted(r["batches"] for r in ingest.sessions(df).collect()) == [2, 3]
    assert ingest.rolling(df, 24).agg(F.max("batches")).first()[0] == 5
    late = datetime.fromtimestamp(T0 + 8 * 3600 + 1, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    assert status.silent(df, late, 2).count() == 1 and status.silent(df, late, 3).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], schemas.UPLOAD_FLAT.__class__([schemas.UPLOAD_FLAT[k] for k in rows[0]]))


def test_a_late_chunk_is_repaired(spark):
    stored = ingest.timed(frame(spark, [payload("a", 1, chunk=0, total=2, data="AA"), payload("b", 1, data="DD")]))
    late = ingest.timed(frame(spark, [payload("a", 1, chunk=0, total=2, data="AA"), payload("a", 1, chunk=1, total=2, data="BB"), payload("a", 1, chunk=1, total=2, data="BB"), payload("b", 1, chunk=0, data="DD"), payload("c", 1)]))
    found = ingest.repair(stored, late)
    assert sorted((r["device_id"], r["chunk_index"]) for r in found.collect()) == [("a", 1), ("c", 0)]
    whole = ingest.reassembled(stored.unionByName(found))
    assert {r["device_id"]: r["data"] for r in whole.collect()} == {"a": "AABB", "b": "DD", "c": "AAAA"}


def test_only_the_days_and_devices_of_a_batch_are_read(spark, tmp_path):
    store = ingest.timed(frame(spark, [payload(d, h, chunk=0) for d in "abc" for h in (0, 48, 96)])).withColumn("date", F.to_date("event_time"))
    store.write.partitionBy("device_id", "date").parquet(str(tmp_path / "store"))
    again = ingest.timed(frame(spark, [payload("a", 48), payload("b", 49)]))
    part = ingest._stored(again, spark.read.schema(store.schema).parquet(str(tmp_path / "store")))
    assert sorted((r["device_id"], (r["batch_timestamp"] - T0) // 3600) for r in part.collect()) == [("a", 48), ("b", 48)]
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString() or "PartitionFilters" in part._jdf.queryExecution().toString()


@pytest.mark.parametrize("zone", ["UTC", "America/Argentina/Buenos_Aires"])
def test_a_device_that_comes_back_is_not_silent(spark, tmp_path, zone):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    days = [[payload("gone", 0), payload("back", 0), payload("on", 0)], [payload("back", 30), payload("on", 20)], [payload("on", 40), payload("back", 41)], [payload("on", 120)], [payload("on", 121), payload("gone", 110)], [payload("on", 190)], [payload("on", 191)]]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for i, rows in enumerate(days):  # each run goes on from the checkpoint
            land(src, f"{i}.json", rows)
            batches = ingest.flat(ingest.uploads(spark, str(src)))
            status.silent_stream(batches, 24, late="48 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = [((r["a"] - T0 * 1000) / 3_600_000, (r["b"] - T0 * 1000) / 3_600_000, r["device_id"]) for r in spark.read.parquet(out).select("device_id", F.unix_millis("last_seen_at").alias("a"), F.unix_millis("silent_since").alias("b")).collect()]
        assert sorted(got) == [(0, 24, "gone"), (41, 65, "back"), (110, 134, "gone")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/Argentina/Buenos_Aires"])
def test_ten_hours_are_ten_hours(spark, tmp_path, zone):
    """A device is reported after ten hours, not before, in any zone."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for k, (hour, found) in enumerate(((8.2, 0), (9.9, 0), (10.1, 1))):
            src = tmp_path / f"in{k}"
            rows = [payload("a", 0), payload("b", 0) | {"batch_timestamp": T0 + int(hour * 3600)}]
            for i in range(3):
                land(src, f"{i}.json", [rows[0]] if i == 0 else [rows[1] | {"batch_timestamp": rows[1]["batch_timestamp"] + i}])
            stream = status.silent_stream(ingest.flat(ingest.uploads(spark, str(src), files=1)), 10, late="0 seconds")
            stream.writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", str(tmp_path / f"ck{k}")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
            assert spark.read.schema(stream.schema).parquet(str(tmp_path / f"out{k}")).filter("device_id = 'a'").count() == found
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_grows_with_devices_only(spark, tmp_path):
    """Each micro-batch writes its own devices, however many are known."""
    src = tmp_path / "in"
    land(src, "0.json", [payload(f"d{i}", 0) for i in range(300)])
    for k in range(1, 4):
        land(src, f"{k}.json", [payload("d7", k, battery=k), payload("d9", -k)])
    status.fold_stream(ingest.flat(ingest.uploads(spark, str(src), files=1)), str(tmp_path / "st"), str(tmp_path / "ck")).awaitTermination()
    per = {r["batch"]: r["count"] for r in spark.read.parquet(str(tmp_path / "st")).groupBy("batch").count().collect()}
    assert per == {0: 300, 1: 1, 2: 1, 3: 1}
    known = {r["device_id"]: r["last_battery_pct"] for r in status.known_status(spark, str(tmp_path / "ck")).collect()}
    assert len(known) == 300 and known["d7"] == 3 and known["d9"] == 50


def test_nothing_that_lands_is_lost(spark, tmp_path):
    src, out, late, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "ck")
    good = [payload(d, h) for d in "ab" for h in (100, 101)]
    bad = [payload("a", 100) | {"batch_timestamp": None}, payload(None, 100), payload("  ", 100), payload("a", 99, data=None), payload("a", 98) | {"batch_timestamp": "soon"}]
    old = [payload("a", 3), payload("b", 4)]
    land(src, "0.json", [*good, *bad, *old, "{no json", "[1]"])
    land(src, "1.json", [payload("c", 100) | {"batch_timestamp": None}])
    batches = lambda: ingest.flat(ingest.uploads(spark, str(src), files=1, corrupt=True))
    ingest.write_stream(batches(), out, ck, repair_path=late).awaitTermination()
    aside = spark.read.parquet(f"{late}-quarantine")
    assert spark.read.parquet(out).count() == len(good) and spark.read.parquet(late).count() == len(old)
    reasons = {r["reason"]: r["count"] for r in aside.groupBy("reason").count().collect()}
    assert reasons == {"NO_TIMESTAMP": 2, "NO_DEVICE": 2, "NO_DATA": 1, "UNREADABLE": 3}
    assert aside.filter("_corrupt_record like '{no json%'").count() == 1
    # a micro-batch that runs again, as after a lost commit, adds nothing
    for f in (tmp_path / "ck" / "commits").glob("*1*"):
        f.unlink()
    land(src, "2.json", [payload("a", 102)])
    ingest.write_stream(batches(), out, ck, repair_path=late).awaitTermination()
    assert (spark.read.parquet(out).count(), spark.read.parquet(late).count(), spark.read.parquet(f"{late}-quarantine").count()) == (len(good) + 1, len(old), 8)


def test_nested_payloads_without_batches_are_quarantined(spark):
    rows = spark.createDataFrame([("a", "1", 50, 100, None, None, None), ("b", "1", 50, 100, [], None, None), ("c", "1", 1, 1, [(T0, 3600, 250, 2, "delta", "AAAA")], None, None)], schemas.UPLOAD_NESTED)
    good, bad = ingest.routed(ingest.flat(rows))
    assert [r["device_id"] for r in good.collect()] == ["c"] and sorted((r["device_id"], r["reason"]) for r in bad.collect()) == [("a", "NO_TIMESTAMP"), ("b", "NO_TIMESTAMP")]


def test_batch_states(spark):
    b = spark.createDataFrame([("1", "PENDING", None), ("2", "DONE", None), ("3", "PROCESSING", None)], "id string, processing_status string, processing_error string")
    r = spark.createDataFrame([("1", "FAILED", "bad"), ("2", "FAILED", "late"), ("3", "DONE", None)], "id string, processing_status string, processing_error string")
    assert {x["id"]: (x["processing_status"], x["processing_error"]) for x in status.advance(b, r).collect()} == {"1": ("FAILED", "bad"), "2": ("DONE", None), "3": ("DONE", None)}
