"""Joins, sets, validation, sinks and the clinical pipeline."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates, joins, predicates, rhythm, sets, validation
from pulsegrid.sources import signals, synthetic, tables


def test_search_traps(spark):
    df = spark.createDataFrame([("1", "Ana", "Lópe%z", None), ("2", "B_o", "x\\y", "123"), ("3", None, None, None)], "id string, first_name string, last_name string, dni string")
    ids = lambda q: sorted(r["id"] for r in predicates.patient_search(df, q).collect())
    assert ids(None) == ids("") == ["1", "2", "3"]
    assert ids("  ") == ["1", "2", "3"] and ids("ana l") == ["1"] and ids("x\\y") == ["2"] and ids("12") == ["2"] and ids("b_o") == ["2"]


def test_session(spark):
    t = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([("a", None, True, t(2)), ("b", None, True, None), ("c", None, False, None), ("d", t(1), True, None)], "id string, deleted_at timestamp, is_active boolean, last_logout_at timestamp")
    ids = lambda d: sorted(r["id"] for r in predicates.valid_session(df, F.lit(t(d))).collect())
    assert ids(2) == ["b"] and ids(3) == ["a", "b"]
    assert [r[0] for r in spark.createDataFrame([("admin",), ("medico",), ("x",)], "r string").select(predicates.allowed_role(F.col("r"), ["medico"])).collect()] == [True, True, False]


def test_interval_ties(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    s = spark.createDataFrame([("s1", "d", t(0), t(10), None), ("s2", "d", t(2), None, None), ("s3", "d", t(2), t(5), None), ("s4", "d", t(3), t(3), None)], "id string, device_id string, started_at timestamp, ended_at timestamp, deleted_at timestamp")
    e = spark.createDataFrame([("e1", "d", t(1)), ("e2", "d", t(2)), ("e3", "d", t(12)), ("e4", "x", t(1)), ("e5", "d", t(20))], "id string, device_id string, t timestamp")
    got = {r["id"]: r["study_id"] for r in joins.containing_study(e, s, "2024-01-01 20:00:00", time="t", key="id").collect()}
    assert got == {"e1": "s1", "e2": "s2", "e3": "s2", "e4": None, "e5": None}


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"],)], "l array<string>")
    row = df.select(sets.add(F.col("l"), F.lit("b")), sets.add(F.col("l"), F.lit("c")), sets.remove(F.col("l"), F.lit("a"))).first()
    assert list(row) == [["a", "b"], ["a", "b", "c"], ["b"]]


def test_rules(spark):
    rows = [("Ana Paz", "12345678", "1990-01-01", "F", ""), ("A", "1234", "2090-01-01", "Q", "bad@"), ("Ana", "12345678", "1900-12-31", "X", "a.b@c.de")]
    df = spark.createDataFrame(rows, "full_name string, dni string, birth_date string, sex string, contact_email string")
    good, bad = validation.quarantine(df, validation.patient_form_rules("2024-01-01"))
    assert good.count() == 1
    assert sorted(r["broken_rules"] for r in bad.collect()) == [["birth_date"], ["name", "dni", "birth_date", "sex", "email"]]
    d = spark.createDataFrame([("HOLTER-AR-001", "ab", None), ("HOLTER-AR-1", "a", None)], "serial string, model string, firmware_version string")
    assert validation.quarantine(d, validation.device_form_rules())[0].count() == 1 and validation.quarantine(d, validation.device_rules())[0].count() == 2
    u = spark.createDataFrame([("4F8B2C2E-0000-4000-8000-000000000000",), ("x",)], "u string")
    assert [r[0] for r in u.select(validation.is_uuid(F.col("u"))).collect()] == [True, False]


def test_kpi_of_nothing(spark):
    p = spark.createDataFrame([], "study_status string, created_at timestamp, deleted_at timestamp")
    a = spark.createDataFrame([], "created_at timestamp, deleted_at timestamp, acknowledged_at timestamp")
    s = spark.createDataFrame([], "status string, started_at timestamp, ended_at timestamp, deleted_at timestamp")
    row = aggregates.kpis(p, a, s, "2024-01-01").first()
    assert (row["active_patients"], row["pending_alerts_trend"], row["running_studies"]) == (0, "flat", 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1_700_000_000, "x"), ("d2", 1_700_100_000, "y")], "device_id string, batch_timestamp bigint, data string")
    tables.write_batches(df, str(tmp_path / "b"))
    tables.write_batches(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("device_id = 'd1' and date = '2023-11-14'").count() == 2
    assert df.select(tables.batch_key()).first()[0] == "ecg/d1/2023-11-14/1700000000.bin"
    tables.export_csv(df, str(tmp_path / "c"), files=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_scans_prune_and_push(spark, tmp_path):
    from pulsegrid import schemas

    spark.createDataFrame([], schemas.PATIENT).write.parquet(str(tmp_path / "p"))
    rows = predicates.members(predicates.tenant(predicates.live(tables.scan(spark, str(tmp_path / "p"), "patient")), "dr"), "study_status", ["active"]).select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert all(p in plan for p in ("IsNull(deleted_at)", "EqualTo(doctor_id,dr)", "EqualTo(study_status,active)"))
    assert "notes" not in plan


def test_clinical_pipeline(spark):
    wave = np.round(synthetic.ecg("x", 60) * 1000).astype(int)[:, None]
    rows = [("b1", signals.encode_payload(wave), 1, "delta", 250), ("b2", "!", 1, "delta", 250)]
    b = spark.createDataFrame(rows, "id string, data string, num_channels int, compression_type string, sample_rate int")
    events, status = rhythm.process(b, signals.decode_batches(b).cache())
    assert {r["id"]: r["processing_status"] for r in status.collect()} == {"b1": "DONE", "b2": "FAILED"}
    assert set(events.columns) == {"batch_id", "event_type", "severity", "timestamp_in_recording", "duration_seconds", "confidence_score"}


def test_projections(spark):
    from pulsegrid.operators import projections

    df = spark.createDataFrame([(" Ana ", " 1 ", "1990-01-01", "F", " ", "x ")], "full_name string, dni string, birth_date string, sex string, contact_email string, contact_phone string")
    assert list(projections.patient_form_to_input(df).first()) == ["Ana", "1", "1990-01-01", "F", None, "x"]
    assert projections.to_camel(df).columns == ["fullName", "dni", "birthDate", "sex", "contactEmail", "contactPhone"]
    assert projections.to_snake(projections.to_camel(df)).columns == df.columns
    back = projections.patient_to_form(projections.patient_form_to_input(df).withColumn("id", F.lit("p"))).first()
    assert back["contact_email"] == "" and back["contact_phone"] == "x"
    d = spark.createDataFrame([(" s ", "m ", "  ")], "serial string, model string, firmware_version string")
    assert list(projections.device_form_to_input(d).first()) == ["s", "m", None]


def test_tables_of_a_database(spark):
    """The relational connector, against the database that Spark brings along."""
    url = "jdbc:derby:memory:pulsegrid;create=true"
    rows = spark.createDataFrame([(i, f"p_{i}", None if i % 3 else f"n{i}") for i in range(20)], "n int, id string, dni string")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.jdbc(url, '"patient"', mode="overwrite", properties=driver)
    whole = tables.scan_jdbc(spark, url, "patient", **driver)
    parts = tables.scan_jdbc(spark, url, "patient", key="n", bounds=(0, 20), parts=4, **driver)
    assert parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.collect()))
    plan = whole.filter("id = 'p_3'").select("dni")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *EqualTo(id,p_3)]" in plan
