"""Boundary values of the scalar functions."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.functions import clinical, clock, text, viewport
from pulsegrid.operators import paging
from pulsegrid.operators.predicates import CardinalityError, Page, ilike_pattern, one, window_hours


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_split_full_name(spark):
    got = values(spark, text.split_full_name, ["A", " A  B C ", "", "  ", None])
    assert [tuple(g) if g else None for g in got] == [("A", ""), ("A", "B C"), None, None, None]


def test_initials(spark):
    assert values(spark, text.initials, ["ana maría lópez", "x", "", None]) == ["AM", "X", "", ""]
    assert values(spark, lambda c: text.initials(c, "··"), ["", "Bo"]) == ["··", "B"]


def test_client_ip_and_mail(spark):
    assert values(spark, lambda c: text.client_ip(c, F.lit("9.9.9.9")), [" 1.2.3.4 , 5.6.7.8", "", None]) == ["1.2.3.4", "9.9.9.9", "9.9.9.9"]
    assert values(spark, text.email_name, ["a.b@c.d", "none"]) == ["a.b", "none"]


def test_lists(spark):
    assert values(spark, lambda c: text.parse_list(c, schemas.PATIENT_STATUSES), ["", "active", "bad,active,active", None]) == [[], ["active"], ["active", "active"], []]
    assert values(spark, lambda c: text.toggle(c, F.lit("b")), [["a"], ["a", "b"]], "array<string>") == [["a", "b"], ["a"]]


def test_blank_and_null(spark):
    assert values(spark, text.blank_to_null, ["", "\t ", " x "]) == [None, None, "x"]
    assert values(spark, text.null_to_blank, [None, "x"]) == ["", "x"]


def test_ids(spark):
    assert values(spark, lambda c: text.padded("d_", c), [7, 1234], "int") == ["d_007", "d_1234"]
    got = values(spark, text.study_id_parts, ["s_p_001_2", "p_001", "s_p_x_1"])
    assert [tuple(g) if g else None for g in got] == [("p_001", 2), None, None]
    assert values(spark, text.serial_of, ["d_003"]) == ["HOLTER-AR-003"]
    assert values(spark, text.thousands, [432000, 12], "bigint") == ["432.000", "12"]


def test_synthetic_email(spark):
    assert values(spark, lambda c: text.synthetic_email(F.lit("Sofía"), c), ["Sánchez", "Rodríguez", "Ááa"]) == ["sofía.sanchez@example.com", "sofía.rodriguez@example.com", "sofía.aáa@example.com"]


def test_search_pattern():
    assert ilike_pattern(" a\\b ") == "%a\\\\b%"
    assert ilike_pattern("  ") == "%%"


def test_durations(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(
        clock.duration_ms(F.lit(0), t("2024-01-01"), F.lit(None).cast("timestamp")), clock.duration_ms(F.lit(None), t("2024-01-01"), F.lit(None).cast("timestamp")),
        clock.duration_ms(F.lit(None), t("2024-01-01 00:00:00"), t("2024-01-01 00:00:01.001")), clock.duration_hours(F.lit(0), F.lit(None).cast("timestamp")),
        clock.duration_hours(F.lit(594_000), F.lit(None).cast("timestamp")), clock.duration_hours(F.lit(1), F.lit(None).cast("timestamp")), clock.running_ms(t("2030-01-01"), "2024-01-01"),
    ).first()
    assert list(row) == [0, 0, int(timedelta(seconds=1, milliseconds=1).total_seconds() * 1000), None, 0.17, 0.0, 0]


def test_duration_text(spark):
    got = values(spark, clock.duration_text, [0, 59_999, 60_000, 90_000, 3_600_000, 3_660_000, -1, None], "bigint")
    assert got == ["0 s", "59 s", "1 min", "1 min 30 s", "1 h", "1 h 1 min", "—", "—"]


def test_timestamp_text(spark):
    assert values(spark, clock.timestamp_text, [-1.0, 0.9, -0.5, 3_599_999.0, 360_000_000.0], "double") == ["-00:00:00.001", "00:00:00.000", "-00:00:00.001", "00:59:59.999", "100:00:00.000"]
    assert values(spark, clock.timestamp_short, [-5.0, 61_000.0], "double") == ["00:00:00", "00:01:01"]


def test_relative_time(spark):
    at = lambda s: F.timestamp_micros(F.unix_micros(clock.at("2024-06-01")) - F.lit(int(s * 1e6)))
    cases = {29: "hace instantes", 30: "hace 1 min", 59.5 * 60: "hace 1 h", 23.5 * 3600: "hace 1 d", 29.5 * 86400: "hace 1 meses", 11.5 * 30 * 86400: "hace 1 años", -7200: "en 2 h"}
    row = spark.range(1).select(*[clock.relative_time(at(s), "2024-06-01").alias(str(i)) for i, s in enumerate(cases)], clock.relative_time(F.lit(None).cast("timestamp"), "2024-06-01").alias("n")).first()
    assert list(row) == [*cases.values(), "—"]


def test_age(spark):
    rows = ["2000-06-02", "2000-06-01", "2000-05-31", "bad", None]
    assert values(spark, lambda c: clock.age_years(c, "2023-06-01"), rows) == [22, 23, 23, 0, 0]
    assert values(spark, lambda c: clock.age_years(c, "2023-02-28"), ["2000-02-29"]) == [22]


def test_daily_window(spark):
    got = values(spark, lambda c: clock.in_daily_window(c.cast("timestamp"), "22:00", "06:00"), ["2024-01-01 21:59:59", "2024-01-01 22:00:00", "2024-01-01 05:59:00", "2024-01-01 06:00:00"])
    assert got == [False, True, True, False]


def test_bands(spark):
    assert [tuple(x) for x in values(spark, clinical.battery_band, [19, 20, 49, 50], "int")] == [("Crítica", "destructive"), ("Baja", "warning"), ("Baja", "warning"), ("OK", "success")]
    assert values(spark, clinical.signal_band, [-69, -70, -85, -100, -101], "int") == ["good", "fair", "poor", "none", "none"]
    assert values(spark, clinical.storage_used, [None, 0, 128, 200], "int") == [0, 128, 0, 0]
    assert values(spark, lambda c: clinical.delta_text(c, "pp"), [0, 2, -3], "int") == ["Sin cambios", "+2 pp", "−3 pp"]
    assert values(spark, clinical.trend, [1, 0, -1], "int") == ["up", "flat", "down"]
    assert values(spark, clinical.backoff_ms, [0, 2, 9], "int") == [1000, 4000, 8000]


def test_watchdog(spark):
    rows = [(10.0, 80, "good"), (10.01, 80, "good"), (float("inf"), None, None), (1.0, 44, "none"), (1.0, 45, "poor"), (1.0, None, "none"), (1.0, None, "fair")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h double, b int, q string")
    got = [r[0] for r in df.orderBy("i").select(clinical.watchdog_reason(F.col("h"), F.col("b"), F.col("q"))).collect()]
    assert got == [None, "offline", "offline", "low_battery", "poor_signal", "poor_signal", None]


def test_clamp(spark):
    cases = [((2.0, 4.0), (2.0, 4.0)), ((-3.0, 1.0), (0.0, 4.0)), ((8.0, 12.0), (6.0, 10.0)), ((-5.0, 20.0), (0.0, 10.0)), ((0.0, 10.0), (0.0, 10.0))]
    df = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(cases)], "i int, lo double, hi double")
    got = [tuple(r[0]) for r in df.orderBy("i").select(viewport.clamp(F.col("lo"), F.col("hi"), F.lit(0.0), F.lit(10.0))).collect()]
    assert got == [b for _, b in cases]


def test_viewport(spark):
    d, f = F.lit(60.0), lambda x: F.lit(float(x))
    row = spark.range(1).select(
        viewport.initial(d).alias("a"), viewport.initial(f(4)).alias("b"), viewport.initial(d, 10.0, f(70), f(80)).alias("c"), viewport.jump_to(f(31_000), f(1_000), f(0), f(10), d).alias("d"), viewport.zoom_about(f(5), f(0), f(10), d, out=False).alias("e"),
        viewport.pan_pixels(f(-50), f(100), f(0), f(10), d).alias("f"), viewport.pan_key(f(0), f(10), d, right=True).alias("g"), viewport.zoom_in(f(0), f(600)).alias("h"), viewport.zoom_out(f(0), f(100), f(150)).alias("i"), viewport.percents(f(0), f(60), f(0), d).alias("j"), viewport.reset(d).alias("k"), viewport.zoom_to(f(-5000), f(5000), f(0), d).alias("l"),
    ).first()
    got = {k: tuple(round(x, 6) for x in v) for k, v in row.asDict().items()}
    assert got == {"a": (50.0, 60.0), "b": (0.0, 4.0), "c": (0.0, 60.0), "d": (25.0, 35.0), "e": (0.833333, 9.166667), "f": (5.0, 15.0), "g": (1.0, 11.0), "h": (50.0, 550.0), "i": (-25.0, 125.0), "j": (0.0, 0.5), "k": (0.0, 60.0), "l": (0.0, 10.0)}


def test_pages():
    assert [(p.pages, p.first, p.last) for p in (paging.page_numbers(1, t) for t in (0, 1, 20, 21))] == [(1, 0, 0), (1, 1, 1), (1, 1, 20), (2, 1, 20)]
    assert paging.page_numbers(0, 5).page == 1 and paging.page_numbers(2, 21).first == 21
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"sort": "x"}, {"order": "up"}):
        with pytest.raises(ValueError):
            Page(**bad)
    with pytest.raises(ValueError):
        window_hours(0)


def test_pages_join_up(spark):
    df = spark.range(57).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("k"))
    order = [F.col("k").desc_nulls_last(), F.col("id").asc()]
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    assert sum(([r["id"] for r in paging.page(df, order, 10, o).collect()] for o in range(0, 60, 10)), []) == whole


def test_one(spark):
    assert one(spark.range(0)) is None and one(spark.range(1)).id == 0
    with pytest.raises(CardinalityError):
        one(spark.range(2))


def test_severity_rank(spark):
    assert values(spark, schemas.severity_rank, ["LOW", "MEDIUM", "HIGH", "CRITICAL", "?"]) == [1, 2, 3, 4, None]


def test_requests(spark):
    from pulsegrid.functions import requests

    rows = [("get", None, None, 0), ("get", None, "ERR_CANCELED", 0), ("GET", 503, None, 1), ("get", 503, None, 2), ("post", 500, None, 0), (None, 600, None, 0), ("get", 404, None, 0), ("get", None, "ETIMEDOUT", 1), ("get", 422, None, 0), ("get", 302, None, 0)]
    df = spark.createDataFrame(rows, "method string, status int, failure string, attempt int")
    got = df.select(requests.error_code(F.col("status"), F.col("failure")), requests.may_retry(F.col("method"), F.col("status"), F.col("failure"), F.col("attempt"))).collect()
    assert [tuple(r) for r in got] == [("NETWORK", True), ("CANCELLED", False), ("SERVER", True), ("SERVER", False), ("SERVER", False), ("SERVER", False), ("NOT_FOUND", False), ("TIMEOUT", True), ("VALIDATION", False), ("UNKNOWN", False)]
    hours = spark.range(7).select(requests.upload_interval_hours(F.col("id"))).collect()
    assert [r[0] for r in hours] == [1, 1, 1, 2, 4, 4, 4]
    steps = [("RECORDING", True, "PREPARING_BATCH"), ("SENDING", False, "SIM_ERROR"), ("SENDING", True, "CONFIRMING"), ("SIM_ERROR", True, "SIM_SLEEPING"), ("SIM_SLEEPING", True, "RECORDING"), ("CLEANING_SD", False, "SIM_SLEEPING"), ("elsewhere", True, None)]
    df = spark.createDataFrame([s[:2] for s in steps], "state string, ok boolean")
    assert [r[0] for r in df.select(requests.next_device_state(F.col("state"), F.col("ok"))).collect()] == [s[2] for s in steps]
    row = spark.sql("select timestamp_seconds(1700000000.9) as t").select(requests.claims(F.lit(7), F.lit("a@b"), F.lit("admin"), F.col("t"), 60).alias("c")).first()["c"]
    assert row.asDict() == {"sub": "7", "email": "a@b", "role": "admin", "iat": 1_700_000_000, "exp": 1_700_003_600}
    df = spark.createDataFrame([('{"token": "x", "user": "u"}',), ("not json",), (None,), ('{"token": 1',)], "text string")
    assert [r[0] if r[0] is None else r[0]["token"] for r in df.select(requests.stored_session(F.col("text"), "token string, user string")).collect()] == ["x", None, None, None]


def test_debounce(spark):
    from pulsegrid.operators import windows

    rows = [("u", 0, "a"), ("u", 100, "ab"), ("u", 350, "abc"), ("u", 900, "x"), ("u", 1200, "xy"), ("v", 0, "q")]
    df = spark.createDataFrame(rows, "who string, ms long, text string").withColumn("at", F.timestamp_millis("ms"))
    assert sorted((r["who"], r["text"]) for r in windows.debounced(df, "who").collect()) == [("u", "abc"), ("u", "x"), ("u", "xy"), ("v", "q")]
