import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import secrets
from tests.llm.conftest import tables

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def texts(n=300, seed=1):
    rng = random.Random(seed)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "passwd", "=", ":", " ", '"', "'", "abc123", "x", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeefdeadbeef", "\n", "é", "𝔘", "token=", "password: token: abcdef12", "a.b=c", "-----BEGIN RSA PRIVATE KEY-----", "ftp://u:pw@h"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_against_python(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*texts(), None, ""])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secrets.op4_secrets(spark, tables(tmp_path, spark, documents=docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[2] == k for w in want) for k in ("assign", "access", "hex")), t
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in secrets.BASE] == (joined.split(",") if joined else [])
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AKIB09 ", max_size=60), st.text(alphabet="0af9g ", max_size=60))
def test_counted_patterns_are_the_same(a, h):
    assert [m.span() for m in re.finditer(secrets.ACCESS, a)] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", a) if len(m[0]) >= 20]
    assert [m.span() for m in re.finditer(secrets.HEX, h)] == [m.span() for m in re.finditer("[0-9a-f]+", h) if len(m[0]) >= 24]


def test_ledger(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    entries = lambda: spark.read.parquet(folder).count()
    old = spark.createDataFrame([("v1", "token = abcdef12"), ("v2", "nothing"), ("v3", "token = abcdef12")], "path string, text string")
    found = secrets.scan_into(old, folder, id_col="path")
    assert entries() == 2 and {r["doc_id"]: len(r["spans"]) for r in found.collect()} == {"v1": 1, "v2": 0, "v3": 1}
    assert secrets.scan_into(old, folder, id_col="path").count() == 3 and entries() == 2  # no blob is scanned again
    new = spark.createDataFrame([("v1", "token = abcdef12"), ("v4", "secret: zyxwvut"), ("v5", "nothing")], "path string, text string")
    found = secrets.scan_into(new, folder, id_col="path")
    assert entries() == 3  # only the blob that is new
    assert {r["doc_id"]: len(r["spans"]) for r in found.collect()} == {"v1": 1, "v4": 1, "v5": 0}
    stale = spark.read.parquet(folder).selectExpr("blob", "rule_version - 1 as rule_version", "spans")
    assert secrets.scan(new, stale, id_col="path")[1].count() == 3


def test_the_query_keeps_a_ledger_where_one_is_named(spark, odd, tmp_path):
    folder, name = tables(tmp_path, spark, documents=odd), f"file://{tmp_path}/kept"
    plain = sorted(map(str, secrets.op4_secrets(spark, folder).collect()))
    spark.conf.set(secrets.LEDGER_SETTING, name)
    try:
        for _ in range(2):
            assert sorted(map(str, secrets.op4_secrets(spark, folder).collect())) == plain
        ledger = spark.read.parquet(name)
        assert ledger.count() == ledger.select("blob").distinct().count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    finally:
        spark.conf.unset(secrets.LEDGER_SETTING)


@pytest.mark.parametrize("rows", [0, 10**6])
def test_texts_move_or_stay(spark, odd, rows, monkeypatch):
    monkeypatch.setattr(secrets, "small", lambda df, *_: df.count() <= rows)
    base = odd.unionByName(odd)
    known, fresh = secrets.scan(base)
    assert known.count() == base.count() and fresh.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    ledger = spark.createDataFrame(fresh.limit(3).collect(), secrets.LEDGER)
    assert secrets.scan(base, ledger)[1].count() == fresh.count() - 3


def test_long_texts_take_time_in_proportion(spark):
    def seconds(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        began = time.monotonic()
        sizes = [len(r[0]) for r in df.select(secrets.spans_of(F.col("text"))).collect()]
        return time.monotonic() - began, sizes

    seconds("password=abcdef12 eyJ :// gh AKIA -----BEGIN ")
    for run in ("a", "z", "eyJ", "A", "AKIA", "-----BEGIN ", "ghp_", "password ", "a.", "://", "eyJaaaaaaaaaaa.", "x://y:"):
        took, _ = seconds(run * (1_000_000 // len(run)))
        assert took < 4, (run, took)
    many = "token=abcdef12 é "
    took, sizes = seconds(many * 100_000)
    assert took < 15 and sizes == [100_000]


def test_positions_of_many_matches(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["token=abcdef12 ", "é" * rng.randrange(9), "token=ab ", "𝔘 "]) for _ in range(5000))
    got = spark.createDataFrame([(text,)], "text string").select(secrets.spans_of(F.col("text")).alias("s")).first()["s"]
    assert [(x["start"], x["rank"], x["kind"], x["end"]) for x in got] == base(text)


def test_odd_tables(spark, odd, none, tmp_path):
    rows = secrets.op4_secrets(spark, tables(tmp_path / "a", spark, documents=odd)).collect()
    assert len(rows) == odd.count() and sum(r["n_assign"] for r in rows) == 1 and sum(r["n_hex"] for r in rows) == 1
    assert secrets.op4_secrets(spark, tables(tmp_path / "b", spark, documents=none)).count() == 0


def test_no_python_in_the_plan(spark, odd, tmp_path):
    plan = secrets.op4_secrets(spark, tables(tmp_path, spark, documents=odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
