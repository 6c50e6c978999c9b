"""Periodic runs against the definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pulsegrid.llm import periodic
from tests.llm.conftest import tables


def by_definition(x, least):
    """Every run of a sequence, tried period by period."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)  # periods rise, so the first is the smallest
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def sequence(rng):
    kind, n = rng.randrange(6), rng.choice([0, 1, 2, 5, 13, 40, 150])
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(rng.choice([1, 3, 50])) for _ in range(n)]
    if kind == 2:  # Fibonacci word: the most runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    while len(out) < n:  # periodic stretches, copied about
        base = [rng.randrange(4) for _ in range(rng.randrange(1, 7))]
        out += (base * rng.randrange(1, 9))[: rng.randrange(1, 30)]
        if out and kind == 5:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(40)]
    return out[:n]


@pytest.mark.parametrize("least", [2, 3, 6, 12])
def test_runs_by_definition(least, monkeypatch):
    rng = random.Random(least)
    for turn in range(120):
        monkeypatch.setattr(periodic, "JUMPS", 64 if turn % 3 else 1)
        monkeypatch.setattr(periodic, "LEVELS", 13 if turn % 2 else 3)
        monkeypatch.setattr(periodic, "PAIRS", 1 << 20 if turn % 2 else 7)
        texts = [sequence(rng) for _ in range(rng.randrange(1, 12))]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = periodic.find_runs(np.array([w for t in texts for w in t], dtype=np.int64), at, least)
        want = [(d, *r) for d, t in enumerate(texts) for r in by_definition(t, least)]
        assert list(map(tuple, got.tolist())) == want


def test_previous_factors():
    rng = random.Random(5)
    for _ in range(60):
        x = sequence(rng)
        if not x:
            continue
        length, start = periodic.Factors(np.array(x), np.array([0, len(x)])).previous()
        for i in range(len(x)):
            most = max((next((k for k in range(len(x) - i) if x[i + k] != x[j + k]), len(x) - i) for j in range(i)), default=0)
            assert length[i] == most
            assert most == 0 or (start[i] < i and x[start[i] : start[i] + most] == x[i : i + most])


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_definition(words, 12)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_by_definition(spark, odd, tmp_path):
    rng = random.Random(9)
    made = [(i, " ".join(f"w{w}" for w in sequence(rng)) if rng.random() < 0.5 else rng.choice([" ", "\n", " \t"]).join(rng.choice(["ein", "zwei", "é", "x"]) for _ in range(rng.randrange(120)))) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    df = df.unionByName(odd.select("doc_id", "text").filter("length(text) is null or length(text) < 1000"))
    rows = periodic.op11_periodic_runs(spark, tables(tmp_path, spark, documents=df)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=key) == sorted((expected(r["doc_id"], r["text"]) for r in df.collect()), key=key)
    assert sum(r["n_runs"] > 0 for r in rows) > 60


def test_odd(spark, odd, none, tmp_path):
    rows = periodic.periodic_runs(odd).collect()
    assert len(rows) == odd.count() and periodic.periodic_runs(none).count() == 0
    (long,) = [r for r in rows if r["doc_id"] == 5]
    assert long["n_words"] == 36_000 and [tuple(r) for r in long["runs"]] == [(0, 36_000, 9)]
    assert long["collapsed"] == "the quick brown fox jumps over the lazy dog"
    assert periodic.op11_periodic_runs(spark, tables(tmp_path, spark, documents=none)).count() == 0
