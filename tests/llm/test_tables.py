"""Mixing, line dedup and decontamination."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontam, linededup, mixing
from tests.llm.conftest import tables


def compare(rows, con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in sorted(r.asDict())) for r in rows), key=key) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)


def duck(df):
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    con.register("raw", documents)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, n_chars FROM raw")
    return con


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["b", "c", "d", None])
        lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 6))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), f"Home | About {source}")
        rows.append((i, rng.choice(["\n", "\r\n"]).join(lines), "en", source, 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_mixing_against_sql(spark, odd, tmp_path):
    for k, df in enumerate((corpus(spark), odd.filter("doc_id is not null"))):
        rows = mixing.op7_mixing(spark, tables(tmp_path / str(k), spark, documents=df)).collect()
        compare(rows, duck(df), mixing.SQL["op7_mixing"])


def test_mixing_budgets(spark):
    df = corpus(spark, 300, 2)
    rows = mixing.mix(df, rows_per_range=16).collect()
    again = mixing.mix(df, rows_per_range=4096).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))  # ranges do not change the result
    per = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(p[0]["target"] for p in per.values()) - total) < 1e-6 * total
    for source, p in per.items():
        assert p[0]["source_size"] == sum(r["size"] for r in p) and abs(sum(r["taken"] for r in p) - p[0]["target"]) <= 1
        assert p[0]["target"] <= 3 * p[0]["source_size"]


def water(sizes, weights):
    """Share by weight, stop at three times the size, reshare the excess until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= sum(3 * sizes[i] for i in over)
        open_ -= set(over)
    return target


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 5, 50, 1000, 40_000]) for _ in range(rng.randrange(1, 9))]
        df = spark.createDataFrame([(f"s{i}", 1, s) for i, s in enumerate(sizes)], "source string, n bigint, source_size bigint")
        got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
        assert got == pytest.approx(water(sizes, [1 + i % 3 for i in range(len(sizes))]))


def test_mixing_odd(spark, odd, none, tmp_path):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    plan = mixing.op7_mixing(spark, tables(tmp_path, spark, documents=odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_line_dedup_against_sql(spark, odd, tmp_path):
    for k, df in enumerate((corpus(spark, 300, 5), odd)):
        rows = linededup.op6_line_dedup(spark, tables(tmp_path / str(k), spark, documents=df)).collect()
        compare(rows, duck(df), linededup.SQL["op6_line_dedup"])
    assert sum(r["dropped_lines"] for r in linededup.op6_line_dedup(spark, str(tmp_path / "0")).collect()) > 50


def test_line_dedup_by_hand(spark, monkeypatch):
    rows = [(i, "h", f"menu\n  body {i}\n\nmenu\nshared" if i < 8 else f"body {i}\nshared") for i in range(10)] + [(10, "g", "menu\nalone"), (11, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, host string, text string")
    want = {i: f"  body {i}\n\nshared" if i < 8 else f"body {i}\nshared" for i in range(10)} | {10: "menu\nalone", 11: None}
    for most in (200_000, 0):  # the second way, without a broadcast
        monkeypatch.setattr(linededup, "BROADCAST_HASHES", most)
        out = linededup.drop_boilerplate(df, F.col("host"), ratio=0.79, least=2).collect()
        got = {r["doc_id"]: r["text"] for r in out}
        want_now = {i: (t.replace("\nshared", "") if t and i < 10 else t) for i, t in want.items()}
        assert got == want_now
    # a line at the ratio stays
    kept = linededup.drop_boilerplate(df, F.col("host"), ratio=0.8, least=2).filter("doc_id = 0").first()
    assert kept["text"] == "menu\n  body 0\n\nmenu"


def test_line_dedup_odd(spark, odd, none):
    marked = odd.withColumn("_dropped_lines", F.lit(7))
    out = linededup.drop_boilerplate(marked, F.col("source"), ratio=0.3, least=2, count="went")
    assert out.count() == odd.count() and out.filter("went > 0").count() == 3 and out.filter("_dropped_lines = 7").count() == odd.count()
    assert linededup.drop_boilerplate(marked, F.col("source")).columns == marked.columns
    assert linededup.drop_boilerplate(none, F.col("source")).count() == 0


def test_lines_keep_their_ends(spark):
    rows = [(0, "menu\r\na\rmenu\nb\r\n\r\nc\nmenu"), (1, "menu"), (2, "x\r\nmenu\r\n"), (3, "y\r\nz\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in linededup.drop_boilerplate(df, F.lit("h"), ratio=0.5, count="n").collect()}
    assert got == {0: ("a\rb\r\n\r\nc", 3), 1: ("", 1), 2: ("x\r\n", 1), 3: ("y\r\nz\n", 0)}
    # two pages are few, but what stands on both is repeated; what stands on one is not
    pair = spark.createDataFrame([(0, "menu\nown"), (1, "menu\nother")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in linededup.drop_boilerplate(pair, F.lit("h")).collect()) == ["other", "own"]
    assert linededup.drop_boilerplate(pair.limit(1), F.lit("h")).first()["text"] == "menu\nown"


def test_line_dedup_of_pages_against_sql(spark, tmp_path):
    rows = [(i, url, html) for i, (url, html) in enumerate([("https://A.example.com/x?q=1", "<nav>\n<p>one</p>\n</html>"), ("http://a.example.com:80/y", "<nav>\r\n<p>two</p>\r\n</html>"), ("https://b.example/#z", "<nav>\n<p>three</p>"), (None, "<nav>\nq"), (None, None), ("nonsense", "<nav>"), ("https://b.example", "")])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = linededup.line_dedup_pages(spark, tables(tmp_path, spark, pages=pages)).collect()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    compare(got, con, linededup.SQL["line_dedup_pages"])
    assert {r["page_id"]: r["dropped_lines"] for r in got} == {0: 2, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def brute_leaks(docs, items):
    found = {}
    for i, t in items:
        item = decontam.words(t)
        n = len(item)
        if not n:
            continue
        s = min(5, n)
        shingles = lambda w: Counter(tuple(w[k : k + s]) for k in range(len(w) - s + 1))  # noqa: B023, E731
        own = shingles(item)
        for d, text in docs:
            w = decontam.words(text)
            for a in range(len(w) - n + 1):
                c = shingles(w[a : a + n])
                low, high = sum((c & own).values()), sum((c | own).values())
                if low >= 0.8 * high and low / high > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (low / high, a)
    return found


def test_decontamination(spark, tmp_path):
    rng = random.Random(7)
    items = [(i, " ".join(f"b{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 5, 12, 30, 60])))) for i in range(25)] + [(98, None), (99, " .,; "), (100, "b1 b2 b1 b2 b1 b2 b1 b2")]
    docs = []
    for d in range(80):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage = decontam.words(items[rng.randrange(25)][1])
            own = [p.decode() for p in passage]
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = "zz"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((d, ", ".join(w).upper() if d % 9 == 0 else " ".join(w)))
    docs += [(80, None), (81, ""), (82, "b1 b2 " * 40), (83, "b1 b2 b1 b2 b1 b2 b1 b2")]
    want = brute_leaks(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (20_000, 7):  # also in blocks of items
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(d, b, block_items=block).collect()}
        assert got == pytest.approx({k: v[0] for k, v in want.items()})
        kept = {r["doc_id"] for r in decontam.drop_leaks(d, b, block_items=block).collect()}
        assert kept == {x for x, _ in docs} - {x for x, _ in want}
    assert len(want) > 20
    assert decontam.op9_decontaminate(spark, tables(tmp_path, spark, documents=d, benchmark=b)).count() == len(want)


def test_blocks_guarantee_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    shingles = [rng.integers(0, 2**63, 8, dtype=np.uint64) for _ in range(40)]
    size = decontam._Size(12, list(range(40)), shingles)
    windows = np.concatenate([size.prints ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in range(1, 26)])
    w, i = size.candidates(windows)
    want = {(a, b) for a in range(len(windows)) for b in range(40) if int(windows[a] ^ size.prints[b]).bit_count() <= decontam.RADIUS}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


def test_decontamination_odd(spark, odd, none):
    b = spark.createDataFrame([(None, "the cat sat on the mat and looked at the dog"), (1, None)], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontam.leaks(odd, b).collect()) == [1, 1, 2]
    assert decontam.drop_leaks(odd, b).columns == odd.columns and decontam.drop_leaks(odd, b).count() == odd.count() - 3
    for kind, value in (("smallint", 3), ("double", 2.5), ("string", "q"), ("date", "2024-01-02")):
        item = spark.createDataFrame([("the cat sat on the mat and looked at the dog",)], "text string").withColumn("item_id", F.lit(value).cast(kind))
        assert [str(r["item_id"]) for r in decontam.leaks(odd, item).collect()] == [str(value)] * 3
    assert decontam.leaks(none, b).count() == 0 and decontam.leaks(odd, b.limit(0)).count() == 0
