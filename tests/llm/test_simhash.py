import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import neardup, simhash
from pulsegrid.llm.components import components


def brute_fingerprint(text, n=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark, odd):
    for r in odd.collect():
        assert simhash.fingerprint((r["text"] or "").encode()) == brute_fingerprint(r["text"])
    # Spark's own xxhash64 is the same function
    assert spark.sql("select xxhash64('the cat sat')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"the cat sat", 42)


def groups(pairs, nodes):
    parent = {v: v for v in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in nodes}


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    tree = simhash.BKTree(values)
    for q in values[::7]:
        assert {tree.values[i] for i in tree.within(q, 4)} == {v for v in values if (v ^ q).bit_count() <= 4}


@pytest.mark.parametrize("radius,rows", [(2, 1024), (2, 8), (3, 8)])
def test_links_against_brute_force(spark, radius, rows):
    rng = random.Random(radius)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            values.add(v)
            v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    keys = df.select(F.col("fp").alias("id"), "fp", F.explode(simhash._shard_keys(F.col("fp"), radius)).alias("k")).select("id", "fp", "k.*")
    got = {r["node"]: r["root"] for r in components(simhash.link(keys, ["which", "one", "two"], radius=radius, shard_rows=rows)).collect()}
    pairs = [(signed(a), signed(b)) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius]
    want = groups(pairs, [signed(v) for v in values])
    same = lambda g: {frozenset(v for v in map(signed, values) if g.get(v, v) == r) for r in map(lambda v: g.get(v, v), map(signed, values))}
    assert same(got) == same(want)


def test_odd_tables(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = {r["doc_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {3, 4, 6, None} and {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 6)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    extra = [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5), (7, 6)]
    edges = chain + extra
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups(edges, sorted({x for e in edges for x in e}))
    assert all(got.get(v, v) == r for v, r in want.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("most", [512, 6])
def test_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "GROUP_ROWS", most)  # also with groups cut into parts
    rng = random.Random(8)
    docs, sets = [], []
    for k in range(30):
        base = words(rng, rng.choice([4, 40, 200, 800]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 4, 12])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            docs.append((len(docs), " ".join(own)))
            sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})
    pairs = [(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = groups(pairs, range(len(docs)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["keeper"]["doc_id"] for r in neardup.near_copies(df).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == sorted(set(want.values()))


def test_keep_one_on_odd_tables(spark, odd, none):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 1, 3, 5, 7, 8, 9]
    assert neardup.keep_one(none).count() == 0


@pytest.mark.parametrize("radius", [2, 3])
def test_a_large_shard_without_a_large_group(spark, radius):
    """Many fingerprints that agree in two blocks and hardly in more: found through further keys, and whole."""
    rng = random.Random(radius)
    n = radius + 2
    free = [64 * i // n for i in range(n + 1)][-radius - 1]  # the upper blocks are free
    values = {(rng.getrandbits(64 - free) << free) | 0x123 for _ in range(300)}
    for v in list(values)[:150]:
        for _ in range(rng.choice([1, 2])):
            w = v
            for b in rng.sample(range(64), radius):
                w ^= 1 << b
            values.add(w)
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    keys = df.select(F.col("fp").alias("id"), "fp", F.explode(simhash._shard_keys(F.col("fp"), radius)).alias("k")).select("id", "fp", "k.*")
    finer = lambda hot: hot.select("*", F.explode(simhash._finer_keys(F.col("fp"), F.col("which"), radius)).alias("_f")).select(*hot.columns, "_f.*")
    found = components(simhash.link(keys, ["which", "one", "two"], radius=radius, shard_rows=32, finer=finer))
    want = groups([(signed(a), signed(b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= radius], [signed(v) for v in values])
    assert {r["node"]: r["root"] for r in found.collect()} == {v: r for v, r in want.items() if list(want.values()).count(r) > 1}
    linked = simhash.near_duplicates(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "q r s")], "doc_id bigint, text string"), shard_rows=1)
    assert {r["doc_id"]: r["component_id"] for r in linked.collect()} == {1: 1, 2: 1, 3: 3}
