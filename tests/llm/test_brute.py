"""The provided documents: near copies, and every stage of the pipeline, against brute force."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from pulsegrid.llm import decontam, langid, linededup, mixing, neardup
from tests.llm.test_classifiers import brute_phrases
from tests.llm.test_tables import compare

SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not all(map(os.path.isdir, SF)), reason="no test tables")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(docs):
    """doc_id -> smallest doc_id of its component of similar pairs; every pair with a shingle in common is compared."""
    sets, holders, parent = {d: shingles(t) for d, t in docs}, defaultdict(list), {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, empty = 0, [d for d, s in sets.items() if not s]
    pairs = set(zip(empty, empty[1:], strict=False))
    for d, own in sets.items():
        common = Counter(o for s in own for o in holders[s])
        pairs |= {(o, d) for o, n in common.items() if n >= 0.8 * (len(own) + len(sets[o]) - n)}
        for s in own:
            holders[s].append(d)
    for a, b in pairs:
        links += 1
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {d: find(d) for d in sets}, links


@pytest.mark.parametrize("sf", SF)
def test_near_copies_of_the_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want, links = groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert links > 5
    assert {r["doc_id"]: r["keeper"]["doc_id"] for r in neardup.near_copies(df).collect()} == want


def test_repeated_lines_lose_no_near_copy(spark):
    import random

    rng, docs = random.Random(4), []
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        line = " ".join(words[50:60])
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words) + f"\n{line}" * 40)]
    want, _ = groups(docs)
    assert len(set(want.values())) == 30
    assert neardup.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).count() == 30


def leaking(docs, items):
    """Documents of which a window of an item's length is similar to it."""
    out = set()
    for _, t in items:
        item = decontam.words(t)
        n, s = len(item), min(5, len(item))
        if not n:
            continue
        bag = lambda w, s=s: Counter(tuple(w[k : k + s]) for k in range(len(w) - s + 1))
        own = bag(item)
        for d, text in docs:
            w = decontam.words(text)
            known = [tuple(w[k : k + s]) in own for k in range(len(w) - s + 1)]
            for a in range(len(w) - n + 1):
                if sum(known[a : a + n - s + 1]) * 2 >= n - s + 1:  # fewer cannot be similar
                    c = bag(w[a : a + n])
                    if sum((c & own).values()) >= 0.8 * sum((c | own).values()):
                        out.add(d)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    sf = SF[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before, outs = rows(docs), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(rows(docs))
    # language: phrases by search in the sample, one text at a time
    parser = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    name = lambda codes: "".join(map(chr, codes))
    kept = set()
    samples = {lang: parser.codes(parser.samples[lang]) for lang in parser.languages}
    for d, r in before.items():
        codes = parser.codes(r["text"])
        pieces = [name(codes[i : i + langid.STRETCH]) for i in range(0, len(codes), langid.STRETCH)]
        if len(codes) > 3000:  # long texts take too long this way
            kept |= {d} & set(outs[0])
            continue
        need = []
        for lang, rate in zip(parser.languages, parser.rate, strict=True):
            phrases = sum(brute_phrases(name(samples[lang][: max(1, len(samples[lang]) * 9 // 10)]), p) for p in pieces)
            need.append(((phrases / max(len(codes), 1)) / rate, (phrases - 2 * phrases**0.5) / max(len(codes), 1) / rate))
        if any(c.isalpha() for c in r["text"]) and min(need)[1] <= langid.UNLIKE:
            kept.add(d)
    assert set(outs[0]) == kept
    con = duckdb.connect()
    for k in range(4):
        con.execute(f"CREATE VIEW kept{k} AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")
    # lines: SQL
    got = [(r["doc_id"], r["text"]) for r in outs[1].values()]
    assert sorted(got) == sorted(con.sql(f"SELECT doc_id, text FROM ({linededup.line_dedup_sql('kept0')})").fetchall())
    # near copies, passages of the benchmark
    want, _ = groups([(d, r["text"]) for d, r in outs[1].items()])
    assert set(outs[2]) == set(want.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(outs[3]) == set(outs[2]) - leaking([(d, r["text"]) for d, r in outs[2].items()], items)
    # the mix: SQL
    compare([r for r in docs.collect()], con, f"SELECT m.*, k.source FROM ({mixing.mixing_sql('kept3')}) m JOIN kept3 k USING (doc_id)")
