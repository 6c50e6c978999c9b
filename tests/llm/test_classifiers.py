import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import labelled as labelled_rows
from pulsegrid.llm import langid, quality, toxicity
from tests.llm.conftest import tables


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    plain = ["river", "stone", "walking", "through", "morning", "light", "garden", "yellow", "house", "travels", "under", "quiet", "evening", "people", "small"]
    docs, labels = [], []
    for i in range(600):
        text, q, t = prose(rng, rng.randrange(20, 80), plain), 1, 0
        if i % 5 == 1:
            text, q = " ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 7 == 2:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "idi0t", "morron", "stupid"]))
            text, t = " ".join(w), 1
        docs.append((i, text, "en", "s", len(text)))
        if i % 2 == 0 or i % 5 == 1 or i % 7 == 2:
            labels.append((i, q, t))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "some text", "en", "s", 3)]
    labels += [(0, 1, 0), (1000, None, None), (None, 1, 0), (5000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def check(rows, labels, docs, column, threshold):
    assert len(rows) == docs
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r[column] for r in labels if r[column] is not None}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] is not None]
    return sum(p == t for p, t in held) / len(held)


def test_quality(spark, labelled, tmp_path):
    docs, labels = labelled
    rows = quality.op2_quality(spark, tables(tmp_path, spark, documents=docs, labels=labels)).collect()
    assert check(rows, labels.collect(), docs.count(), "quality", 0.3) > 0.95


def test_toxicity(spark, labelled, tmp_path):
    docs, labels = labelled
    rows = toxicity.op3_toxicity(spark, tables(tmp_path, spark, documents=docs, labels=labels)).collect()
    assert check(rows, labels.collect(), docs.count(), "toxic", 0.5) > 0.95


def test_unseen_misspelling():
    rng = random.Random(3)
    plain = ["river", "stone", "walking", "morning", "light", "garden", "yellow", "house"]
    found, toxic = [], []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            w[3] = w[9] = rng.choice(["idiot", "moron"])
        found.append(" ".join(w).encode())
        toxic.append(i % 3 == 0)
    model = toxicity.fit(found, np.array(toxic), np.ones(300))
    clean, seen, unseen = model.scores([b"river stone light garden house yellow", b"river stone idiot garden house yellow", b"river stone idiott garden house yellow"])
    assert clean < 0.5 < min(seen, unseen)


def test_ngrams_stay_in_their_text():
    together = [h for h, _ in toxicity.ngrams([b"ab", b"cdefgh", b""])]
    apart = [[h for h, _ in toxicity.ngrams([t])] for t in (b"ab", b"cdefgh", b"")]
    for n, h in enumerate(together):
        assert sorted(h.tolist()) == sorted(x for a in apart for x in a[n].tolist())


def test_nothing_to_learn(spark, labelled, none, tmp_path):
    docs, labels = labelled
    for module, query, column in ((quality, quality.op2_quality, "quality"), (toxicity, toxicity.op3_toxicity, "toxic")):
        folder = tmp_path / column
        assert query(spark, tables(folder, spark, documents=docs, labels=labels.limit(0))).count() == docs.count()
        assert query(spark, tables(folder, spark, documents=docs.limit(0), labels=labels)).count() == 0


def test_odd_texts(spark, odd):
    model = quality.fit(np.stack([quality.features(b"a b c")] * 3), np.stack([quality.features(b"A!! B!!")] * 3), 0.5)
    assert quality.score(odd, model).count() == odd.count()
    assert toxicity.score(odd, toxicity.fit([b"idiot", b"house"], np.array([True, False]), np.ones(2))).count() == odd.count()


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (400, quality.DIMENSIONS)), rng.normal(-2, 1, (400, quality.DIMENSIONS))
    model = quality.fit(good[:200], np.concatenate((good[200:], bad[:200])), 0.5)
    assert (model.scores(bad[200:]) < 0.5).mean() > 0.98 and (model.scores(good[200:]) > 0.5).mean() > 0.98


def test_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    p, u = (np.concatenate((rng.normal(size=(n, 6)), np.ones((n, 1))), axis=1) for n in (7, 11))
    for prior in (0.2, 0.7):
        w = rng.normal(size=7)
        plus, minus, good, bad = quality.risk(w, p, u, prior)
        loss = lambda z: np.log(1 + np.exp(z))
        assert plus == pytest.approx(prior * np.mean([loss(-(x @ w)) for x in p])) and minus == pytest.approx(np.mean([loss(x @ w) for x in u]) - prior * np.mean([loss(x @ w) for x in p]))
        for i in range(7):
            e = np.eye(7)[i] * 1e-5
            (a1, b1, *_), (a0, b0, *_) = quality.risk(w + e, p, u, prior), quality.risk(w - e, p, u, prior)
            assert (a1 - a0) / 2e-5 == pytest.approx(good[i], abs=1e-6) and (b1 - b0) / 2e-5 == pytest.approx(bad[i], abs=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_the_prior_is_estimated_without_negatives(share):
    rng = np.random.default_rng(2)
    rows = lambda n, mean: rng.normal(mean, 1, (n, quality.DIMENSIONS))
    k = int(2000 * share)
    unlabelled = rng.permutation(np.concatenate((rows(k, 0.5), rows(2000 - k, -0.5))))
    assert quality.estimate_prior(rows(2000, 0.5), unlabelled) == pytest.approx(share, abs=0.06)
    assert quality.estimate_prior(rows(1, 0.5), unlabelled) == 0.5


def test_repeated_and_contradicting_labels(spark, labelled, tmp_path):
    docs, labels = labelled
    more = labels.unionByName(labels.filter("quality = 1 and doc_id < 100")).unionByName(labels.filter("quality = 1 and doc_id < 100"))
    for module, query in ((quality, quality.op2_quality), (toxicity, toxicity.op3_toxicity)):
        one, two = (sorted(map(str, query(spark, tables(tmp_path / f"{module.__name__}{k}", spark, documents=docs, labels=x.repartition(k + 1))).collect())) for k, x in enumerate((labels, more)))
        assert one == two
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 0)], "doc_id bigint, toxic int")
    assert {(r["__id"], r["mark"]) for r in labelled_rows.agreed(both, "toxic").collect()} == {("2", 1), ("", 0)}


def test_samples_do_not_depend_on_the_order_or_on_repeats(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("__id"))
    hot = ids.unionByName(spark.range(20_000).select(F.lit("7").alias("__id")))
    want = {r[0] for r in labelled_rows.sample_ids(ids, 50, "x").collect()}
    assert len(want) == 50 == len({r[0] for r in labelled_rows.sample_ids(hot.repartition(7), 50, "x").collect()} & want)
    assert labelled_rows.sample_ids(ids.limit(10), 50, "x").count() == 10 and labelled_rows.sample_ids(ids.limit(0), 50, "x").count() == 0


def test_gradients_of_the_bag():
    rng = np.random.default_rng(3)
    rows = [(np.array([1, 4, 7], dtype=np.int32), np.array([0.5, 1.0, 2.0])), (np.array([], dtype=np.int32), np.array([])), (np.array([4, 9], dtype=np.int32), np.array([1.5, 0.25]))]
    batch, y, scale = toxicity._Batch(rows), np.eye(2)[[1, 0, 1]], np.array([1.0, 2.0, 0.5])
    values = [rng.normal(size=s) for s in ((4, 3), (3, 2), (2,))]
    means = [sum((x * values[0][list(batch.active).index(i)] for i, x in zip(ids, xs, strict=True)), np.zeros(3)) for ids, xs in rows]
    z = np.array(means) @ values[1] + values[2]
    plain = -(scale * np.log((np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) * y).sum(axis=1))).mean()
    loss, found = toxicity.gradients(batch, y, scale, *values)
    assert loss == pytest.approx(plain)
    for k, (value, g) in enumerate(zip(values, found, strict=True)):
        for at in np.ndindex(value.shape):
            moved = [[v.copy() for v in values] for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            up, down = (toxicity.gradients(batch, y, scale, *v)[0] for v in moved)
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_scores_against_a_loop_over_ngrams():
    model = toxicity.Bag(np.random.default_rng(4).normal(size=toxicity.BUCKETS).astype(np.float32), 0.3)

    def plain(text):
        padded = b" " + "".join(" " if c in toxicity.string.punctuation + "\t\n" else c for c in text.lower()).encode() + b" "
        weights = []
        for n in toxicity.SIZES:
            for i in range(len(padded) - n + 1):
                if b" " in padded[i + 1 : i + n - 1]:
                    continue
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for c in padded[i : i + n]:
                    h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
                weights.append(float(model.weights[h >> 14]))
        return 1 / (1 + np.exp(-(sum(weights) / max(len(weights), 1) + 0.3)))

    found = ["You IDIOT, go away!", "", "ab", "a-b c_d\tlonger words here", "é ü"]
    assert model.scores([t.encode() for t in found]).tolist() == pytest.approx([plain(t) for t in found], abs=1e-6)


def brute_phrases(sample, text):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parsing_against_brute_force():
    rng = random.Random(5)
    samples = {"x": "".join(rng.choice("abcab ") for _ in range(400)), "y": "".join(rng.choice("abdd ") for _ in range(400))}
    parser = langid.CrossParser(samples)
    name = lambda codes: "".join(map(chr, codes))
    for _ in range(20):
        text = parser.codes("".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 90))))
        got = parser._parse([text], parser.roots)[0]
        for k, lang in enumerate(parser.languages):
            codes = parser.codes(samples[lang])
            assert got[k] == brute_phrases(name(codes[: max(1, len(codes) * 9 // 10)]), name(text))


SCRIPTS = {
    "latin a": range(0x61, 0x7B), "latin b": range(0x61, 0x7B), "cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "arabic": range(0x627, 0x648), "devanagari": range(0x905, 0x939), "thai": range(0xE01, 0xE2E),
    "han": range(0x4E00, 0x5200), "kana": range(0x3042, 0x3094), "hangul": range(0xAC00, 0xB400), "han too": range(0x4F00, 0x5400),
}


def invented(rng, letters, n=1500):
    """A language of ``n`` words."""
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4 if len(letters) > 200 else 9))) for _ in range(n)]
    return lambda: " ".join(words[min(int(rng.paretovariate(0.7)), n) - 1] for _ in range(40))


def test_no_letter_is_dropped(spark, tmp_path):
    """Eleven languages in nine scripts, two of them with a thousand letters each."""
    rng = random.Random(12)
    speak = {lang: invented(rng, [chr(i) for i in letters]) for lang, letters in SCRIPTS.items()}
    rows = [(i, speak[lang](), lang, "s", 1) for i in range(2200) for lang in [list(SCRIPTS)[i % 11]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = [r for r in langid.op8_langid(spark, tables(tmp_path, spark, documents=docs)).collect() if r["held_out"]]
    for lang in SCRIPTS:
        own = [r["lang_pred"] == lang for r in out if rows[r["doc_id"]][2] == lang]
        assert len(own) > 30 and sum(own) >= 0.95 * len(own), (lang, sum(own), len(own))


def test_cross_parsing_over_wide_alphabets():
    rng = random.Random(13)
    wide = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(200))
    samples = {"latin": wide("abcdef"), "han": wide([chr(i) for i in range(0x4E00, 0x4E80)]), "both": wide(["a", "b", *(chr(i) for i in range(0x4E00, 0x4E60))])}
    parser = langid.CrossParser(samples)
    assert set(parser.sparse) == {0, 1} and set(parser.starts) == {2}
    name = lambda codes: "".join(map(chr, codes))
    texts = [parser.codes("".join(rng.choice(["a", "b", "z", " ", chr(0x4E00 + rng.randrange(90)), samples["han"][rng.randrange(40) :][:5]]) for _ in range(rng.randrange(0, 80)))) for _ in range(40)]
    got = parser._parse(texts, parser.roots)
    for k, lang in enumerate(parser.languages):
        own = parser.codes(samples[lang])
        for t, text in enumerate(texts):
            assert got[t, k] == brute_phrases(name(own[: max(1, len(own) * 9 // 10)]), name(text))


def test_samples_are_bounded_together(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(500)), f"l{i % 20}") for i in range(400)]
    parser = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), all_chars=20_000)
    assert len(parser.languages) == 20 and all(len(t) == 1000 for t in parser.samples.values())


def test_suffix_automaton():
    text = [3, 4, 3, 3, 4, 5, 3, 4]
    table = langid.SuffixAutomaton(text, 8).table().reshape(-1, 8)
    for i in range(len(text)):
        at = 0
        for c in text[i:]:
            at = table[at // 8, c]
            assert at >= 0


def test_language(spark, odd, none, tmp_path):
    rng = random.Random(6)
    words = {"en": ["the", "house", "with", "would", "think", "and", "river"], "de": ["der", "haus", "und", "schön", "nicht", "gehen", "fluß"], "ru": ["река", "дом", "и", "очень", "большой"]}
    rows = [(i, prose(rng, 40, words[lang]), lang, "s", 1) for i in range(300) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = langid.op8_langid(spark, tables(tmp_path / "a", spark, documents=docs)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(out) == 300 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in out)
    got = {r["doc_id"]: r for r in langid.op8_langid(spark, tables(tmp_path / "b", spark, documents=odd)).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (3, 4, 6, 7))
    assert langid.op8_langid(spark, tables(tmp_path / "c", spark, documents=none)).count() == 0
    kept = langid.filter_languages(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5, 8, 9}
    assert langid.filter_languages(none).count() == 0


def test_training_keeps_few_bytes_an_ngram():
    random = np.random.default_rng(3)
    rows = [(np.unique(random.integers(0, toxicity.BUCKETS, 5000)).astype(np.int32), None) for _ in range(20)]
    rows = [(ids, np.ones(len(ids), dtype=np.float32)) for ids, _ in rows]
    batch, n = toxicity._Batch(rows), sum(len(ids) for ids, _ in rows)
    per_ngram = sum(v.nbytes for name, v in vars(batch).items() if isinstance(v, np.ndarray) and len(v) == n)
    assert per_ngram <= 8 * n
    assert (batch.active[batch.place] == np.concatenate([ids for ids, _ in rows])).all()
    assert (batch.doc == np.repeat(np.arange(20), [len(ids) for ids, _ in rows])[batch.order]).all()
