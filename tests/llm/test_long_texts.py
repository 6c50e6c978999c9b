"""Texts worked on in stretches: the same results as whole, in bounded memory."""

import random
import tracemalloc
from functools import partial

import numpy as np
import pytest
import xxhash

from pulsegrid.llm import common, decontam, mixing, neardup, quality, simhash, toxicity

BLANKS = " \t\n\x0b\x0c\r"


def made(rng, words, alphabet="abcdXYZ.,é9"):
    return "".join("".join(rng.choices(alphabet, k=rng.randint(1, 9))) + "".join(rng.choices(BLANKS, k=rng.randint(1, 3))) for _ in range(words))


TEXTS = [made(random.Random(s), n).encode() for s, n in enumerate((0, 1, 2, 3, 4, 40, 400))] + [b"x" * 500, b" " * 500, b"\n" * 90 + b"y" * 90, b"a b " * 200, b"one\n\ntwo\none\n" * 30]
MODULES = (simhash, neardup, decontam, quality, toxicity)


@pytest.fixture(params=[7, 64, 1 << 20])
def cut(request, monkeypatch):
    for module in MODULES:
        monkeypatch.setattr(module, "stretches", partial(common.stretches, most=request.param))
    return request.param


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_pieces_make_the_text_and_cut_no_word(most):
    for text in TEXTS:
        pieces = list(common.stretches(text, most))
        assert b"".join(pieces) == text and [w for p in pieces for w in p.split()] == text.split()
        assert all(len(p) <= most or len(p.split()) <= 1 for p in pieces)


def brute_fingerprint(text, shingle):
    words = text.lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("shingle", [1, 2, 3, 5])
def test_fingerprints(cut, shingle):
    assert [simhash.fingerprint(t, shingle) for t in TEXTS] == [brute_fingerprint(t, shingle) for t in TEXTS]


def test_shingles_and_tokens(cut):
    index = decontam.Index([])
    for text in TEXTS:
        own = neardup.Shingles()
        assert np.array_equal(own.sequence(text), own.sequence(b" ".join(text.split())))
        assert own._hashes(text.lower().split()).tolist() == [xxhash.xxh64_intdigest(w) for w in text.lower().split()]
        assert index.tokens_of(text.decode()).tolist() == index.tokens(decontam.words(text.decode())).tolist()
    assert not len(index.tokens_of(None))


def brute_features(text):
    """The form of a text by dictionaries and loops."""
    kinds = [quality.CLASS[b] for b in text]
    pairs = [0] * quality.CLASSES**2
    for a, b in zip(kinds, kinds[1:], strict=False):
        pairs[a * quality.CLASSES + b] += 1
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n = len(words)
    return [np.log((p + 0.05) / (len(text) + 5)) for p in pairs] + [
        np.log(1 + n), len(text) / (n + 1), np.log((sum(words[i] == words[i + 1] for i in range(n - 1)) + 0.2) / (n + 2)), len(set(words)) / (n + 1),
        1 - (len({tuple(words[i : i + 3]) for i in range(n - 2)}) + 1) / (max(n - 2, 0) + 1), 1 - (len(set(lines)) + 1) / (len(lines) + 1),
    ]


def test_quality_features(cut):
    for text in [*TEXTS, b""]:
        assert np.allclose(quality.features(text), brute_features(text), atol=1e-5)


def test_toxicity_scores(cut):
    bag = toxicity.Bag(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.3)
    one_by_one = [bag.scores([b" ".join(t.split())])[0] for t in TEXTS]
    assert np.allclose(bag.scores(TEXTS), one_by_one) and not len(bag.scores([]))


def test_memory_of_a_very_long_text():
    """Ten times the text, and what a stretch takes, is enough for each; 19 to 40 times were taken before."""
    text = made(random.Random(5), 60_000).encode() * 25
    bag = toxicity.Bag(np.zeros(toxicity.BUCKETS), 0.0)
    index = decontam.Index([(1, "one two three four five six seven eight")])
    whole = text.decode()
    for run in (lambda: simhash.fingerprint(text), lambda: neardup.Shingles().set_of(text), lambda: quality.features(text), lambda: bag.scores([text]), lambda: index.search([whole])):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10 * len(text) + (64 << 20), peak / len(text)


def test_rows_that_share_an_id_are_parted(spark):
    """Documents without an id get keys by their texts, so that they fall into many ranges, and the mix is whole."""
    rows = [(None, f"w{i} " * (i % 5 + 1), "a") for i in range(400)] + [(i, f"v{i}", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    small, large = (mixing.mix(df, rows_per_range=n).collect() for n in (8, 10_000))
    assert sorted(map(str, small)) == sorted(map(str, large)) and len(small) == 450
    for source in "ab":
        own = [r for r in small if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    plan = mixing.mix(df, rows_per_range=8)
    assert plan.filter("taken > 0 and doc_id is null").count() > 0
