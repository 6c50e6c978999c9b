"""Language-model scoring and media columns."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import flac, kneserney, media
from tests.llm.conftest import tables


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


class Plain:
    """The same model in dictionaries, any order: n-grams as tuples."""

    def __init__(self, texts, order=2):
        self.order, self.c = order, Counter()
        level = Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            padded = ["<s>"] * (order - 1) + w
            level.update(tuple(padded[i : i + order]) for i in range(len(w)))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.counts, self.d, self.total, self.kinds = {}, {}, {}, {}
        for k in range(order, 0, -1):
            self.counts[k] = level
            self.d[k] = [0.0, *kneserney.discounts([Counter(level.values())[i] for i in (1, 2, 3, 4)])]
            self.total[k], self.kinds[k] = Counter(), defaultdict(Counter)
            for g, n in level.items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]][min(n, 3)] += 1
            level = Counter(g[1:] for g in level)

    def p(self, gram):
        if not gram:
            return 1 / (self.v + 1)
        k, u = len(gram), gram[:-1]
        if not self.total[k][u]:
            return self.p(gram[1:])
        n, d = self.counts[k][gram], self.d[k]
        return (n - d[min(n, 3)]) / self.total[k][u] + sum(d[i] * self.kinds[k][u][i] for i in (1, 2, 3)) / self.total[k][u] * self.p(gram[1:])

    def logs(self, t):
        w = tokens(t)
        padded = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(w)))


def lm_docs(spark, n=150):
    rng = random.Random(1)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "W1 w2"), (3, "again w1")]


def test_model_against_dictionaries(spark, tmp_path):
    rows = lm_docs(spark)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    plain = Plain([t for d, t in rows if fold(d) != 2], kneserney.QUERY_ORDER)
    want = []
    for d, t in rows:
        w = tokens(t)
        want.append((d is None, d or 0, fold(d) == 2, len(w), sum(plain.c[x] > 0 for x in w), plain.n, sum(math.log10((plain.c[x] + 1) / (plain.n + plain.v + 1)) for x in w), plain.logs(t)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in kneserney.op5_kneser_ney(spark, tables(tmp_path, spark, documents=docs)).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_order(spark, order):
    rows = lm_docs(spark, 80)
    learned, docs = rows[:60] * 2, spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = Plain([t for _, t in learned], order)
    model = kneserney.train(spark.createDataFrame(learned, docs.schema).repartition(3), order=order, run_tokens=300)
    assert model.grams == tuple(len(plain.counts[k]) for k in range(1, order + 1))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in kneserney.score(docs, model).collect())
    want = sorted((d is None, d or 0, len(tokens(t)), plain.logs(t)) for d, t in rows)
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) for a, b in zip(got, want, strict=True))


def test_probabilities_sum_to_one(spark):
    for order in (1, 2, 3):
        plain = Plain([t for _, t in lm_docs(spark)], order)
        for u in [("<s>", "<s>"), ("<s>", b"w1"), (b"w1", b"w2"), (b"never", b"w1")]:
            u = u[3 - order :]
            assert sum(plain.p((*u, *w)) for w in plain.counts[1]) + plain.p((*u, b"unknown")) == pytest.approx(1)


def test_runs_and_shards_do_not_change_the_model(spark):
    docs = spark.createDataFrame(lm_docs(spark), "doc_id bigint, text string").repartition(3)
    models = kneserney.train(docs), kneserney.train(docs, run_tokens=50), kneserney.train(docs, shard_bytes=512, least_share=0.01), kneserney.train(docs, least_share=2.0)
    a, b, c, d = models
    assert a.shards == b.shards == d.shards < c.shards
    assert len(c.frequent(2)) > 3 and len(a.frequent(2)) > 0 and len(d.frequent(2)) == 0  # more, some and no frequent contexts
    assert len({(m.tokens, m.grams, m.discounts, m.word_total, m.word_rest) for m in models}) == 1
    one, *others = (sorted(map(str, kneserney.score(docs, m).collect())) for m in models)
    assert all(x == one for x in others)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_shards_dealt_to_in_steps(spark, order):
    docs = spark.createDataFrame(lm_docs(spark), "doc_id bigint, text string").repartition(3)
    kinds = {"shard_bytes": 256, "least_share": 0.01, "order": order}
    models = kneserney.train(docs, **kinds), kneserney.train(docs, **kinds, fan=5, run_tokens=200), kneserney.train(docs, **kinds, fan=2, run_tokens=90)
    assert [len(kneserney.widths(models[0].shards, f)) for f in (kneserney.FAN, 5)] == [1, 3] and models[0].shards > 50
    assert len({(m.tokens, m.grams, m.discounts, m.word_total, m.word_rest) for m in models}) == 1
    one, *others = (sorted(map(str, kneserney.score(docs, m).collect())) for m in models)
    assert all(x == one for x in others)


def test_rows_of_a_run_do_not_grow_with_the_shards():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) for _ in range(2)]
    one, none = np.ones(200_000, dtype=np.int64), np.empty(0, dtype=np.uint64)
    for shards in (1, 32, 1_900, 65_000, 7_000_000, 2**31 - 1):
        steps = kneserney.widths(shards)
        assert steps[-1] == 1 and -(-shards // steps[0]) <= kneserney.FAN and all(a <= b * kneserney.FAN for a, b in zip(steps, steps[1:], strict=False))
        assert len(steps) <= 3
        rows = kneserney._packed(words, one, one, shards, none, steps[0])
        assert len(rows) <= kneserney.FAN and all(r[0] % steps[0] == 0 and 0 <= r[0] < shards for r in rows)


def test_a_missing_or_short_file_is_an_error(spark):
    docs = spark.createDataFrame(lm_docs(spark), "doc_id bigint, text string")
    for damage in (os.remove, lambda f: os.truncate(f, os.path.getsize(f) - 8)):
        model = kneserney.train(docs)
        damage(f"{model.folder}/gram-2-1")
        with pytest.raises(Exception, match="of the language model is (gone|damaged)"):
            kneserney.score(docs, model).collect()


def test_lm_odd(spark, odd, none, tmp_path):
    assert kneserney.op5_kneser_ney(spark, tables(tmp_path / "a", spark, documents=odd)).count() == odd.count()
    assert kneserney.op5_kneser_ney(spark, tables(tmp_path / "b", spark, documents=none)).count() == 0
    empty = kneserney.train(none)
    assert all(r["score"] == 0 for r in kneserney.score(odd, empty).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=4))
def test_flac_round_trip(payloads):
    samples, blocks = flac.decode(flac.encode(payloads, 256))
    assert [(s + 128).astype(np.uint8).tobytes() for s in samples] == payloads
    for s, b in zip(samples, blocks, strict=True):
        assert [n for _, n in b] == [min(256, len(s) - at) for at, _ in b] and sum(n for _, n in b) == len(s)


class Bits:
    """A frame written bit by bit, with what the encoder does not use."""

    def __init__(self):
        self.b = []

    def put(self, value, n):
        self.b += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        self.b += [0] * (-len(self.b) % 8)
        return bytes(int("".join(map(str, self.b[i : i + 8])), 2) for i in range(0, len(self.b), 8))


def frame(samples, bits, coefs, shift, params, wide=False, escape=None, fixed=None):
    n, order = len(samples), fixed if fixed is not None else len(coefs)
    head = bytes([0xFF, 0xF8, 0x70 | 4, {8: 2, 16: 8}[bits], 0]) + (n - 1).to_bytes(2, "big")
    w = Bits()
    w.put((8 + fixed if fixed is not None else 31 + order) << 1, 8)
    for s in samples[:order]:
        w.put(s & ((1 << bits) - 1), bits)
    if fixed is None:
        w.put(11, 4)
        w.put(shift & 31, 5)
        for c in coefs:
            w.put(c & 0xFFF, 12)
    w.put(int(wide), 2)
    w.put((len(params) - 1).bit_length(), 4)
    binomial = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
    for p, k in enumerate(params):
        w.put(k if k != escape else (31 if wide else 15), 5 if wide else 4)
        if k == escape:
            w.put(17, 5)
        for i in range(max(order, p * n // len(params)), (p + 1) * n // len(params)):
            guess = sum(c * samples[i - 1 - j] for j, c in enumerate(binomial[fixed])) if fixed is not None else sum(c * samples[i - 1 - j] for j, c in enumerate(coefs)) >> shift
            r = samples[i] - guess
            if k == escape:
                w.put(r & 0x1FFFF, 17)
                continue
            z = (r << 1) ^ (r >> 63)
            w.put(1, (z >> k) + 1)
            w.put(z & ((1 << k) - 1), k)
    body = head + bytes([flac.crc8(head)]) + w.bytes()
    return body + int(flac.crc16(np.frombuffer(body, dtype=np.uint8), np.array([0]), np.array([len(body)]))[0]).to_bytes(2, "big")


def stream(frames, samples, bits):
    raw = np.array(samples, dtype="<i2" if bits == 16 else "i1").tobytes()
    info = b"\x01\x00\x01\x00" + b"\0" * 6 + ((8000 << 44) | ((bits - 1) << 36) | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80\x00\x00\x22" + info + b"".join(frames)


@pytest.mark.parametrize("bits", [8, 16])
def test_foreign_frames(bits):
    """General predictors, partitions, both parameter widths and escapes, without a seek table."""
    rng = random.Random(bits)
    top = (1 << (bits - 1)) - 1
    samples = [int(top * 0.7 * math.sin(i / 9)) + rng.randrange(-3, 4) for i in range(256 * 6)]
    part = lambda i: samples[256 * i : 256 * i + 256]
    frames = [frame(part(0), bits, [1900, -900], 10, [4, 2, 3, 5]), frame(part(1), bits, [], 0, [6], wide=True, fixed=2), frame(part(2), bits, [], 0, [3, 9], escape=9, fixed=1), frame(part(3), bits, [], 0, [0, 1, 2, 3, 4, 5, 6, 7], fixed=3), frame(part(4), bits, [], 0, [5], fixed=4), frame(part(5), bits, [1000, 20, -30], 10, [7, 0])]
    data = stream(frames, samples, bits)
    (x,), (blocks,) = flac.decode([data])
    assert x.tolist() == samples and [at for at, _ in blocks] == [256 * i for i in range(6)]
    bad = bytearray(data)
    bad[-40] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(bad)])


def test_quiet_media_keep_their_width(spark):
    samples = [i % 7 - 3 for i in range(256)]
    data = stream([frame(samples, 16, [], 0, [3], fixed=0)], samples, 16)
    (r,) = media.pcm_blocks(spark.createDataFrame([(1, bytearray(data))], "doc_id bigint, media binary")).collect()
    assert r["bits"] == 16 and np.frombuffer(bytes(r["pcm"]), dtype="<i2").tolist() == samples


def test_every_check_is_made():
    (data,) = flac.encode([b"some text that is long enough" * 90])
    caught = 0
    for at in range(42, len(data), 37):
        bad = bytearray(data)
        bad[at] ^= 0x10
        try:
            x, _ = flac.decode([bytes(bad)])
        except (flac.FlacError, IndexError, ValueError, StopIteration):
            caught += 1
        else:  # only the seek table's copy of a number may be wrong and go unnoticed
            assert (x[0] + 128).astype(np.uint8).tobytes() == b"some text that is long enough" * 90
    assert caught > 20


def test_numbers():
    for n in (0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF):
        assert flac._number(n) == chr(n).encode("utf-8", "surrogatepass")
    assert flac._number((1 << 36) - 1) == b"\xfe" + b"\xbf" * 6


def test_media_query(spark, odd, none, tmp_path):
    rows = media.op10_flac(spark, tables(tmp_path / "a", spark, documents=odd)).collect()
    texts = sorted(((r["doc_id"] or 0), (r["text"] or "").encode()) for r in odd.collect())
    assert len(rows) == len(texts)
    by = defaultdict(set)
    for d, raw in texts:
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        by[d].add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in by[r["doc_id"] or 0]
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"].startswith("rms=")
    same = defaultdict(set)
    for r in rows:
        same[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.op10_flac(spark, tables(tmp_path / "b", spark, documents=none)).count() == 0


def test_pcm_blocks(spark):
    text = "abc " * 900
    df = media.stored(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"))
    blocks = sorted(((r["doc_id"], r["sample_offset"], r["n_samples"], bytes(r["pcm"])) for r in media.pcm_blocks(df).collect()))
    pcm = b"".join(p for d, _, _, p in blocks if d == 1)
    assert bytes(b ^ 0x80 for b in pcm).rstrip(b"\0") == text.encode()
    at = 0
    for d, offset, n, _ in blocks:
        if d == 1:
            assert offset == at
            at += n
    assert all(r["bits"] == 8 for r in media.pcm_blocks(df).collect())
    bad = spark.createDataFrame([(1, bytearray(b"fLaC nonsense that is no stream at all, none whatever ......")), (2, None)], "doc_id bigint, media binary")
    got = media.pcm_blocks(bad, errors="null").collect()
    assert [(r["doc_id"], r["pcm"]) for r in got] == [(1, None)]
