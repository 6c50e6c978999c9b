"""Near copies that repeat a stretch a different number of times."""

import random

from pulsegrid.llm import neardup


def test_repeated_stretches(spark):
    rng, docs, want = random.Random(5), [], {}
    for k in range(60):
        base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        other = list(base)
        other[100] = "changed"
        docs += [(2 * k, " ".join(base + base[:8] * 2)), (2 * k + 1, " ".join(other + base[:8] * 40))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    assert all(len(a & b) >= 0.9 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["doc_id"]: r["keeper"]["doc_id"] for r in neardup.near_copies(df).collect()} == want


def test_the_fingerprint_is_the_sets():
    made = neardup.Shingles()
    once, often = (made.set_of(b" ".join([b"a b c d e f g h"] * n)) for n in (2, 50))
    assert made.node(once) == made.node(often) and made.fingerprint(once) == made.fingerprint(often)
