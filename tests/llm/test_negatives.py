"""Hard negatives against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import negatives
from tests.llm.conftest import tables

SCHEMA = "vec_id bigint, embedding array<float>, label int, query string, score string, copies string"


def by_definition(rows):
    """Every anchor against every row."""
    kept = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, (a, la, va) in enumerate(kept):
        if a % 50:
            continue
        score = {j: sum(x * y for x, y in zip(va, v, strict=True)) for j, (_, _, v) in enumerate(kept) if j != i and len(v) == len(va)}
        best = sorted((j for j in score if kept[j][1] == la), key=lambda j: (-score[j], kept[j][0]))[:5]
        for p in best:
            ok = [j for j in score if kept[j][1] != la and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            for r, j in enumerate(sorted(ok, key=lambda j: (-score[j], kept[j][0]))[:3], 1):
                out.append((a, kept[p][0], r, kept[j][0], score[p], score[j]))
    return sorted(out)


def vectors(seed, n, dims=16, centres=4, odd=False):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    out = []
    for i in range(n):
        c = rng.choice(middle)
        v = [x + rng.gauss(0, 0.7) for x in c]
        norm = math.sqrt(sum(x * x for x in v))
        out.append([i, [round(x / norm, 2) for x in v], rng.randrange(3), "a", "b", "c"])
    if odd:
        for i in range(0, 40):
            out.append(list(out[i]))  # repeated rows, an anchor among them
        for i in range(60, 90):
            out[i][0] = 50  # one id for a hot group, itself an anchor
        out[3][1], out[4][2], out[5][1], out[6][1], out[7][1], out[8][0] = None, None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), None
        out += [[100 + 50 * i, [0.5] * k, 1, "a", "b", "c"] for i, k in enumerate((0, 1, 3, 3))] + [[11, [], 2, "", "", ""], [101, [1.0, 1.0, 0.5], 1, "", "", ""], [102, [1.0, 0.4, 0.0], 2, "", "", ""]]
        out += [[-50, [-0.25] * dims, 1, "", "", ""], [-7, [-0.5] * dims, 0, "", "", ""]]
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed,sizes", [(1, (2048, 2048, 1 / 16)), (2, (16, 32, 1 / 16)), (3, (64, 64, 0)), (4, (64, 7, 1))])
def test_negatives_by_definition(spark, tmp_path, monkeypatch, seed, sizes):
    for name, value in zip(("ANCHORS", "ROWS", "SPARSE"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(seed, 600, odd=seed % 2 == 0)
    path = tables(tmp_path, spark, embeddings=spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in negatives.op12_hard_negatives(spark, path).collect()]
    want = by_definition(rows)
    assert sorted(got) == want and len(want) > 50
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    rel = con.sql(negatives.SQL["op12_hard_negatives"])
    assert rel.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and sorted(rel.fetchall()) == want


def test_planes_drop_pairs():
    """Pairs go before their last plane, and none that qualifies does."""
    rng = np.random.default_rng(3)
    anchors, rows = rng.integers(-160, 160, (20, 64)), rng.integers(-160, 160, (3000, 64))
    block, seen = negatives.Block(anchors, np.zeros(20, dtype=np.int64)), []

    def need(anchor, row, low, high, alive):
        seen.append(low.size if alive is None else int(alive.sum()))
        return high >= 90_000

    a, c, s = block.exact(np.arange(20), rows, need, np.ones((20, 3000), dtype=bool))
    true = anchors @ rows.T
    assert {(i, j) for i, j in zip(a.tolist(), c.tolist(), strict=True)} == set(zip(*map(list, np.nonzero(true >= 90_000)), strict=True))
    assert (s == true[a, c]).all() and seen[0] == 60_000 and seen[-1] < 20_000
    with pytest.raises(ValueError):
        negatives.Block(anchors << 40, np.zeros(20, dtype=np.int64)).exact(np.arange(20), rows, need, np.ones((20, 3000), dtype=bool))


def test_nothing_to_mine(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.op12_hard_negatives(spark, tables(tmp_path / "0", spark, embeddings=empty)).count() == 0
    alone = spark.createDataFrame([(50, [0.5, 0.5], 1, "", "", "")], SCHEMA)
    out = negatives.op12_hard_negatives(spark, tables(tmp_path / "1", spark, embeddings=alone))
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
