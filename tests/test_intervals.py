"""Interval joins against loops over all pairs; each row moves once."""

import random
from datetime import datetime, timedelta

import pytest

from pulsegrid.operators import joins

FIRST, AS_OF = datetime(2020, 1, 1), "2024-01-01 00:00:00"


def _tables(spark, seed, hot):
    r = random.Random(seed)
    device = lambda: "hot" if r.random() < hot else r.choice(["a", "b", "c", None])
    when = lambda: FIRST + timedelta(hours=r.randrange(0, 24 * 900))
    studies = []
    for i in range(120):
        start = when()
        length = r.choice([timedelta(0), timedelta(hours=1), timedelta(days=3), timedelta(days=400), timedelta(days=300 * 365), None, timedelta(days=-2)])
        studies.append((f"s{i:03}", device(), start, None if length is None else start + length, FIRST if r.random() < 0.1 else None))
    points = [(f"p{i}", device(), when() if r.random() < 0.95 else None) for i in range(600)]
    points += [(f"q{i}", s[1], s[2 + i % 2]) for i, s in enumerate(studies)]  # exactly at starts and ends
    points.append(points[0])  # a row that repeats
    return (
        spark.createDataFrame(studies, "id string, device_id string, started_at timestamp, ended_at timestamp, deleted_at timestamp"),
        spark.createDataFrame(points, "id string, device_id string, t timestamp"),
        studies,
        points,
    )


@pytest.mark.parametrize(("seed", "hot", "days"), [(1, 0.0, 1), (2, 0.7, 7), (3, 0.7, 400)])
def test_random(spark, seed, hot, days):
    studies, points, own, asked = _tables(spark, seed, hot)
    as_of = datetime.fromisoformat(AS_OF)
    live = [(i, d, a, b or as_of) for i, d, a, b, gone in own if d and not gone]
    want = []
    for p, d, t in asked:
        held = [(-a.timestamp(), i) for i, e, a, b in live if t and e == d and a <= t < b]
        want.append((p, min(held)[1] if held else ""))
    found = joins.containing_study(points, studies, AS_OF, time="t", days=days)
    assert sorted((r["id"], r["study_id"] or "") for r in found.collect()) == sorted(want)
    spans = studies.filter("deleted_at IS NULL").selectExpr("id AS study_id", "device_id", "started_at", "ended_at")
    pairs = joins.in_interval(points, spans, key="device_id", time="t", start="started_at", end="ended_at", days=days)
    closed = [(i, d, a, b) for i, d, a, b, gone in own if d and b and not gone]
    assert sorted((r["id"], r["study_id"]) for r in pairs.collect()) == sorted((p, i) for p, d, t in asked for i, e, a, b in closed if t and e == d and a <= t < b)
    assert pairs.columns == ["device_id", "id", "t", "study_id", "started_at", "ended_at"]


def test_no_rows(spark):
    studies, points, *_ = _tables(spark, 4, 0.5)
    assert joins.containing_study(points.limit(0), studies, AS_OF, time="t").count() == 0
    none = joins.containing_study(points, studies.limit(0), AS_OF, time="t").collect()
    assert len(none) == points.count() and not any(r["study_id"] for r in none)


def most_rows(df):
    """The greatest number of rows that any operator of an executed plan has put out."""

    def of(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(node.plan())
        metric, children = node.metrics().get("numOutputRows"), node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *[of(children.apply(i)) for i in range(children.size())]])

    return of(df._jdf.queryExecution().executedPlan())


def test_many_open_studies_of_one_device(spark):
    n = 3000
    minute = lambda k: FIRST + timedelta(minutes=k)
    studies = spark.createDataFrame([(f"s{k:04}", "hot", minute(k), minute(n + 10) if k == n // 2 else None, None) for k in range(n)], "id string, device_id string, started_at timestamp, ended_at timestamp, deleted_at timestamp")
    points = spark.createDataFrame([(f"p{k:04}", "hot", minute(k) + timedelta(seconds=30)) for k in range(n)], "id string, device_id string, t timestamp")
    found = joins.containing_study(points, studies, AS_OF, time="t", days=60)
    assert {(r["id"], r["study_id"]) for r in found.collect()} == {(f"p{k:04}", f"s{k:04}") for k in range(n)}
    assert n <= most_rows(found) < 40 * n  # not every change with every study that is open
