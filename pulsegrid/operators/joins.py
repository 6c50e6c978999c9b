"""Joins between domain tables."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.clock import at
from pulsegrid.operators.predicates import assigned_to, live

#: Microseconds of a day.
DAY = 86_400_000_000
#: Spans up to this long lie over two buckets at most.
LONGEST_DAYS = 200 * 365


def with_assigned_device(patients: DataFrame, devices: DataFrame) -> DataFrame:
    """Each patient with its assigned device, or null; of several (corrupt data) the smallest id."""
    held = assigned_to(devices).groupBy(F.col("patient_id").alias("_patient")).agg(F.min("id").alias("assigned_device_id"))
    return patients.join(held, F.col("id") == F.col("_patient"), "left").drop("_patient")


def study_detail(studies: DataFrame, patients: DataFrame, devices: DataFrame, doctor_id: str | None = None) -> DataFrame:
    """Live studies with their live patient and device; of one doctor, or of all."""
    p = live(patients).select(F.col("id").alias("_pid"), "doctor_id", "first_name", "last_name")
    if doctor_id is not None:
        p = p.filter(F.col("doctor_id") == doctor_id)
    d = live(devices).select(F.col("id").alias("_did"), "serial_number")
    return live(studies).join(p, F.col("patient_id") == F.col("_pid")).join(d, F.col("device_id") == F.col("_did")).drop("_pid", "_did")


def of_existing(studies: DataFrame, patients: DataFrame) -> DataFrame:
    """Semi-join: rows whose patient is there and live."""
    return studies.join(live(patients).select(F.col("id").alias("patient_id")), "patient_id", "left_semi")


def without_device(patients: DataFrame, devices: DataFrame) -> DataFrame:
    """Anti-join: live patients without an assigned device; no cap."""
    return live(patients).join(assigned_to(devices).select(F.col("patient_id").alias("_p")), F.col("id") == F.col("_p"), "left_anti")


def with_serial(rows: DataFrame, devices: DataFrame, key: str = "device_id") -> DataFrame:
    """Look a device's serial up; null for no id or an unknown one."""
    d = devices.select(F.col("id").alias("_d"), F.col("serial_number").alias("device_serial")).dropDuplicates(["_d"])
    return rows.join(d, F.col(key) == F.col("_d"), "left").drop("_d")


def first_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def first_running_study(patients: DataFrame, studies: DataFrame, how: str = "inner") -> DataFrame:
    """Each patient with its latest running study; ``left`` keeps patients without one."""
    running = first_per(live(studies).filter(F.col("status") == "in_progress"), "patient_id", [F.col("started_at").desc(), F.col("id").asc()])
    s = running.select(F.col("patient_id").alias("_p"), F.col("id").alias("study_id"), F.col("started_at").alias("study_started_at"), F.col("device_id").alias("study_device_id"))
    return patients.join(s, F.col("id") == F.col("_p"), how).drop("_p")


def flatten(patients: DataFrame, studies: DataFrame) -> DataFrame:
    """Each live patient with each of its live studies."""
    p = live(patients).select(F.col("id").alias("_p"), F.concat_ws(" ", "first_name", "last_name").alias("patient_name"))
    return live(studies).join(p, F.col("patient_id") == F.col("_p")).drop("_p")


def _holding(probes: DataFrame, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Every probe ``_p`` with every span of its keys that holds it: _from <= _p < _to, all in microseconds.

    A span lies at the level whose buckets, ``width`` times a power of two, are as long as it, so over two at most; one of
    more than ``LONGEST_DAYS`` lies at the last level, over as many as it needs.  A probe goes to one bucket of each level.
    """
    top = max(0, math.ceil(math.log2(LONGEST_DAYS * DAY / width)))
    bucket = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")
    level = F.least(F.lit(top), F.greatest(F.lit(0), F.ceil(F.log2((F.col("_to") - F.col("_from")) / F.lit(float(width))))))
    laid = spans.filter("_to > _from").withColumn("_level", level.cast("int")).withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_to"))))
    asked = probes.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_bucket", bucket("_p"))
    return asked.join(laid, [*keys, "_level", "_bucket"]).filter("_p >= _from AND _p < _to").drop("_level", "_bucket")


def _period(c: Column, width: int) -> Column:
    """The start of the period of ``width`` microseconds that a time in microseconds lies in."""
    return c - F.pmod(c, F.lit(width))


def _nodes(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each row once for each of the fewest dyadic nodes (``_level``, ``_node``) that make up low <= i < high, two a level at most."""
    laid = rows.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint")}).filter("_low < _high")
    laid = laid.withColumn("_level", F.explode(_levels(F.col("_high") - F.col("_low"))))
    left, right = F.expr("shiftright(_low + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_high, _level)")
    own = lambda end, node: F.when((left < right) & (end.bitwiseAND(F.lit(1)) == 1), node)
    return laid.withColumn("_node", F.explode(F.array_compact(F.array(own(left, left), own(right, right - 1))))).drop("_low", "_high")


def _levels(n: Column) -> Column:
    """The levels of the dyadic nodes inside of ``n`` places."""
    return F.sequence(F.lit(0), F.floor(F.log2(n) + 1e-9).cast("int"))


def containing_study(rows: DataFrame, studies: DataFrame, as_of: datetime | str, *, time: str, key: str | None = None, days: int = 7) -> DataFrame:
    """The study of a row's device that holds its time: started_at <= t < coalesce(ended_at, as_of).

    Of several studies the one that started last wins, then the smallest id; rows without any keep a null study_id.  Who
    wins changes only where a study starts or ends.  So for each device and period of ``days`` days that has rows, the
    winner is worked out at the start of the period and at the changes inside it; that makes stretches that do not
    overlap, and each row meets its own by one equi-join on device and period.  Rows are moved once and never copied,
    and a device with very many of them is split by the join.  Rows need no ``key``; it is accepted as in earlier calls.

    A study is laid out over dyadic nodes: of the periods that it holds whole, and of the changes that it holds in the two
    that it starts and ends in.  The best of each node is found first, and a change asks the nodes that it lies in.  So the
    work grows with n log n, however many studies of a device are open at once.
    """
    width = days * DAY
    period = lambda c: F.call_function("div", _period(c, width), F.lit(width))
    moment, best = F.unix_micros(time), F.min(F.struct((-F.col("_from")).alias("a"), F.col("_study").alias("b"))).alias("_best")
    s = live(studies).select(F.col("device_id").alias("_d"), F.col("id").alias("_study"), F.unix_micros("started_at").alias("_from"), F.unix_micros(F.coalesce("ended_at", at(as_of))).alias("_to")).filter("_to > _from")
    used = rows.select(F.col("device_id").alias("_d"), period(moment).alias("_k")).filter("_d IS NOT NULL AND _k IS NOT NULL").distinct()
    reach = used.groupBy("_d").agg(F.min("_k").alias("_first"), (F.max("_k") + 1).alias("_last"))
    near = s.join(reach, "_d").filter((F.col("_to") > F.col("_first") * width) & (F.col("_from") < F.col("_last") * width))
    # periods that are held whole
    whole = _nodes(near, F.greatest("_first", period(F.col("_from") + (width - 1))), F.least("_last", period(F.col("_to")))).groupBy("_d", "_level", "_node").agg(best)
    asked = used.join(reach, "_d").select("_d", "_k", F.explode(_levels(F.col("_last") - F.col("_first"))).alias("_level")).withColumn("_node", F.expr("shiftright(_k, _level)"))
    whole = asked.join(whole, ["_d", "_level", "_node"]).groupBy("_d", "_k").agg(F.min("_best").alias("_whole"))
    # changes, numbered within their period; the first is the period's start
    edge = lambda c, starts: F.struct(F.col(c).alias("_p"), F.lit(starts).alias("_starts"))
    edges = near.withColumn("_e", F.explode(F.array(edge("_from", True), edge("_to", False)))).select("_d", "_first", "_last", "_study", "_from", "_to", "_e.*").withColumn("_k", period(F.col("_p")))
    edges = edges.filter("_k >= _first AND _k < _last").drop("_first", "_last").unionByName(used.withColumn("_p", F.col("_k") * width), allowMissingColumns=True)
    own = Window.partitionBy("_d", "_k")
    edges = edges.withColumn("_i", F.dense_rank().over(own.orderBy("_p")).cast("bigint") - 1).withColumn("_n", F.max("_i").over(own) + 1)
    edges = edges.withColumn("_used", F.max(F.col("_starts").isNull()).over(own)).filter("_used")
    parts = edges.filter("_starts IS NOT NULL").groupBy("_d", "_k", "_n", "_study", "_from", "_to").agg(F.min(F.when(F.col("_starts"), F.col("_i"))).alias("_start"), F.min(F.when(~F.col("_starts"), F.col("_i"))).alias("_end"))
    inside = _nodes(parts, F.coalesce("_start", F.lit(0)), F.coalesce("_end", "_n")).groupBy("_d", "_k", "_level", "_node").agg(best)
    marks = edges.select("_d", "_k", "_n", "_i", "_p").distinct().withColumn("_until", F.coalesce(F.lead("_p").over(own.orderBy("_i")), (F.col("_k") + 1) * width))
    asked = marks.withColumn("_level", F.explode(_levels(F.col("_n")))).withColumn("_node", F.expr("shiftright(_i, _level)"))
    found = asked.join(inside, ["_d", "_k", "_level", "_node"], "left").groupBy("_d", "_k", "_p", "_until").agg(F.min("_best").alias("_inside"))
    won = F.least("_inside", "_whole")["b"]
    stretches = found.join(whole, ["_d", "_k"], "left").select("_d", "_k", "_p", "_until", won.alias("study_id")).filter("study_id IS NOT NULL")
    same = (F.col("device_id") == F.col("_d")) & (period(moment) == F.col("_k")) & (moment >= F.col("_p")) & (moment < F.col("_until"))
    return rows.join(stretches, same, "left").drop("_d", "_k", "_p", "_until")


def in_interval(points: DataFrame, intervals: DataFrame, *, key: str, time: str, start: str, end: str, days: int = 1) -> DataFrame:
    """Every (point, interval) of the same key with start <= time < end; intervals must not share column names but the key's.

    An interval goes to the periods of ``days`` days that have points of its key: to the one it starts in, and to those
    whose start it holds.  A point is in one period, so it moves once.
    """
    width = days * DAY
    spans = intervals.withColumns({"_from": F.unix_micros(start), "_to": F.unix_micros(end)}).filter("_to > _from")
    placed = points.withColumn("_period", _period(F.unix_micros(time), width))
    used = placed.select(key, "_period").filter(F.col(key).isNotNull() & F.col("_period").isNotNull()).distinct()
    first = spans.withColumn("_period", _period(F.col("_from"), width)).join(used, [key, "_period"], "left_semi")
    later = _holding(used.withColumn("_p", F.col("_period")), spans, [key], width).filter("_from < _p").drop("_p")
    near = placed.join(first.unionByName(later), [key, "_period"])
    return near.filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_period", "_from", "_to")


def synchronised(ecg: DataFrame, impedance: DataFrame, keys: tuple[str, ...] = ("study_id", "frame")) -> DataFrame:
    """Two signals on one time axis: the same frame is the same clock."""
    return ecg.join(impedance, list(keys))


def event_chain(events: DataFrame, batches: DataFrame, devices: DataFrame, patients: DataFrame) -> DataFrame:
    """Events with their batch's device and its patient; events of devices without a live patient go."""
    b = batches.select(F.col("id").alias("_b"), "device_id", "batch_timestamp")
    d = live(devices).filter(F.col("patient_id").isNotNull()).select(F.col("id").alias("_d"), "patient_id", "serial_number")
    p = live(patients).select(F.col("id").alias("_p"), "doctor_id")
    return events.join(b, F.col("batch_id") == F.col("_b")).join(d, F.col("device_id") == F.col("_d")).join(p, F.col("patient_id") == F.col("_p")).drop("_b", "_d", "_p")


def doctor_of(users: DataFrame, doctors: DataFrame) -> DataFrame:
    """Live users with their doctor row; doctors are looked up whether deleted or not."""
    return live(users).join(doctors.select(F.col("user_id").alias("_u"), F.col("id").alias("doctor_id"), "specialty"), F.col("id") == F.col("_u")).drop("_u")
