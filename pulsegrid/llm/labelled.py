"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import id_text


def agreed(labels: DataFrame, label_col: str) -> DataFrame:
    """(__id, mark): one row per labelled id; ids whose labels differ are left out, as are null labels."""
    rows = labels.select(id_text().alias("__id"), F.col(label_col).cast("int").alias("mark")).filter("mark is not null")
    one = rows.groupBy("__id").agg(F.min("mark").alias("mark"), F.max("mark").alias("__most"))
    return one.filter("mark = __most").drop("__most")


def sample_ids(ids: DataFrame, most: int, role: str) -> DataFrame:
    """Up to ``most`` of the distinct ids in column ``__id``, lowest hash first, whatever the order of the rows.

    Only ids below a threshold of the hash, four times as many as are wanted, are made distinct and sorted; where ids
    repeat so often that these are too few, all are.
    """
    order = F.xxhash64("__id", F.lit("sample"))
    cut = 4.0 * most / max(ids.count(), 1)
    some = ids.select("__id").filter(order / F.lit(2.0**64) + F.lit(0.5) <= cut).distinct()
    if cut < 1 and some.limit(most).count() < most:
        some = ids.select("__id").distinct()
    return some.orderBy(order, "__id").limit(most).select("__id", F.lit(role).alias("__role"))


def with_texts(docs: DataFrame, ids: DataFrame, text_col: str = "text") -> DataFrame:
    """(role, id, text) of the sampled ids, the smallest text of each; the ids are few by construction, so they are broadcast."""
    own = docs.select(id_text().alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(ids), "__id").select(F.col("__role").alias("role"), F.col("__id").alias("id"), "text")
    return rows.groupBy("role", "id").agg(F.min("text").alias("text"))
