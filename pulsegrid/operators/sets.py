"""Bag union, list sets and changed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats included, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add(values: Column, value: Column) -> Column:
    return F.array_union(values, F.array(value))


def remove(values: Column, value: Column) -> Column:
    return F.array_except(values, F.array(value))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, changes): the columns whose value differs, null-safe, with the new value as text; unchanged rows have an empty map."""
    b = before.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = after.join(b, F.col(key) == F.col("_k"))
    differs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"), (~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias("differs")) for c in columns])
    kept = F.transform(F.filter(differs, lambda x: x["differs"]), lambda x: F.struct(x["key"], x["value"]))
    return rows.select(F.col(key), F.map_from_entries(kept).alias("changes"))
