"""Order, pages and top-k.  Every order is total: the id breaks ties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.predicates import Page
from pulsegrid.schemas import severity_rank


def patient_order(sort: str, order: str) -> list[Column]:
    """Patients by last data (nulls last either way, then last name) or by name."""
    c = F.col
    if sort == "last_data":
        return [c("last_data_received_at").desc_nulls_last(), c("last_name").desc(), c("id").asc()] if order == "desc" else [c("last_data_received_at").asc_nulls_last(), c("last_name").asc_nulls_last(), c("id").asc()]
    return [c("first_name").desc(), c("last_name").desc(), c("id").asc()] if order == "desc" else [c("first_name").asc_nulls_last(), c("last_name").asc_nulls_last(), c("id").asc()]


def newest(column: str, id_col: str = "id") -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col(id_col).asc()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; the offset comes before the limit."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], p: Page) -> tuple[DataFrame, DataFrame]:
    """(items, one row with total, limit, offset) over the same filtered rows."""
    total = df.agg(F.count("*").alias("total")).select("total", F.lit(p.limit).alias("limit"), F.lit(p.offset).alias("offset"))
    return page(df, order, p.limit, p.offset), total


def by_severity(df: DataFrame, created: str = "created_at") -> list[Column]:
    return [severity_rank(F.col("severity")).desc_nulls_last(), *newest(created)]


def oldest_pending(batches: DataFrame, most: int = 5) -> DataFrame:
    """The batches that an upload cycle sends first."""
    return batches.orderBy(F.col("batch_timestamp").asc(), F.col("id").asc()).limit(most)


@dataclass(frozen=True)
class PageLabels:
    page: int
    pages: int
    offset: int
    first: int
    last: int


def page_numbers(page_number: int, total: int, size: int = 20) -> PageLabels:
    """Page arithmetic: pages count from 1, there is always one."""
    number, pages = max(1, page_number), max(1, -(-total // size))
    offset = (number - 1) * size
    return PageLabels(number, pages, offset, 0 if total == 0 else offset + 1, min(offset + size, total))


def page_columns(page_number: Column, total: Column, size: int = 20) -> list[Column]:
    """The same as columns."""
    number = F.greatest(page_number, F.lit(1))
    offset = (number - 1) * size
    return [number.alias("page"), F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint").alias("pages"), offset.cast("bigint").alias("offset"), F.when(total == 0, 0).otherwise(offset + 1).cast("bigint").alias("first"), F.least(offset + size, total).cast("bigint").alias("last")]
