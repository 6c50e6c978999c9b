"""Filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.text import concat_skip_null, ilike_pattern

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


class CardinalityError(ValueError):
    """A point lookup found more than one row."""


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def tenant(df: DataFrame, doctor_id: str) -> DataFrame:
    """Rows of one doctor."""
    return df.filter(F.col("doctor_id") == doctor_id)


def members(df: DataFrame, column: str, values: list[str] | tuple[str, ...] | None) -> DataFrame:
    """Membership; an empty or missing list does not filter."""
    return df.filter(F.col(column).isin(*values)) if values else df


def text_search(df: DataFrame, q: str | None, *columns: Column) -> DataFrame:
    """Case-insensitive search in any column; no text does not filter, blanks match every non-null column."""
    if not q:
        return df
    any_of: Column | None = None
    for c in columns:
        one = c.ilike(ilike_pattern(q))
        any_of = one if any_of is None else any_of | one
    return df.filter(any_of)


def patient_search(df: DataFrame, q: str | None) -> DataFrame:
    return text_search(df, q, concat_skip_null(F.col("first_name"), F.lit(" "), F.col("last_name")), F.col("dni"))


def device_search(df: DataFrame, q: str | None) -> DataFrame:
    return text_search(df, q, F.col("serial_number"), F.col("model"), F.col("firmware_version"))


def substring_search(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Case-folded containment, neither trimmed nor with wildcards."""
    if not q:
        return df
    any_of: Column | None = None
    for c in columns:
        one = F.contains(F.lower(F.col(c)), F.lit(q.lower()))
        any_of = one if any_of is None else any_of | one
    return df.filter(any_of)


def point(df: DataFrame, **keys: object) -> DataFrame:
    """At most two rows with these values: enough to see whether there is one."""
    for column, value in keys.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df.limit(2)


def one(df: DataFrame):
    """The row, None, or an error if there are more."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise CardinalityError("more than one row")
    return rows[0] if rows else None


def excluding(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) != F.lit(value))


def assigned_to(devices: DataFrame, patient_id: str | None = None) -> DataFrame:
    """Live assigned devices, of one patient or of all."""
    out = live(devices).filter((F.col("status") == "assigned") & F.col("patient_id").isNotNull())
    return out if patient_id is None else out.filter(F.col("patient_id") == patient_id)


def valid_session(users: DataFrame, issued_at: Column) -> DataFrame:
    """Live, active users whose token was issued after their last logout."""
    return live(users).filter(F.col("is_active") & (F.col("last_logout_at").isNull() | (issued_at > F.col("last_logout_at"))))


def allowed_role(role: Column, allowed: list[str] | tuple[str, ...]) -> Column:
    return (role == "admin") | role.isin(*allowed)


def tri_state(df: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    """True: set; False: not set; None: either."""
    if wanted is None:
        return df
    return df.filter(F.col(column).isNotNull() if wanted else F.col(column).isNull())


def between(df: DataFrame, column: str, start: object = None, end: object = None) -> DataFrame:
    """A closed range, either end open if None."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df if end is None else df.filter(F.col(column) <= F.lit(end))


@dataclass(frozen=True)
class Page:
    """Checked page parameters."""

    limit: int = 20
    offset: int = 0
    sort: str = "last_data"
    order: str = "desc"

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 100:
            raise ValueError("limit is 1 to 100")
        if self.offset < 0:
            raise ValueError("offset is 0 or more")
        if not re.fullmatch("last_data|name", self.sort) or not re.fullmatch("asc|desc", self.order):
            raise ValueError("unknown sort or order")


def window_hours(hours: int = 24) -> int:
    if hours < 1:
        raise ValueError("windowHours is 1 or more")
    return hours
