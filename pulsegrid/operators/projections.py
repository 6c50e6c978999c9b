"""Renames and form conversions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.text import blank_to_null, null_to_blank, strip


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def to_camel(df: DataFrame) -> DataFrame:
    """Column names as the public interface spells them."""
    return df.toDF(*[camel(c) for c in df.columns])


def to_snake(df: DataFrame) -> DataFrame:
    """Either spelling becomes the internal one."""
    return df.toDF(*[snake(c) for c in df.columns])


def patient_form_to_input(forms: DataFrame) -> DataFrame:
    """Trim every field; a blank contact is null."""
    return forms.select(
        *[c for c in forms.columns if c not in ("full_name", "dni", "birth_date", "sex", "contact_email", "contact_phone")],
        strip(F.col("full_name")).alias("full_name"), strip(F.col("dni")).alias("dni"), "birth_date", "sex", blank_to_null(F.col("contact_email")).alias("contact_email"), blank_to_null(F.col("contact_phone")).alias("contact_phone"),
    )


def device_form_to_input(forms: DataFrame) -> DataFrame:
    return forms.select(strip(F.col("serial")).alias("serial"), strip(F.col("model")).alias("model"), blank_to_null(F.col("firmware_version")).alias("firmware_version"))


def patient_to_form(patients: DataFrame) -> DataFrame:
    """What the edit form starts from: nulls are blanks."""
    return patients.select("id", "full_name", "dni", F.col("birth_date").cast("string").alias("birth_date"), "sex", null_to_blank(F.col("contact_email")).alias("contact_email"), null_to_blank(F.col("contact_phone")).alias("contact_phone"))


def user_out(users: DataFrame) -> DataFrame:
    return users.select("id", "email", "full_name", "role")
