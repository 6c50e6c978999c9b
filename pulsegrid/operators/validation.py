"""Data-quality rules: (valid, quarantined), the latter with the names of the rules they break."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.clock import at
from pulsegrid.functions.text import strip
from pulsegrid.operators.predicates import UUID
from pulsegrid.schemas import SEXES

EMAIL = r"^[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"


def length_between(c: Column, least: int, most: int) -> Column:
    return F.length(c).between(least, most)


def optional(c: Column, rule: Column) -> Column:
    return c.isNull() | rule


def patient_rules() -> dict[str, Column]:
    """Bounds that the service itself checks."""
    c = F.col
    return {
        "full_name_length": length_between(c("full_name"), 1, 240), "dni_length": length_between(c("dni"), 1, 50), "birth_date": c("birth_date").isNotNull(), "sex": c("sex").isin(*SEXES),
        "email_length": optional(c("contact_email"), F.length("contact_email") <= 320), "phone_length": optional(c("contact_phone"), F.length("contact_phone") <= 50),
    }


def patient_form_rules(as_of: datetime | str) -> dict[str, Column]:
    """Stricter rules of the form; birth_date is text there."""
    day = F.try_to_timestamp("birth_date", F.lit("yyyy-MM-dd")).cast("date")
    email = F.coalesce("contact_email", F.lit(""))
    return {
        "name": F.length(strip(F.col("full_name"))) >= 2, "dni": strip(F.col("dni")).rlike(r"^\d{8}$"), "birth_date": day.isNotNull() & (F.year(day) > 1900) & (day <= at(as_of).cast("date")),
        "sex": F.col("sex").isin(*SEXES), "email": (email == "") | email.rlike(EMAIL),
    }


def device_rules() -> dict[str, Column]:
    return {"serial_length": length_between(F.col("serial"), 1, 120), "model_length": length_between(F.col("model"), 1, 120), "firmware_length": optional(F.col("firmware_version"), F.length("firmware_version") <= 120)}


def device_form_rules() -> dict[str, Column]:
    return {"serial": strip(F.col("serial")).rlike(r"^HOLTER-AR-\d{3,}$"), "model": F.length(strip(F.col("model"))) >= 2}


def device_edit_rules() -> dict[str, Column]:
    return {"model": F.length(strip(F.col("model"))) >= 2, "status": F.col("status").isin("available", "maintenance")}


def is_uuid(c: Column) -> Column:
    return F.lower(c).rlike(UUID)


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold (unknown counts as not)."""
    return F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("broken_rules", broken(rules))
    return marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), marked.filter(F.size("broken_rules") > 0)
