"""Requests and sessions as columns: error codes, retries, waiting times, claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Error codes of response statuses, and of failures without a response.
STATUS_CODES = {400: "VALIDATION", 401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND", 409: "CONFLICT", 422: "VALIDATION"}
FAILURE_CODES = {"ECONNABORTED": "TIMEOUT", "ETIMEDOUT": "TIMEOUT", "ERR_CANCELED": "CANCELLED"}
MAX_RETRIES = 2


def error_code(status: Column, failure: Column) -> Column:
    """The failure's own code, NETWORK without a response, the status's code, SERVER from 500 on, else UNKNOWN."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, code in FAILURE_CODES.items():
        out = out.when(failure == name, F.lit(code))
    out = out.when(status.isNull(), F.lit("NETWORK"))
    for number, code in STATUS_CODES.items():
        out = out.when(status == number, F.lit(code))
    return out.when(status >= 500, F.lit("SERVER")).otherwise(F.lit("UNKNOWN"))


def may_retry(method: Column, status: Column, failure: Column, attempt: Column, *, most: int = MAX_RETRIES) -> Column:
    """Reads only (a method that is not given counts as one), fewer than ``most`` attempts, not cancelled, and no response or a 5xx."""
    read = method.isNull() | (F.lower(method) == "get")
    cancelled = F.coalesce(failure == "ERR_CANCELED", F.lit(False))
    return (attempt < most) & read & ~cancelled & (status.isNull() | status.between(500, 599))


def upload_interval_hours(failures: Column) -> Column:
    """A device's hours to its next upload after so many failures in a row: 1, and from the third on 2, then 4."""
    return F.when(failures < 3, 1).when(failures == 3, 2).otherwise(4)


#: A recorder's states in order, and where a failure leads.
DEVICE_STATES = ("RECORDING", "PREPARING_BATCH", "SIM_WAKING", "SENDING", "CONFIRMING", "CLEANING_SD", "SIM_SLEEPING")
MAY_FAIL = ("SIM_WAKING", "SENDING", "CONFIRMING")


def next_device_state(state: Column, succeeded: Column) -> Column:
    """The state after ``state``: the next of the cycle, SIM_ERROR after a failure of the modem or the upload, then SIM_SLEEPING."""
    out = F.when(state == "SIM_ERROR", F.lit("SIM_SLEEPING")).when(state.isin(*MAY_FAIL) & ~succeeded, F.lit("SIM_ERROR"))
    for now, then in zip(DEVICE_STATES, (*DEVICE_STATES[1:], DEVICE_STATES[0]), strict=True):
        out = out.when(state == now, F.lit(then))
    return out


def claims(user_id: Column, email: Column, role: Column, issued_at: Column, minutes: int) -> Column:
    """struct(sub, email, role, iat, exp) of a session token; times in whole epoch seconds."""
    iat = F.floor(F.unix_micros(issued_at) / 1_000_000).cast("bigint")
    return F.struct(user_id.cast("string").alias("sub"), email.alias("email"), role.alias("role"), iat.alias("iat"), (iat + minutes * 60).alias("exp"))


def stored_session(text: Column, schema: StructType | str) -> Column:
    """A session kept as JSON; null where the text is no such JSON."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(F.get_json_object(text, "$").isNotNull(), parsed)
