"""Signed links, one-time keys and cookies as columns: no key leaves the JVM, no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block of SHA-256 in bytes, and the pads of HMAC (RFC 2104).
BLOCK, INNER, OUTER = 64, 0x36, 0x5C
HOUR = 3600


def _sha256(message: Column) -> Column:
    return F.unhex(F.sha2(message, 256))


def pads(key: Column) -> Column:
    """(inner, outer) of a key: what HMAC puts before its messages.  For one key and many messages, work them out once."""
    def padded(full: Column, pad: int) -> Column:
        byte = lambda i: F.conv(F.substring(full, 2 * i - 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))

    def block(k: Column) -> Column:
        return F.rpad(F.hex(F.when(F.octet_length(k) > BLOCK, _sha256(k)).otherwise(k)), 2 * BLOCK, "0")

    return _once(_once(key, block), lambda full: F.struct(padded(full, INNER).alias("inner"), padded(full, OUTER).alias("outer")))


def signed(both: Column, message: Column) -> Column:
    """HMAC-SHA256 of a message, as binary, by the ``pads`` of the key."""
    return _sha256(F.concat(both["outer"], _sha256(F.concat(both["inner"], message))))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 of binary columns, as binary."""
    return _once(pads(key), lambda both: signed(both, message))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once however often f names it: an array of one binds it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _text(c: Column | str) -> Column:
    return (F.lit(c) if isinstance(c, str) else c).cast("binary")


def signing_key(secret: Column, day: Column, region: str, service: str = "s3") -> Column:
    """The key of one day, region and service (signature version 4)."""
    key = hmac_sha256(F.concat(_text("AWS4"), secret.cast("binary")), _text(day))
    for part in (region, service, "aws4_request"):
        key = hmac_sha256(key, _text(part))
    return key


def encoded(c: Column, *, slash: bool = False) -> Column:
    """Percent-encoded as RFC 3986 has it; ``slash`` leaves slashes."""
    out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if slash else out


def _stamp(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def signing_pads(at: Column, region: str, secret: Column) -> Column:
    """The ``pads`` of the signing key of a time's day; they are as secret as the key."""
    return pads(signing_key(secret, F.substring(_stamp(at), 1, 8), region))


def signed_link(key: Column, at: Column, *, host: str, region: str, access_key: str, secret: Column | None = None, pads: Column | None = None, expires: int = HOUR) -> Column:
    """A link to read an object for ``expires`` seconds from ``at`` on; null for no key.

    Signature version 4 in the query string, payload unsigned.  ``secret`` is a column, best joined from a table, as a
    literal would stand in the plan.  For many objects of a day give ``pads`` instead, the ``signing_pads`` of the day
    joined from a table with a row a day: deriving them costs far more than a link does.
    """
    if (secret is None) == (pads is None):
        raise ValueError("give either a secret or pads")
    stamp = _stamp(at)
    day = F.substring(stamp, 1, 8)
    scope = F.concat(day, F.lit(f"/{region}/s3/aws4_request"))
    path = F.concat(F.lit("/"), encoded(key, slash=True))
    query = F.concat(F.lit("X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Credential="), encoded(F.concat(F.lit(f"{access_key}/"), scope)), F.lit("&X-Amz-Date="), stamp, F.lit(f"&X-Amz-Expires={expires}&X-Amz-SignedHeaders=host"))
    request = F.concat(F.lit("GET\n"), path, F.lit("\n"), query, F.lit(f"\nhost:{host}\n\nhost\nUNSIGNED-PAYLOAD"))
    message = F.concat(F.lit("AWS4-HMAC-SHA256\n"), stamp, F.lit("\n"), scope, F.lit("\n"), F.sha2(request.cast("binary"), 256))
    digest = hmac_sha256(signing_key(secret, day, region), _text(message)) if pads is None else signed(pads, _text(message))
    return F.concat(F.lit(f"https://{host}"), path, F.lit("?"), query, F.lit("&X-Amz-Signature="), F.lower(F.hex(digest)))


def one_time_key(secret: Column, *parts: Column) -> Column:
    """A url-safe key of 32 bytes for a new device, to be shown once and never stored: HMAC of what names the device.

    The same secret and parts give the same key, so a task that runs twice shows the same one; store its SHA-256 only
    (``text.key_hash``).
    """
    raw = hmac_sha256(secret.cast("binary"), _text(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))
    return F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "[=\r\n]", "")


def session_cookie(name: str, token: Column, secure: Column, minutes: int) -> Column:
    """The header of a session's cookie: for scripts unreadable, of any site where the connection is secure, else lax."""
    site = F.when(secure, F.lit("; SameSite=none; Secure")).otherwise(F.lit("; SameSite=lax"))
    return F.concat(F.lit(f"{name}="), token, F.lit(f"; HttpOnly; Max-Age={minutes * 60}; Path=/"), site)
