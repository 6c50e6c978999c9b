"""Names, search text, labels and other strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display labels.
STUDY_STATUS = {"in_progress": ("En curso", "success"), "completed": ("Completado", "info"), "cancelled": ("Cancelado", "destructive"), "scheduled": ("Programado", "warning")}
DEVICE_STATUS = {"available": "Disponible", "assigned": "Asignado", "maintenance": "Mantenimiento", "retired": "Retirado"}
SEX = {"M": "Masculino", "F": "Femenino", "X": "No especificado"}
SEVERITY = {"critical": ("Crítica", "destructive"), "high": ("Alta", "warning"), "medium": ("Media", "info"), "low": ("Baja", "neutral")}
ALERT_KIND = {"tachycardia": "Taquicardia", "bradycardia": "Bradicardia", "afib": "Fibrilación auricular", "pvc": "Extrasístole (PVC)", "pause": "Pausa", "noise": "Ruido / artefacto", "device_offline": "Dispositivo sin transmitir"}
WATCHDOG = {"offline": ("Sin transmitir", "destructive"), "low_battery": ("Batería baja", "warning"), "poor_signal": ("Señal pobre", "warning")}
SIGNAL_QUALITY = {"good": ("Buena", "success"), "fair": ("Regular", "warning"), "poor": ("Pobre", "destructive"), "none": ("Sin señal", "neutral")}


def concat_skip_null(*parts: Column) -> Column:
    """PostgreSQL's concat: nulls are skipped."""
    return F.concat_ws("", *parts)


def strip(text: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat_ws(" ", first, last))


def split_full_name(name: Column) -> Column:
    """struct(first, last): the first word, the others joined by single spaces; null for a name without words."""
    trimmed = strip(name)
    words = F.split(trimmed, r"\s+")
    parts = F.struct(F.element_at(words, 1).alias("first"), F.array_join(F.slice(words, 2, F.size(words)), " ").alias("last"))
    return F.when(F.length(trimmed) > 0, parts)


def initials(name: Column, fallback: str | None = None) -> Column:
    """Upper-case first letters of the first two words."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: F.length(w) > 0)
    out = F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return out if fallback is None else F.when(out == "", F.lit(fallback)).otherwise(out)


def email_name(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first hop of a forwarded list, else the peer."""
    return F.coalesce(F.when(F.length(forwarded) > 0, strip(F.split_part(forwarded, F.lit(","), F.lit(1)))), peer)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def ilike_pattern(q: str) -> str:
    """The pattern of a search text: trimmed; % and _ stay live, a backslash stands for itself."""
    return "%" + q.strip().replace("\\", "\\\\") + "%"


def parse_list(text: Column, domain: tuple[str, ...]) -> Column:
    """Known values of a comma-separated list; order and repeats stay."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x.isin(*domain))


def toggle(values: Column, value: Column) -> Column:
    """Take a value out of a list that has it, else append it."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def null_to_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def label(value: Column, names: dict[str, str | tuple[str, str]], part: int = 0) -> Column:
    """A closed domain's display name (part 0) or badge variant (part 1); null for unknown values."""
    out: Column | None = None
    for key, shown in names.items():
        text = shown if isinstance(shown, str) else shown[part]
        out = F.when(value == key, F.lit(text)) if out is None else out.when(value == key, F.lit(text))
    return out


def thousands(n: Column) -> Column:
    """Thousands set off by points."""
    return F.translate(F.format_number(n, 0), ",", ".")


def synthetic_email(first: Column, last: Column) -> Column:
    """first.last@example.com in lower case; of the surname's accented vowels, the first of each kind is replaced."""
    plain = F.lower(last)
    for accented, vowel in (("á", "a"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("é", "e")):
        plain = F.regexp_replace(plain, f"^([^{accented}]*){accented}", f"$1{vowel}")
    return F.concat(F.lower(first), F.lit("."), plain, F.lit("@example.com"))


def study_id_parts(study: Column) -> Column:
    """struct(patient, number) of an id such as s_p_001_2; null for others."""
    shape = r"^s_(p_\d+)_(\d+)$"
    return F.when(study.rlike(shape), F.struct(F.regexp_extract(study, shape, 1).alias("patient"), F.regexp_extract(study, shape, 2).cast("int").alias("number")))


def serial_of(device: Column, prefix: str = "HOLTER-AR-") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(device, "^d_", ""))


def padded(prefix: str, number: Column, width: int = 3) -> Column:
    """An id such as d_007; numbers wider than ``width`` are not cut."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def cyclic(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def metadata_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
