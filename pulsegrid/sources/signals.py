"""Sampled signals: blobs, upload payloads, frames, laboratory files and the EDF+ export."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.shipping import ship

#: Samples in one row at most.
CHUNK = 65_536
#: Full scale of a 24-bit code: reference voltage over gain, in microvolts per code.
MICROVOLTS = 2.4 / (6 * (2**23 - 1)) * 1e6


def chunked(samples: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    for k, i in enumerate(range(0, len(samples), most)):
        yield k, samples[i : i + most]


def blob_scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of signal objects in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def checked_blobs(blobs: DataFrame, expected: str = "sample_count") -> tuple[DataFrame, DataFrame]:
    """(whole, corrupt): a blob holds four bytes for every sample, no more and no less."""
    whole = F.length("content") == F.col(expected) * 4
    return blobs.filter(whole), blobs.filter(~F.coalesce(whole, F.lit(False))).withColumn("code", F.lit("SIGNAL_CORRUPT"))


def decode_float32(blobs: DataFrame, key: str, *, most: int = CHUNK) -> DataFrame:
    """(key, chunk_index, samples): little-endian 4-byte floats in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, part in chunked(np.frombuffer(content or b"", dtype="<f4"), most):
                    yield pa.RecordBatch.from_arrays([pa.array([k], batch.schema.field(0).type), pa.array([i], pa.int32()), pa.array([part], pa.list_(pa.float32()))], names=["key", "chunk_index", "samples"])

    ship(blobs.sparkSession)
    rows = blobs.select(F.col(key).alias("key"), "content")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, chunk_index int, samples array<float>")


def decode_payload(data: str, channels: int, compression: str) -> np.ndarray:
    """[sample, channel] of one base64 payload: 16-bit little-endian deltas, or raw samples, row-major over channels."""
    values = np.frombuffer(base64.b64decode(data, validate=True), dtype="<i2").reshape(-1, channels).astype(np.int64)
    return (values if compression == "raw" else np.cumsum(values, axis=0)).astype(np.float32)


def encode_payload(samples: np.ndarray, compression: str = "delta") -> str:
    """The inverse, for samples whose steps fit 16 bits."""
    whole = np.asarray(samples, dtype=np.int64)
    values = whole if compression == "raw" else np.diff(whole, axis=0, prepend=np.zeros((1, whole.shape[1]), dtype=np.int64))
    return base64.b64encode(values.astype("<i2").tobytes()).decode()


def decode_batches(batches: DataFrame, *, scale: float = 1.0, most: int = CHUNK) -> DataFrame:
    """(batch_id, channel, chunk_index, samples, error) of upload payloads.

    Takes id, data, num_channels, compression_type.  A payload that does not decode gives one row with its error.
    ``scale`` turns codes into millivolts; its value is a property of the front end and is not specified.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: list[tuple] = []
            for row in batch.to_pylist():
                try:
                    signal = decode_payload(row["data"], row["num_channels"] or 1, row["compression_type"] or "delta") * np.float32(scale)
                    for c in range(signal.shape[1]):
                        out += [(row["id"], c, k, part, None) for k, part in chunked(signal[:, c], most)]
                except Exception as e:  # one bad payload must not fail its batch
                    out.append((row["id"], None, None, None, f"{type(e).__name__}: {e}"[:500]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["batch_id", "channel", "chunk_index", "samples", "error"])

    ship(batches.sparkSession)
    return batches.select(F.col("id").cast("string").alias("id"), "data", "num_channels", "compression_type").mapInArrow(run, "batch_id string, channel int, chunk_index int, samples array<float>, error string")


def signed24(code: Column) -> Column:
    """A 24-bit two's complement number from the last six digits of a hexadecimal word."""
    n = F.conv(F.right(code, F.lit(6)), 16, 10).cast("bigint")
    return F.when(n >= 1 << 23, n - (1 << 24)).otherwise(n)


def microvolts(code: Column) -> Column:
    return signed24(code) * F.lit(MICROVOLTS)


def frames(df: DataFrame, content: str = "content") -> DataFrame:
    """Unpack 72-bit frames: frame index, status word, and signed ECG and impedance codes; a cut-off last frame is left out.

    Both signals share the frame index, and so one clock.
    """
    n = F.floor(F.length(content) / 9).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("frame", F.explode(index))
    word = lambda k: F.hex(F.substring(F.col(content), F.col("frame") * 9 + 1 + 3 * k, F.lit(3)))
    return out.select(*[c for c in df.columns if c != content], "frame", word(0).alias("status"), signed24(word(1)).alias("ecg"), signed24(word(2)).alias("impedance"))


def lab_codes(spark: SparkSession, path: str) -> DataFrame:
    """(status_hex, code_hex, code, microvolts) of a laboratory code file; header lines do not have the shape of data."""
    shape = r"^([0-9A-Fa-f]{16})\t([0-9A-Fa-f]{8}),?$"
    rows = spark.read.text(path).filter(F.col("value").rlike(shape))
    rows = rows.select(F.regexp_extract("value", shape, 1).alias("status_hex"), F.regexp_extract("value", shape, 2).alias("code_hex"))
    return rows.select("*", signed24(F.col("code_hex")).alias("code"), microvolts(F.col("code_hex")).alias("microvolts"))


def lab_values(spark: SparkSession, path: str) -> DataFrame:
    shape = r"^(-?[0-9]+(?:\.[0-9]+)?(?:E[+-][0-9]+)?),*$"
    return spark.read.text(path).filter(F.col("value").rlike(shape)).select(F.regexp_extract("value", shape, 1).cast("double").alias("value"))


def lab_registers(spark: SparkSession, path: str) -> DataFrame:
    """(register, address, value, d7 ... d0)."""
    shape = r"^([A-Z0-9_]+),(0x[0-9A-Fa-f]+),(0x[0-9A-Fa-f]+),([01]),([01]),([01]),([01]),([01]),([01]),([01]),([01])$"
    rows = spark.read.text(path).filter(F.col("value").rlike(shape))
    part = lambda i: F.regexp_extract("value", shape, i)
    return rows.select(part(1).alias("register"), part(2).alias("address"), part(3).alias("setting"), *[part(4 + i).cast("int").alias(f"d{7 - i}") for i in range(8)]).withColumnRenamed("setting", "value")


def edf_bytes(samples: np.ndarray, rate: int, *, patient: str = "X X X X", recording: str = "Startdate X X X X", label: str = "ECG", start: tuple[str, str] = ("01.01.85", "00.00.00"), unit: str = "uV", scale: float = 1.0) -> bytes:
    """One EDF+ file (continuous, one signal and its annotations) of 16-bit samples in one-second records."""
    digital = np.clip(np.round(np.asarray(samples, dtype=np.float64) / scale), -32768, 32767).astype("<i2")
    records = max(1, -(-len(digital) // rate))
    digital = np.concatenate((digital, np.zeros(records * rate - len(digital), dtype="<i2")))
    words = 30  # of the annotation signal in each record
    field = lambda text, n: str(text)[:n].ljust(n).encode("ascii", "replace")
    number = lambda x: f"{x:.8g}"[:8]
    head = field("0", 8) + field(patient, 80) + field(recording, 80) + field(start[0], 8) + field(start[1], 8) + field(768, 8) + field("EDF+C", 44) + field(records, 8) + field(1, 8) + field(2, 4)
    for one, n in ((("label", 16)), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("dlow", 8), ("dhigh", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        signal = {"label": label, "unit": unit, "low": number(-32768 * scale), "high": number(32767 * scale), "dlow": -32768, "dhigh": 32767, "samples": rate}.get(one, "")
        notes = {"label": "EDF Annotations", "low": -1, "high": 1, "dlow": -32768, "dhigh": 32767, "samples": words}.get(one, "")
        head += field(signal, n) + field(notes, n)
    body = b"".join(digital[i * rate : (i + 1) * rate].tobytes() + f"+{i}\x14\x14\x00".encode().ljust(2 * words, b"\0") for i in range(records))
    return head + body


def export_edf(signals: DataFrame, *, scale: float = 1.0) -> DataFrame:
    """(study_id, file): one EDF+ file per study from its chunks; a study's signal is held whole by one task."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("chunk_index").to_numpy())
        parts = t.column("samples").to_pylist()
        samples = np.concatenate([np.asarray(parts[i], dtype=np.float32) for i in order])
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([edf_bytes(samples, t.column("sample_rate")[0].as_py(), scale=scale)], pa.binary())], names=["study_id", "file"])

    ship(signals.sparkSession)
    return signals.groupBy("study_id").applyInArrow(run, "study_id string, file binary")
