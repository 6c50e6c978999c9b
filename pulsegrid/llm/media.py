"""Media columns: FLAC.

``stored`` writes each document's bytes as a FLAC stream of 8-bit samples; ``pcm_blocks`` decodes FLAC media
(Rice residuals, fixed and general linear predictors), verifies frame and stream checksums, and returns PCM blocks
with the sample offset at which each can be sought.

Defined cases: a null text is the empty text; the empty text becomes one payload unit of zeros; equal texts give
equal media; an empty table gives an empty result; a null medium gives no block; further columns are ignored.
A damaged stream raises ``FlacError`` unless ``errors="null"``, which yields one block with null PCM.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, table, texts
from pulsegrid.llm.flac import FlacError, decode, encode, stream_bits

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Bytes of text or media worked on at once in a task.
SLICE = 3 << 19


def _payload(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text)) % UNIT if text else UNIT)


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 bytes as a FLAC stream."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                raw = texts(part)
                media = encode([_payload(x) for x in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def pcm_blocks(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", errors: str = "raise") -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, bits, pcm): one row per FLAC frame.

    Samples are signed and little-endian, of one byte where the stream's ``bits`` per sample are 8 or fewer, else of two.
    """
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).filter(F.col("media").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    (x,), (where,) = decode([raw])
                    bits = stream_bits(raw)
                    out = [(i, at, n, bits, x[at : at + n].astype("<i1" if bits <= 8 else "<i2").tobytes()) for i, (at, n) in enumerate(where)]
                except FlacError:
                    if errors != "null":
                        raise
                    out = [(0, 0, 0, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(out), batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))], names=["doc_id", "block", "sample_offset", "n_samples", "bits", "pcm"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, block int, sample_offset bigint, n_samples int, bits int, pcm binary")


def _features(samples: list[np.ndarray]) -> list[str]:
    """Root mean square, zero crossings, peak and mean step of each sample array, from exact sums."""
    x = np.concatenate(samples).astype(np.int64)
    n = np.array([len(s) for s in samples])
    at = np.cumsum(n) - n
    step = np.abs(np.diff(x, prepend=x[:1]))
    step[at] = 0
    cross = np.diff(np.signbit(x), prepend=np.signbit(x[:1])).astype(np.int64)
    cross[at] = 0
    square, steps, crossings, peak = np.add.reduceat(x * x, at), np.add.reduceat(step, at), np.add.reduceat(cross, at), np.maximum.reduceat(np.abs(x), at)
    return [f"rms={(a / m) ** 0.5:.6f};zcr={c / m:.6f};peak={p};step={b / m:.6f}" for a, b, c, p, m in zip(square.tolist(), steps.tolist(), crossings.tolist(), peak.tolist(), n.tolist(), strict=True)]


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored bytes say when read back: payload digests, media digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", SLICE):
                raw = part.column(2).to_pylist()
                samples, _ = decode(raw)
                read = [(x + 128).astype(np.uint8).tobytes() for x in samples]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(x) for x in read], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in read]),
                        pa.array([zlib.crc32(x[-UNIT:]) for x in read], pa.int64()),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                        pa.array(_features(samples)),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(stored(table(spark, sf_dir, "documents")))


QUERIES = {"op10_flac": op10_flac}
SQL: dict[str, str] = {}
