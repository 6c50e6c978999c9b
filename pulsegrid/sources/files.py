"""Signal files as data sources: EDF+ to write and read, raw float32 blobs to read by byte ranges.

``register(spark)`` names them ``edfplus`` and ``float32blob``.  Paths are anything that pyarrow opens: local or mounted
folders, ``hdfs://``, ``s3://``.

EDF+: one file per study in records of one second, an ECG signal, an impedance signal where there is one, and the
annotation signal that the format asks for.  ``write_edf`` brings each study's chunks together in order; the writer holds
one record and one chunk, whatever the study's length, as the number of records is known before.  Files are written under
names of their attempt and renamed when the job commits, so a task that runs twice leaves one file.  Reading splits a file
into ranges of records.

Blobs: a row is ``CHUNK`` samples, ranges are cut between rows, so any number of partitions gives equal rows.  Bytes past
the last whole sample are a row of their own with code SIGNAL_CORRUPT.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pulsegrid.operators.signal import sized
from pulsegrid.sources.shipping import ship

CHUNK = 65_536
#: Fixed values of the format: bytes of the header's fields, of the file and of each signal.
FILE_FIELDS = (8, 80, 80, 8, 8, 8, 44, 8, 8, 4)
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
NOTES, NOTE_WORDS = "EDF Annotations", 15


@dataclass(frozen=True)
class Signal:
    label: str
    unit: str
    scale: float  # units of one step
    rate: int

    def digital(self, x: np.ndarray) -> np.ndarray:
        whole = np.round(np.nan_to_num(x.astype(np.float64)) / self.scale)
        return np.clip(whole, -32_768, 32_767).astype("<i2")


def edf_header(records: int, signals: list[Signal], *, patient: str = "X X X X", recording: str = "Startdate X X X X", start: tuple[str, str] = ("01.01.85", "00.00.00")) -> bytes:
    count = len(signals) + 1
    values = ("0", patient, recording, *start, str(256 * (count + 1)), "EDF+C", str(records), "1", str(count))
    out = b"".join(v[:n].ljust(n).encode("ascii", "replace") for v, n in zip(values, FILE_FIELDS, strict=True))
    rows = [{"label": s.label, "unit": s.unit, "low": f"{-32_768 * s.scale:.8g}", "high": f"{32_767 * s.scale:.8g}", "digital_low": "-32768", "digital_high": "32767", "samples": str(s.rate)} for s in signals]
    rows.append({"label": NOTES, "low": "-1", "high": "1", "digital_low": "-32768", "digital_high": "32767", "samples": str(NOTE_WORDS)})
    return out + b"".join(r.get(name, "")[:n].ljust(n).encode("ascii", "replace") for name, n in SIGNAL_FIELDS for r in rows)


def edf_layout(head: bytes) -> tuple[int, int, list[Signal], int]:
    """(bytes of the header, records, signals without annotations, bytes of a record) of a file's first 256 * (signals + 1) bytes."""
    at, values = 0, []
    for n in FILE_FIELDS:
        values.append(head[at : at + n].decode("ascii").strip())
        at += n
    count, fields = int(values[9]), {}
    for name, n in SIGNAL_FIELDS:
        fields[name] = [head[at + i * n : at + (i + 1) * n].decode("ascii").strip() for i in range(count)]
        at += n * count
    signals = []
    for i in range(count):
        if fields["label"][i] != NOTES:
            span = int(fields["digital_high"][i]) - int(fields["digital_low"][i])
            signals.append(Signal(fields["label"][i], fields["unit"][i], (float(fields["high"][i]) - float(fields["low"][i])) / span, int(fields["samples"][i])))
    return int(values[5]), int(values[7]), signals, 2 * sum(map(int, fields["samples"]))


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class OpenStudy:
    """A file that is being written: what does not fill a record yet is held."""

    def __init__(self, store: fs.FileSystem, path: str, total: int, signals: list[Signal]):
        self.out, self.signals, self.rate = store.open_output_stream(path), signals, signals[0].rate
        self.records, self.done = max(1, -(-total // self.rate)), 0
        self.held = [np.zeros(0, dtype="<i2") for _ in signals]
        self.out.write(edf_header(self.records, signals))

    def add(self, parts: list[np.ndarray]) -> None:
        self.held = [np.concatenate([h, s.digital(p)]) for h, s, p in zip(self.held, self.signals, parts, strict=True)]
        whole = min(len(h) for h in self.held) // self.rate
        for k in range(whole):
            self._record([h[k * self.rate : (k + 1) * self.rate] for h in self.held])
        self.held = [h[whole * self.rate :] for h in self.held]

    def _record(self, parts: list[np.ndarray]) -> None:
        note = f"+{self.done}\x14\x14\x00".encode().ljust(2 * NOTE_WORDS, b"\0")
        self.out.write(b"".join(np.pad(p, (0, self.rate - len(p))).tobytes() for p in parts) + note)
        self.done += 1

    def close(self) -> None:
        if self.done < self.records:
            self._record([h[: self.rate] for h in self.held])
        if self.done != self.records:
            raise ValueError(f"a study has {self.done} records where {self.records} were announced: its chunks must come in order")
        self.out.close()


class EdfWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.scale, self.impedance_scale = float(options.get("scale", 1.0)), float(options.get("impedanceScale", 1.0))
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, top = self._store()
        aside, moves, study, open_ = f"{top}/_temporary/{self.job}", [], None, None
        try:
            for batch in batches:
                both = "impedance" in batch.schema.names
                for i in range(batch.num_rows):  # a chunk at a time
                    row = batch.slice(i, 1)
                    name, rate, total = (row.column(c)[0].as_py() for c in ("study_id", "sample_rate", "total"))
                    if open_ is None or name != study:
                        if open_ is not None:
                            open_.close()
                        store.create_dir(aside)
                        study, at = name, f"{aside}/{uuid.uuid4().hex}.edf"
                        signals = [Signal("ECG", "uV", self.scale, rate), *([Signal("Impedance", "Ohm", self.impedance_scale, rate)] if both else [])]
                        open_ = OpenStudy(store, at, total, signals)
                        moves.append((at, f"{top}/{quote(str(name), safe='')}.edf"))
                    parts = [np.asarray(row.column(c)[0].values.to_numpy(zero_copy_only=False)) if row.column(c)[0].is_valid else np.zeros(0) for c in (["samples", "impedance"] if both else ["samples"])]
                    if both and len(parts[1]) != len(parts[0]):  # a signal that is missing for a while stands still
                        parts[1] = np.pad(parts[1][: len(parts[0])].astype(np.float64), (0, max(0, len(parts[0]) - len(parts[1]))))
                    open_.add(parts)
        finally:
            if open_ is not None:
                open_.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = self._store()
        store.create_dir(top)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(top)):
                if old.path.endswith(".edf"):
                    store.delete_file(old.path)
        for message in messages:
            for at, to in message.moves if message else []:
                store.move(at, to)
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, top: str) -> None:
        aside = f"{top}/_temporary/{self.job}"
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


def _listed(path: str, ending: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, top = fs.FileSystem.from_uri(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File]
    return store, sorted((f for f in found if f.path.endswith(ending) and "/_" not in f.path[len(top) :]), key=lambda f: f.path)


class EdfReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.records = path, int(options.get("records", 3600))

    def partitions(self) -> list[Range]:
        store, files = _listed(self.path, ".edf")
        out = []
        for file in files:
            with store.open_input_file(file.path) as f:
                records = edf_layout(_head(f))[1]
            out += [Range(file.path, k, min(k + self.records, records)) for k in range(0, records, self.records)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        study = unquote(posixpath.basename(partition.path).removesuffix(".edf"))
        with store.open_input_file(partition.path) as f:
            head, _, signals, size = edf_layout(_head(f))
            for k in range(partition.first, partition.last):
                f.seek(head + k * size)
                words, at = np.frombuffer(f.read(size), dtype="<i2"), 0
                for s in signals:
                    yield pa.RecordBatch.from_arrays([pa.array([study]), pa.array([s.label]), pa.array([s.rate], pa.int32()), pa.array([k], pa.int32()), pa.array([words[at : at + s.rate] * s.scale], pa.list_(pa.float64()))], names=["study_id", "signal", "sample_rate", "chunk_index", "samples"])
                    at += s.rate


def _head(f) -> bytes:
    head = f.read(256)
    return head + f.read(256 * int(head[252:256]))


class EdfPlus(DataSource):
    """``spark.read.format("edfplus").load(path)``; to write, see ``write_edf``."""

    @classmethod
    def name(cls) -> str:
        return "edfplus"

    def schema(self) -> str:
        return "study_id string, signal string, sample_rate int, chunk_index int, samples array<double>"

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> EdfWriter:
        return EdfWriter(self.options["path"], self.options, overwrite)


class BlobReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.ending = path, options.get("ending", "")
        self.rows = max(1, int(options.get("rangeBytes", 64 << 20)) // (4 * CHUNK))

    def partitions(self) -> list[Range]:
        out = []
        for file in _listed(self.path, self.ending)[1]:
            rows = -(-file.size // (4 * CHUNK))
            out += [Range(file.path, k, min(k + self.rows, rows)) for k in range(0, rows, self.rows)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)

        def row(k: int, x: np.ndarray, code: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([k], pa.int64()), pa.array([x], pa.list_(pa.float32())), pa.array([code], pa.string())], names=["path", "chunk_index", "samples", "code"])

        with store.open_input_file(partition.path) as f:
            for k in range(partition.first, partition.last):
                f.seek(4 * CHUNK * k)
                content = f.read(4 * CHUNK)
                whole = len(content) // 4 * 4
                if whole:
                    yield row(k, np.frombuffer(content[:whole], dtype="<f4"), None)
                if whole < len(content):
                    yield row(k, np.zeros(0, dtype="<f4"), "SIGNAL_CORRUPT")


class Float32Blob(DataSource):
    """``spark.read.format("float32blob").load(path)``: (path, chunk_index, samples, code)."""

    @classmethod
    def name(cls) -> str:
        return "float32blob"

    def schema(self) -> str:
        return "path string, chunk_index bigint, samples array<float>, code string"

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options["path"], self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (EdfPlus, Float32Blob):
        spark.dataSource.register(source)


def write_edf(signals: DataFrame, path: str, *, mode: str = "append", scale: float = 1.0, impedance_scale: float = 1.0) -> None:
    """A file per study from (study_id, sample_rate, chunk_index, samples[, impedance]); a null study is left out.

    An impedance that is shorter than its chunk's ECG is filled with zeros, a longer one is cut.  A null or empty chunk adds
    nothing; a study of none has one silent record.
    """
    register(signals.sparkSession)
    columns = ["study_id", "sample_rate", "chunk_index", "samples", *(["impedance"] if "impedance" in signals.columns else [])]
    rows = signals.select(*columns).filter("study_id is not null").withColumn("samples", F.coalesce("samples", F.array().cast(signals.schema["samples"].dataType)))
    rows = sized(rows, "study_id").drop("first")  # chunks of a study are together and in order
    rows = rows.repartition("study_id").sortWithinPartitions("study_id", "chunk_index")
    rows.write.format("edfplus").mode(mode).option("scale", scale).option("impedanceScale", impedance_scale).save(path)
