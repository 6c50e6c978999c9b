"""Helpers shared by the training-data operators: sessions, shared storage, bounded joins, byte-level text."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.shipping import ship as ship

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: ``bytes.translate`` table that lower-cases A-Z and nothing else.
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: A side joined by broadcast has at most this many rows of bounded width; larger sides are shuffled.
BROADCAST_ROWS = 50_000


def shared_uri(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (local mode only)."""
    uri = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not uri:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(uri)
    return uri


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder, as a path every executor can map (POSIX mounts only)."""
    uri = urlparse(_scratch(spark))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"{what} files are memory-mapped: mount {uri.geturl()} and name the mount in spark.checkpoint.dir")
    return f"{unquote(uri.path)}/{what}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    context = spark.sparkContext
    folder = getattr(context, "_pulsegrid_scratch", None)
    if folder is None:
        folder = f"{shared_uri(spark).rstrip('/')}/pulsegrid-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        context._pulsegrid_scratch = folder
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the application's own."""
    return f"{_scratch(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder; survives the loss of any executor.

    Unlike a checkpoint, a table has its real size: the estimates that a checkpoint keeps multiply with every join, and
    grow out of all bounds in a loop.
    """
    path = f"{_scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(col: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id's text modulo ``parts``."""
    return F.crc32(id_text(col).cast("binary")) % F.lit(parts)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side is proven to have at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast behind a check of the size; otherwise leave the join to shuffles and AQE's skew splitting."""
    return F.broadcast(df) if small(df, rows) else df


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch at about ``most`` bytes of text (a longer single text stays whole)."""
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    col = col.cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < len(col):
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(col))
        yield batch.slice(at, to - at)
        at = to


def stretches(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """Cut a text at blanks into pieces of about ``most`` bytes, so that a very long one is never split into words at once.

    A word stays whole, however long; the pieces put together are the text.
    """
    at = 0
    while len(text) - at > most:
        to = max(text.rfind(b, at + 1, at + most) for b in BLANKS)
        if to < 0:
            to = min((x for b in BLANKS if (x := text.find(b, at + most)) >= 0), default=-1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def by_group(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by group; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        new = np.zeros(t.num_rows, dtype=bool)
        for g in group:
            c = t.column(g).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(starts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
