"""Near copies by word-shingle similarity, found with SimHash fingerprints in BK-trees and verified exactly.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; a group of
near copies is a component of such links.

At a similarity of 0.8 the fingerprints differ in about 10 of 64 bits and hardly ever in more than ``RADIUS``.  No
blocks of 64 bits can shard for such a radius, so here a shard is named by a run of ``ROWS`` minima of permuted
shingle hashes: texts as similar as that share one of ``BANDS`` runs with a probability above 0.999.  The rest is as
in ``simhash``: BK-trees of fingerprints per shard, large shards cut into parts.  What they join are candidates; then
each candidate group is searched once more with its shingle sets at hand, and only pairs whose sets really are that
similar are linked.  Texts with equal sets are one node throughout, and a set moves once per candidate group part.

Defined cases: a null text counts as empty, and texts without words are copies of each other; fewer words than a
shingle make one shingle; of a group the row with the smallest id stays (null ids last; then the smallest text hash);
rows that repeat an id and a text are copies; an empty table gives an empty result; columns come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, maybe_broadcast, mixed, saved, slices, small, stretches, texts
from pulsegrid.llm.components import components
from pulsegrid.llm.simhash import link

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 21
BANDS, ROWS = 16, 4
#: Rows of a candidate group that are worked on together; each carries its shingle set.
GROUP_ROWS = 512


class Shingles:
    """Fingerprints, runs of minima and sets of texts."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.places = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
        self.factors = mixed(np.arange(100, 100 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)

    def sequence(self, text: bytes) -> np.ndarray:
        """Hashes of all shingles, repeats included."""
        h = np.concatenate([self._hashes(piece.lower().split()) for piece in stretches(text)])
        if not len(h):
            return h
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, np.uint64(min(len(h), SHINGLE)))
        for j in range(min(SHINGLE, len(h))):
            out += h[j : j + n] * self.places[j]
        return mixed(out)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > 300_000:
            self.words.clear()
        known = self.words
        h = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh64_intdigest(w)
            h[i] = x
        return h

    def set_of(self, text: bytes) -> np.ndarray:
        return np.unique(self.sequence(text))

    def node(self, own: np.ndarray) -> str:
        return xxhash.xxh3_128_hexdigest(own.tobytes())

    def fingerprint(self, own: np.ndarray) -> int:
        """Each distinct shingle votes once, so that similar sets have similar fingerprints however often a stretch is repeated."""
        votes = np.zeros(64, dtype=np.int64)
        for i in range(0, len(own), 1 << 14):
            votes += np.unpackbits(own[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        return int(np.packbits(votes * 2 > len(own), bitorder="little").view("<i8")[0])

    def bands(self, own: np.ndarray) -> list[int]:
        if not len(own):
            return [0] * BANDS
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(own), 4096):
            low = np.minimum(low, (own[None, i : i + 4096] * self.factors[:, None]).min(axis=1))
        return [xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63) for r in low.reshape(BANDS, ROWS)]


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, node, fp, bands)"""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for batch in batches:
            for part in slices(batch):
                nodes, fps, bands = [], [], []
                for t in texts(part):
                    own = made.set_of(t)
                    nodes.append(made.node(own))
                    fps.append(made.fingerprint(own))
                    bands.append(made.bands(own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "fp", "bands"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, node string, fp bigint, bands array<bigint>")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) and common > 0


def _verified(docs: DataFrame, candidates: DataFrame, text_col: str, id_col: str, similarity: float, radius: int) -> DataFrame:
    """candidates (node, root, fp, doc_id, text_hash) -> links (a, b) between nodes whose sets are similar."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    wanted = candidates.select("node", "root", "fp", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = own.join(maybe_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "root", "fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([made.set_of(t).tobytes() for t in texts(part)], pa.binary())], names=["id", "root", "fp", "own"])

    rows = rows.mapInArrow(sets, "id string, root string, fp bigint, own binary")
    test = lambda a, b: _similar(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), similarity)
    return link(rows, ["root"], radius=radius, shard_rows=GROUP_ROWS, payload="own", same=test)


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, node, group, keeper) for every row; the keeper of each group is one (doc_id, text_hash)."""
    prints = saved(_prints(docs, id_col, text_col))
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = saved(prints.groupBy("node").agg(F.min(first).alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    keys = nodes.select(F.col("node").alias("id"), "fp", F.posexplode("bands").alias("band", "run"))
    near = components(link(keys, ["band", "run"], radius=radius))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).distinct()
    candidates = saved(nodes.join(near, "node").select("node", "root", "fp", "first.doc_id", "first.text_hash"))
    groups = components(_verified(docs, candidates, text_col, id_col, similarity, radius))
    named = nodes.select("node", "first").join(groups, "node", "left").withColumn("group", F.coalesce("root", "node"))
    keepers = named.groupBy("group").agg(F.min("first").alias("keeper"))
    named = saved(named.select("node", "group").join(keepers, "group"))
    return prints.select("doc_id", "text_hash", "node").join(named, "node")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies; columns stay as they are."""
    marked = saved(near_copies(docs, id_col=id_col, text_col=text_col))
    goes = marked.filter(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))))
    own, gone, gone_hash = fresh(docs, "__own", "__id", "__hash")
    goes = goes.select(F.col("doc_id").alias(gone), F.col("text_hash").alias(gone_hash)).distinct()
    out = docs.withColumn(own, text_hash(text_col))
    out = out.join(maybe_broadcast(goes), F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(own) == F.col(gone_hash)), "left_anti")
    if not small(marked.groupBy("doc_id", "text_hash").count().filter("count > 1"), 0):
        out = out.dropDuplicates([id_col, own])  # the same id and text more than once
    return out.drop(own)
