"""Benchmark decontamination by SimHash over item-sized windows.

For a benchmark item of n words, every window of n words of every document is compared with it: the window's SimHash
is looked up in a multi-index of the items' SimHashes of that size, whose blocks guarantee that all fingerprints
within the radius are found, and candidates are verified by the exact weighted similarity of their word shingles
(sum of minima over sum of maxima of their counts), 0.8 or more on five-word shingles.

A similarity of 0.8 between two windows of m shingles each needs 8/9 of m shingles in common.  So a window in which
fewer shingles than that belong to any item at all cannot match and gets no fingerprint; this loses nothing.  At a
similarity of 0.8 about 10 of 64 bits differ; the radius of 23 is more than four standard deviations above.

Words: lower-cased, ASCII punctuation separates.  An item of fewer than five words is one shingle of all its words.
Items are taken in blocks of at most ``block_items``, each sent to the workers whole; documents of any number are
scanned once per block and are never shuffled.

Defined cases: null and wordless texts match nothing, null or wordless items are ignored; equal items each get their
own rows; of equally similar windows the first counts; repeated documents are answered alike; an empty table on
either side gives no leak; further columns are ignored (by the search) or unchanged (by the filter).
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrid.llm.common import mixed, slices, stretches, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
#: Items held by a worker at once.
BLOCK_ITEMS = 20_000
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_PLACES = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    """Word -> 64-bit hash, kept while small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return _split(_lowered(text))


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _split(lowered: bytes) -> list[bytes]:
    return lowered.translate(_PUNCTUATION).split()


def _shingles(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of each stretch of ``size`` words."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += tokens[j : j + n] * _PLACES[j]
    return mixed(out)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(votes: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(votes * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


class _Size:
    """All items of one number of words: fingerprints, and for each block of bits the items near each of its values."""

    def __init__(self, n: int, members: list[int], shingles: list[np.ndarray]):
        self.n, self.size = n, min(SHINGLE, n)
        self.m = n - self.size + 1
        self.members = members
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.prints = np.concatenate([_packed(_bits(s).sum(axis=0, dtype=np.int64)[None, :], self.m) for s in shingles])
        reach = RADIUS // BLOCKS
        values = np.arange(256, dtype=np.uint64)
        near = []
        for b in range(BLOCKS):
            own = (self.prints >> np.uint64(8 * b)) & np.uint64(255)
            near.append(np.bitwise_count(values[:, None] ^ own[None, :]) <= reach)
        self.near = near
        # least common shingles I with I / (2m - I) >= SIMILARITY
        self.need = int(np.ceil(2 * self.m * SIMILARITY / (1 + SIMILARITY) - 1e-9))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, member) pairs within the radius."""
        found = np.zeros((len(prints), len(self.prints)), dtype=bool)
        for b, near in enumerate(self.near):
            found |= near[((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
        w, i = np.nonzero(found)
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]


class Index:
    def __init__(self, items: list[tuple[object, str]]):
        self.items = items
        self.ids = [i for i, _ in items]
        self.hashes = _Hashes()
        by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for at, (_, text) in enumerate(items):
            tokens = self.tokens(words(text))
            if len(tokens):
                members, shingles = by_size.setdefault(len(tokens), ([], []))
                members.append(at)
                shingles.append(_shingles(tokens, min(SHINGLE, len(tokens))))
        self.sizes = [_Size(n, *by_size[n]) for n in sorted(by_size)]
        self.known: dict[int, np.ndarray] = {}
        self.spots: dict[int, np.ndarray] = {}
        for size in sorted({s.size for s in self.sizes}):
            known = np.unique(np.concatenate([np.fromiter(c, np.uint64, len(c)) for s in self.sizes if s.size == size for c in s.counts]))
            spots = np.zeros(1 << 22, dtype=bool)
            spots[(known >> np.uint64(42)).astype(np.int64)] = True
            self.known[size], self.spots[size] = known, spots

    def __reduce__(self):
        return Index, (self.items,)

    def tokens(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))

    def tokens_of(self, text: str | None) -> np.ndarray:
        """Hashes of a text's words, split a stretch at a time."""
        return np.concatenate([self.tokens(_split(piece)) for piece in stretches(_lowered(text))])

    def search(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item) -> (best similarity, first word of the window)."""
        per_text = [self.tokens_of(t) for t in texts]
        sizes = np.array([len(w) for w in per_text], dtype=np.int64)
        tokens = np.concatenate([np.empty(0, dtype=np.uint64), *per_text])
        ends = np.cumsum(sizes)
        out: dict[tuple[int, int], tuple[float, int]] = {}
        for size, known in self.known.items():
            h = _shingles(tokens, size)
            if not len(h):
                continue
            hit = self.spots[size].take((h >> np.uint64(42)).astype(np.int64))
            maybe = np.flatnonzero(hit)
            spot = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            maybe = maybe[known[spot] == h[maybe]]
            if not len(maybe):
                continue
            # A shingle across two documents belongs to neither.
            maybe = maybe[np.searchsorted(ends, maybe, side="right") == np.searchsorted(ends, maybe + size - 1, side="right")]
            docs = np.searchsorted(ends, maybe, side="right")
            for d in np.unique(docs):
                at = maybe[docs == d] - (ends[d] - sizes[d])
                self._document(int(d), h[ends[d] - sizes[d] : max(ends[d] - size + 1, 0)], at, size, out)
        return out

    def _document(self, d: int, h: np.ndarray, at: np.ndarray, size: int, out: dict[tuple[int, int], tuple[float, int]]) -> None:
        hits = np.zeros(len(h) + 1, dtype=np.int32)
        hits[at + 1] = 1
        hits = np.cumsum(hits)
        for s in self.sizes:
            if s.size != size or len(at) < s.need or len(h) < s.m:
                continue
            starts = np.flatnonzero(hits[s.m :] - hits[: len(hits) - s.m] >= s.need)
            if not len(starts):
                continue
            for lo in range(0, len(starts), 512):
                some = starts[lo : lo + 512]
                stretch = h[some[0] : some[-1] + s.m]
                if len(stretch) <= 4 * (len(some) + s.m):
                    sums = np.concatenate((np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits(stretch), axis=0, dtype=np.int32)))
                    votes = sums[some - some[0] + s.m] - sums[some - some[0]]
                else:
                    votes = np.stack([_bits(h[i : i + s.m]).sum(axis=0, dtype=np.int32) for i in some])
                for w, i in zip(*s.candidates(_packed(votes, s.m)), strict=True):
                    start = int(some[w])
                    window, item = Counter(h[start : start + s.m].tolist()), s.counts[i]
                    common = sum(min(c, item[x]) for x, c in window.items() if x in item)
                    score = common / (2 * s.m - common)
                    key = (d, s.members[i])
                    if score >= SIMILARITY and score > out.get(key, (0.0, 0))[0]:
                        out[key] = (score, start)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[Index]:
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    parts = max(1, -(-rows.count() // block_items))
    for p in range(parts):
        yield Index([(r[0], r[1]) for r in sorted(rows.filter(F.pmod(F.xxhash64("text", "id"), F.lit(parts)) == p).collect(), key=lambda r: (r[0] is None, r[0], r[1]))])


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): each document and item that a window of the document matches."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for index in _blocks(benchmark, item_col, "text", block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = sorted(shared.value.search(part.column(1).to_pylist()).items())
                    take = pa.array([d for (d, _), _ in found], pa.int64())
                    ids = [shared.value.ids[i] for (_, i), _ in found]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(ids, item_type), pa.array([s for _, (s, _) in found], pa.float64()), pa.array([w for _, (_, w) in found], pa.int64())], names=["doc_id", "item_id", "similarity", "start_word"])

        one = rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start_word bigint")
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents in which no benchmark item is found; columns stay as they are."""
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, "text", block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, dtype=bool)
                    for d, _ in shared.value.search(part.column(at).to_pylist()):
                        keep[d] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
SQL: dict[str, str] = {}
