"""Periodic runs: every stretch of words that repeats with some period, by the longest-previous-factor array.

The texts of a slice stand one after the other, words as numbers that differ between texts, so that nothing is found
across two texts.  Prefix doubling gives the suffix array and, on the way, names of all stretches of 1, 2, 4 ... words
(``Factors``); neighbours in the suffix array give the LCP array; the nearest suffixes on either side that begin further
left give the longest previous factor of each position (LPF) and where it stood.  Following LPF from the left cuts a
text into LZ blocks.  A run that touches a border of blocks is found by extending to both sides of it (Main): for every
period that the two blocks beside the border allow, so that all borders together try three periods a word.  A run inside
a block has stood in the block's earlier occurrence, and is copied from there: runs are kept in order of their start.
A stretch found with several periods is named by the smallest.

A task holds one slice of texts at a time.  A single text is worked on whole, as its suffix array needs; that takes about
250 bytes a word, besides the text.

Defined cases: a null text has no words, as the empty one; words are runs of characters other than space, tab, LF, VT, FF
and CR; ties do not matter; repeated rows are answered alike; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, id_text, mixed, slices, table

#: A run has so many words at least.
LEAST = 12
#: Names are kept of stretches of up to 2 ** (LEVELS - 1) words; longer ones are compared in steps of that.
LEVELS = 13
#: Pairs of a border and a period that are tried at once.
PAIRS = 1 << 20
#: Rounds of pointer jumping before what is left is done one by one.
JUMPS = 64


class Factors:
    """Suffix array and named stretches of sequences of numbers: sequence d is ``words[at[d]:at[d + 1]]``."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        n = self.n = len(words)
        self.at = at
        sequence = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
        end = at[1:][sequence] if n else np.zeros(0, dtype=np.int64)
        where = np.arange(n, dtype=np.int64)
        # Random order of the words: that of first appearance would make long monotone stretches of the suffix array.
        names = mixed(np.arange(int(words.max()) + 1 if n else 0)).argsort().argsort().astype(np.int64)
        rank, _ = self._renamed(np.zeros(n, dtype=np.int64), (sequence << 32) | names[words], where)
        self.levels = [self._padded(rank)]
        self.group = rank
        size = np.bincount(rank, minlength=n + 1)
        left, k = where[size[rank] > 1], 1
        while len(left):
            after = left + k
            inside = after < end[left]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            new, alone = self._renamed(rank[left], second, left)
            rank = rank.copy()
            rank[left] = new
            left, k = left[~alone], 2 * k
            if len(self.levels) < LEVELS:
                self.levels.append(self._padded(rank))
        self.rank = rank
        self.suffixes = np.empty(n, dtype=np.int64)
        self.suffixes[rank] = where

    def _padded(self, rank: np.ndarray) -> np.ndarray:
        return np.concatenate([rank, [-1, -2]]).astype(np.int32 if self.n < 1 << 31 else np.int64)  # [n] and [n + 1] equal nothing

    @staticmethod
    def _renamed(first: np.ndarray, second: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks after sorting by (first, second), where all that share a first are given: first, plus those below in the same first.  And whether each is alone."""
        n = len(where)
        if not n:
            return first, np.zeros(0, dtype=bool)
        order = np.lexsort((second, first)) if len(second) and int(second.max()) >= 1 << 31 and first.any() else np.argsort((first << 32) + second if first.any() else second)
        a, b = first[order], second[order]
        group, fresh = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        group[1:] = a[1:] != a[:-1]
        fresh[1:] = group[1:] | (b[1:] != b[:-1])
        spot = np.arange(n)
        new = a + np.maximum.accumulate(np.where(fresh, spot, 0)) - np.maximum.accumulate(np.where(group, spot, 0))
        last = np.ones(n, dtype=bool)
        last[:-1] = fresh[1:]
        out, alone = np.empty(n, dtype=np.int64), np.empty(n, dtype=bool)
        out[order], alone[order] = new, fresh & last
        return out, alone

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words are equal from i and j on or, with ``back``, before i and j; i and j in one sequence, i != j."""
        out = np.zeros(len(i), dtype=np.int64)
        top = len(self.levels) - 1

        def same(t: int, live: np.ndarray) -> np.ndarray:
            step, name = 1 << t, self.levels[t]
            if back:
                a, b = i[live] - out[live] - step, j[live] - out[live] - step
                return name[np.where(a < 0, self.n, a)] == name[np.where(b < 0, self.n + 1, b)]
            return name[i[live] + out[live]] == name[j[live] + out[live]]

        live, failed = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
        for t in range(top + 1):
            while len(live):
                equal = same(t, live)
                failed[live[~equal]] = t
                live = live[equal]
                out[live] += 1 << t
                if t < top:
                    break
        for t in range(top - 1, -1, -1):
            live = np.flatnonzero(failed > t)
            out[live[same(t, live)]] += 1 << t
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, start) of each position's longest previous factor; 0 and -1 where its word is new."""
        n, sa = self.n, self.suffixes
        lcp = np.zeros(n + 1, dtype=np.int64)  # of suffixes r - 1 and r; 0 at both ends
        pairs = np.flatnonzero(self.group[sa[1:]] == self.group[sa[:-1]]) + 1
        lcp[pairs] = self.common(sa[pairs - 1], sa[pairs])
        length, start = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        for step in (-1, 1):
            reach = lcp[:n].copy() if step < 0 else lcp[1:].copy()
            to = np.where(reach > 0, np.arange(n) + step, -1)
            live = np.flatnonzero(to >= 0)
            live = live[sa[to[live]] > sa[live]]
            for _ in range(JUMPS):
                if not len(live):
                    break
                over = to[live]
                reach[live], to[live] = np.where(to[over] < 0, 0, np.minimum(reach[live], reach[over])), to[over]
                live = live[to[live] >= 0]
                live = live[sa[to[live]] > sa[live]]
            for r in live[::-step].tolist():  # what these pass over is settled before they are
                while to[r] >= 0 and sa[to[r]] > sa[r]:
                    over = to[r]
                    reach[r], to[r] = (min(reach[r], reach[over]) if to[over] >= 0 else 0), to[over]
            better = reach > length[sa]
            length[sa[better]], start[sa[better]] = reach[better], sa[to[better]]
        return length, start


def _spread(of: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(border, period) for each border and every period from 1 to its most, in batches."""
    total = np.cumsum(most)
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        part = most[at:to]
        up = np.cumsum(part)
        yield np.repeat(of[at:to], part), np.arange(int(up[-1])) - np.repeat(up - part, part) + 1
        at = to


def find_runs(words: np.ndarray, at: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (sequence, start, length, period) of all runs, by sequence, start and period; starts count from the sequence's own.

    A run is a stretch with smallest period q and at least max(least, 2 q) words, which no neighbouring word extends.
    """
    words, at = np.asarray(words), np.asarray(at, dtype=np.int64)
    none = np.zeros((0, 4), dtype=np.int64)
    if not len(words):
        return none
    f = Factors(words, at)
    length, source = f.previous()
    steps, starts, i = np.maximum(length, 1).tolist(), [], 0
    while i < f.n:  # a previous factor ends with its sequence, and so does the last block
        starts.append(i)
        i += steps[i]
    block = np.array(starts, dtype=np.int64)
    size = np.diff(block, append=f.n)
    sequence = np.searchsorted(at, block, side="right") - 1
    first = block == at[sequence]
    before = np.where(first, 0, np.concatenate([[0], size[:-1]]))
    # Equal words beside the border: so many at least on its left and right together, so half on one of them.
    half = max(1, (least + 3) // 4)
    level = min(len(f.levels) - 1, half.bit_length() - 1)
    step, name = 1 << level, f.levels[level]
    found = [none[:, :3]]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        """Runs in which the words from a and from b on are a period apart, a < b, one of them the border."""
        near = name[a] == name[b]
        near |= name[np.where(a < step, f.n, a - step)] == name[np.where(b < step, f.n + 1, b - step)]
        a, b = a[near], b[near]
        ahead, back = f.common(a, b), f.common(a, b, back=True)
        ok = ahead + back >= np.maximum(b - a, least - (b - a))
        found.append(np.stack([(a - back)[ok], (b + ahead)[ok], (b - a)[ok]], axis=1))

    for border, q in _spread(block, size):  # a whole period on the right
        inside = border + q < f.n
        keep(border[inside], (border + q)[inside])
    # A whole period on the left: at each block's start, and at the end of each sequence's last block.
    closing = np.flatnonzero(np.append(sequence[1:] != sequence[:-1], True))
    border = np.concatenate([block[~first], block[closing] + size[closing]])
    most = np.concatenate([(before + size - 1)[~first], size[closing]])
    most = np.minimum(most, border - at[np.concatenate([sequence[~first], sequence[closing]])])
    for b, q in _spread(border[most > 0], most[most > 0]):
        keep(b - q, b)
    every = np.concatenate(found)
    if not len(every):
        return none
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[new]  # the smallest period of each stretch
    every = _copied(every, at, block, size, source, sequence, least)
    owner = np.searchsorted(at, every[:, 0], side="right") - 1
    return np.stack([owner, every[:, 0] - at[owner], every[:, 1] - every[:, 0], every[:, 2]], axis=1)


def _copied(runs: np.ndarray, at: np.ndarray, block: np.ndarray, size: np.ndarray, source: np.ndarray, sequence: np.ndarray, least: int) -> np.ndarray:
    """Add the runs inside of blocks, from the blocks' earlier occurrences, left to right."""
    has = np.zeros(len(at) - 1, dtype=bool)
    has[np.searchsorted(at, runs[:, 0], side="right") - 1] = True
    long = np.flatnonzero(has[sequence] & (size >= least + 2) & (source[block] >= 0))
    if not len(long):
        return runs
    kept: dict[int, list[tuple[int, int, int]]] = {}
    for d, row in zip((np.searchsorted(at, runs[:, 0], side="right") - 1).tolist(), map(tuple, runs.tolist()), strict=True):
        kept.setdefault(d, []).append(row)
    known = set(map(tuple, runs.tolist()))
    for d, b, n, s in zip(sequence[long].tolist(), block[long].tolist(), size[long].tolist(), source[block[long]].tolist(), strict=True):
        own = kept[d]
        k = bisect_right(own, (s, 1 << 62, 0))
        while k < len(own) and own[k][0] < s + n:
            start, end, q = own[k]
            copy = (start + b - s, end + b - s, q)
            if end < s + n and copy not in known:
                known.add(copy)
                insort(own, copy)  # behind k, as it starts later
            k += 1
    return np.array([row for d in sorted(kept) for row in kept[d]], dtype=np.int64).reshape(-1, 3)


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each text.

    ``runs`` has (start, length, period) in words, by start and period; ``collapsed`` is the text without the words that
    a run contains after its first period, the rest joined by one space.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                split = pc.ascii_split_whitespace(pc.fill_null(part.column(1).cast(pa.string()), ""))
                ends, values = split.offsets.to_numpy(), split.values
                solid = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(solid)])[ends].astype(np.int64)
                at -= at[0]
                words = values.filter(pa.array(solid)).slice(int(np.count_nonzero(solid[: ends[0]])), int(at[-1]))
                codes = words.dictionary_encode()
                found = find_runs(codes.indices.to_numpy().astype(np.int64), at, least)
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                start = at[found[:, 0]] + found[:, 1]
                np.add.at(mark, start + found[:, 3], 1)
                np.add.at(mark, start + found[:, 2], -1)
                stays = np.cumsum(mark[:-1]) == 0
                if not stays.all():
                    words = words.filter(pa.array(stays))
                left = np.concatenate([[0], np.cumsum(stays)])[at]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words), " ")
                of = np.searchsorted(found[:, 0], np.arange(len(at)))
                listed = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), listed), joined], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _planted(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its end made periodic: from word a on, word i is word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("binary"))
    g = F.floor(h / 10)

    def periodic_end(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.element_at(words, a + (i - a) % p + 1)).otherwise(w)), " ")

    # An array of one, so that the words are found once, not anew for each of them.
    once = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda words: F.when(F.size(words) > 0, periodic_end(words)))
    return F.when(h % 10 == 0, F.coalesce(F.element_at(once, 1), text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = periodic_runs(docs.select("doc_id", _planted(id_text(), F.col("text")).alias("text")))
    # The greatest: by length, then the smallest start and period.
    better = lambda x, y: F.struct(-y["length"], y["start"], y["period"]) < F.struct(-x["length"], x["start"], x["period"])
    best = F.reduce("runs", F.element_at("runs", 1), lambda x, y: F.when(better(x, y), y).otherwise(x))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
