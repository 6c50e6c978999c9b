"""Language-model scoring: an interpolated modified Kneser-Ney model of any order.

Counting runs in Spark, one shuffle per order.  A counting task turns its texts into packed runs of distinct n-grams
with their counts, dealt by the hash of each n-gram's context.  A shard of order k merges its runs, writes its part of
the model, and passes on its distinct n-grams without their first word: how often such a suffix is passed on is its
number of distinct left neighbours, which is what order k - 1 counts.  A run is dealt to ``FAN`` ranges of shards at most,
so that its rows do not grow with the number of shards: where there are more, ranges are merged into new runs and dealt
once more, inside their range.  The model is a folder of sorted hash arrays in
the shared folder, two files per order k > 1 and shard S, and one for words:

* ``gram-k-S``: hashes of n-grams, ascending, and their counts (below the highest order: distinct left neighbours);
* ``context-k-S``: hashes of contexts, with their total and their numbers of words seen once, twice, more often;
* ``word-S``: hashes of words, with their occurrences and their counts.

Workers memory-map these files and look up sorted keys, so that pages are shared by all workers of a machine and no
worker holds the model.  A shard is named by a range of hashes and has about ``shard_bytes`` of text, so there are as
many as the text needs.  Frequent contexts are found in a bounded sample first; their n-grams are dealt over all shards
by their own hash, and the few numbers of each such context are summed and kept in the model itself, so that no word,
however common, makes a task grow with the corpus.  The sample decides only where things lie.  Every shard has its files, if only empty
ones; one that is missing or short is an error, never an unknown word.  What reaches the driver is one row of sums.

Probability of w after the context h, with D1, D2, D3 from the counts of counts of each order (Chen and Goodman 1999):
(c(h,w) - D(c(h,w))) / c(h) + (D1 N1(h) + D2 N2(h) + D3 N3(h)) / c(h) * P(w | h without its first word), at the end
P(w) over words alone, falling back on 1 / (V + 1) for each word, known or not.  An unseen h leaves the shorter context.

Tokens: lower-cased (A-Z) words, then one end; what lies before a text is start marks, which are not scored.

Defined cases: a null text is empty and consists of its end; an empty training set gives V = N = 0 and every token
probability 1; repeated rows count each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import by_group, fold, mixed, saved, shared_path, shuffle_tasks, slices, table, texts

START, END = xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b"", 2)
ORDER = 3
#: The order that the registered query uses: see the README for what order 3 takes of the disk.
QUERY_ORDER = 2
#: Tokens that a counting task gathers before it packs a run.
RUN_TOKENS = 3_000_000
#: Bytes of text behind one shard of the model.
SHARD_BYTES = 16 << 20
#: Tasks of an order at most; beyond, a task works on several shards, one after the other.
TASKS = 20_000
#: Rows of a run at most; more shards than these are dealt to in two steps, beyond its square in three.
FAN = 2048
#: Sums per order: n-grams, their counts, counts of counts 1 to 4, occurrences.
SUMS = 7
ROWS = "shard int, vocabulary binary, ids binary, counts binary, occurrences binary, sums array<bigint>, hot binary"
#: Bytes of text in which frequent contexts are looked for, and the least share of the tokens that counts as frequent.
SAMPLE_BYTES, LEAST_SHARE = 32 << 20, 1e-4


class _Hashes(dict):
    """Word -> 64-bit hash, kept while small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def tokens(found: list[bytes], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in a row, tokens per text)."""
    words: list[bytes] = []
    sizes = np.empty(len(found), dtype=np.int64)
    for i, text in enumerate(found):
        own = text.lower().split()
        sizes[i] = len(own) + 1
        words += own
        words.append(b"")
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h[np.cumsum(sizes) - 1] = END
    return h, sizes


def history(h: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, oldest first; start marks before a text."""
    inside = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for back in range(order - 1, 0, -1):
        words = np.empty_like(h)
        words[back:], words[:back] = h[: len(h) - min(back, len(h))], START
        words[inside < back] = START
        out.append(words)
    return [*out, h]


def hashed(words: list[np.ndarray]) -> np.ndarray:
    """One hash per n-gram; that of a context extends to that of context and word."""
    h = words[0]
    for w in words[1:]:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hash values."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _merged(words: list[np.ndarray], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(words, summed values, contexts) of the distinct n-grams in order of the context's hash, then the n-gram's (words: by the word)."""
    key = hashed(words)
    order = np.argsort(key)
    at = _starts(key[order])
    first = order[at]
    sums = [np.add.reduceat(v[order], at) if len(at) else v for v in values]
    context = hashed(words[:-1])[first] if len(words) > 1 else key[first]
    again = np.argsort(context, kind="stable")
    return [w[first][again] for w in words], [s[again] for s in sums], context[again]


def _write(path: str, *arrays: np.ndarray) -> None:
    """One file: the length, then adjoining 8-byte arrays of it; put in place at once, so that a repeated task does no harm."""
    spare = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(spare, "wb") as f:
        f.write(np.array([len(arrays[0])], dtype="<u8").tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a, dtype="<u8").tobytes())
    os.replace(spare, path)


def _squeezed(a: np.ndarray) -> bytes:
    """Length and item size, then the array in the narrowest type, compressed."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    raw = a.astype(kind).tobytes()
    return np.array([len(a), kind.itemsize], dtype="<i8").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _spread(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], dtype="<i8").tolist()
    return np.frombuffer(pa.Codec("zstd").decompress(data[16:], n * width, asbytes=True), dtype=f"<u{width}") if n else np.empty(0, dtype=np.uint8)


def _rows(runs: list[tuple], sums: list[int] | None = None, shard: int = 0, hot: bytes | None = None) -> pa.RecordBatch:
    """Packed runs, and a row of sums, with the numbers of frequent contexts."""
    if sums is not None:
        runs = [*runs, (shard, None, None, None, None, sums, hot)]
    kinds = (pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.binary())
    columns = [*zip(*runs, strict=True)] if runs else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])


def _dealt(context: np.ndarray, gram: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """The shard of each n-gram: by its context, or by itself where the context is frequent."""
    return np.where(np.isin(context, hot), shard_of(mixed(gram), shards), shard_of(context, shards))


def widths(shards: int, fan: int = FAN) -> list[int]:
    """Shards in a range at each step of dealing, the last of one shard; no step makes more than ``fan`` ranges of one."""
    steps = 1
    while fan**steps < shards:
        steps += 1
    base = max(1, int(shards ** (1 / steps)))
    while base**steps < shards:
        base += 1
    return [base**i for i in reversed(range(steps))]


def _packed(words: list[np.ndarray], counts: np.ndarray, occurrences: np.ndarray, shards: int, hot: np.ndarray, width: int) -> list[tuple]:
    """Distinct n-grams dealt to ranges of ``width`` shards, named by their first; within a row, words are numbers of its own vocabulary."""
    words, (counts, occurrences), context = _merged(words, counts, occurrences)
    first = _dealt(context, hashed(words), shards, hot) // np.uint64(width)
    order = np.argsort(first, kind="stable")
    words, counts, occurrences, first = [w[order] for w in words], counts[order], occurrences[order], first[order]
    cut = [*_starts(first).tolist(), len(first)] if len(first) else []
    out = []
    for lo, hi in zip(cut, cut[1:], strict=False):
        vocabulary, ids = np.unique(np.concatenate([w[lo:hi] for w in words]), return_inverse=True)
        out.append((int(first[lo]) * width, vocabulary.astype("<u8").tobytes(), _squeezed(ids), _squeezed(counts[lo:hi]), _squeezed(occurrences[lo:hi]), None, None))
    return out


def _unpacked(t: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    words: list[list[np.ndarray]] = [[np.empty(0, dtype=np.uint64)] for _ in range(order)]
    counts, occurrences = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for vocabulary, ids, c, n in zip(*(t.column(x).to_pylist() for x in ("vocabulary", "ids", "counts", "occurrences")), strict=True):
        if vocabulary is not None:
            for w, own in zip(words, np.frombuffer(vocabulary, dtype="<u8")[_spread(ids)].reshape(order, -1), strict=True):
                w.append(own)
            counts.append(_spread(c).astype(np.int64))
            occurrences.append(_spread(n).astype(np.int64))
    return [np.concatenate(w) for w in words], np.concatenate(counts), np.concatenate(occurrences)


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from n1..n4, each kept within 0 and its count; 0.5, 1, 1.5 where counts of counts are missing."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    for i in range(3):
        d = i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] and n[1] else (i + 1) / 2
        out.append(min(max(d, 0.0), float(i + 1)))
    return out


@dataclass(frozen=True)
class Model:
    """``discounts``: D1, D2, D3+ of each order from 1; ``grams``: distinct n-grams of each order.

    ``hot``: of each order from 2, one row per frequent context, ascending: its hash, total, and words seen once, twice, more often.
    """

    folder: str
    shards: int
    order: int
    tokens: int
    vocabulary: int
    grams: tuple[int, ...]
    discounts: tuple[tuple[float, ...], ...]
    word_total: int
    word_rest: float
    hot: dict[int, np.ndarray]

    def frequent(self, k: int) -> np.ndarray:
        return self.hot[k][:, 0].view(np.uint64) if k in self.hot else np.empty(0, dtype=np.uint64)


def _dealt_again(level: DataFrame, k: int, shards: int, hot: np.ndarray, whole: int, width: int, run_tokens: int) -> DataFrame:
    """Packed runs of ranges of ``whole`` shards, merged and packed anew for ranges of ``width``; other rows as they are.

    A range is shared out over several tasks, so that a step has as many tasks as there are shards, up to ``TASKS``.  A task
    holds one run at a time.
    """
    ranges = -(-shards // whole)
    each = max(1, min(shards, TASKS) // ranges)
    tasks = min(ranges * each, TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, own = 0, None
        for batch in batches:
            kept = batch.filter(pc.is_null(batch.column("vocabulary")))
            if kept.num_rows:
                yield kept
            for row in (batch.slice(i, 1) for i in np.flatnonzero(pc.is_valid(batch.column("vocabulary")).to_numpy(zero_copy_only=False)).tolist()):
                at = row.column("shard")[0].as_py() // whole
                if held and (at != own or n >= run_tokens):
                    yield _rows(_packed(*_unpacked(pa.Table.from_batches(held), k), shards, hot, width))
                    held, n = [], 0
                own = at
                n += int(np.frombuffer(row.column("counts")[0].as_py()[:8], dtype="<i8")[0])
                held.append(row)
        if held:
            yield _rows(_packed(*_unpacked(pa.Table.from_batches(held), k), shards, hot, width))

    part = F.floor(F.col("shard") / F.lit(whole)).cast("bigint") * F.lit(each) + F.pmod(F.xxhash64("vocabulary", "ids"), F.lit(each))
    dealt = level.repartitionById(tasks, F.pmod(part, F.lit(tasks)).cast("int")).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, ROWS)


def _level(k: int, order: int, shards: int, folder: str, hot: dict[int, np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the shards of order k do, one after the other: write their part of the model and pass on what order k - 1 counts."""

    def one(t: pa.Table) -> pa.RecordBatch:
        os.makedirs(folder, exist_ok=True)
        s = t.column("shard")[0].as_py()
        words, (counts, occurrences), context = _merged(*_unpacked(t, k))
        gram = hashed(words)
        known_hot = [x for x in t.column("hot").to_pylist() if x]
        if k == 1:
            _write(f"{folder}/word-{s}", gram, occurrences, counts)
        else:
            by = np.argsort(gram)
            _write(f"{folder}/gram-{k}-{s}", gram[by], counts[by])
            start = _starts(context) if len(context) else np.empty(0, dtype=np.int64)
            sums = [np.add.reduceat(x, start, dtype=np.int64) if len(start) else start for x in (counts, counts == 1, counts == 2, counts >= 3)]
            frequent = np.isin(context[start], hot[k])
            _write(f"{folder}/context-{k}-{s}", context[start][~frequent], *[x[~frequent] for x in sums])
            known_hot.append(np.column_stack([np.full(frequent.sum(), k), context[start][frequent].view(np.int64), *[x[frequent] for x in sums]]).astype("<i8").tobytes())
        own = [len(gram), int(counts.sum()), *(int((counts == i).sum()) for i in range(1, 5)), int(occurrences.sum())]
        known = [x for x in t.column("sums").to_pylist() if x is not None]
        total = np.sum([[0] * (SUMS * order), *known], axis=0, dtype=np.int64)
        total[SUMS * (k - 1) : SUMS * k] += np.array(own, dtype=np.int64)
        passed = _packed(words[1:], np.ones(len(gram), dtype=np.int64), occurrences, shards, hot[k - 1], width) if k > 1 else []
        return _rows(passed, total.tolist(), s, b"".join(known_hot))

    return lambda batches: map(one, by_group(batches, ["shard"]))


def _frequent(rows: DataFrame, order: int, share: float, size: int, sample_bytes: int) -> dict[int, np.ndarray]:
    """Hashes of the contexts of each order that have ``share`` of the tokens or more in a sample: at most 1 / share of each."""
    out = {k: np.empty(0, dtype=np.uint64) for k in range(1, order + 1)}
    if order == 1:
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch):
                h, sizes = tokens(texts(part), hashes)
                words = history(h, sizes, order)
                found = [(1, 0, len(h))]
                for k in range(2, order + 1):
                    c, n = np.unique(hashed(words[-k:-1]), return_counts=True)
                    most = n >= share * len(h) / 4
                    found += zip([k] * int(most.sum()), c[most].view(np.int64).tolist(), n[most].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["k", "context", "n"])

    some = rows if size <= sample_bytes else rows.sample(sample_bytes / size, seed=7)
    counted = some.mapInArrow(count, "k int, context bigint, n bigint").groupBy("k", "context").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(int(order / share))
    found = counted.collect()
    total = max((r["n"] for r in found if r["k"] == 1), default=0)
    for k in range(2, order + 1):
        out[k] = np.sort(np.array([r["context"] for r in found if r["k"] == k and r["n"] >= share * total], dtype=np.int64).view(np.uint64))
    return out


def train(docs: DataFrame, *, text_col: str = "text", order: int = ORDER, run_tokens: int = RUN_TOKENS, shard_bytes: int = SHARD_BYTES, sample_bytes: int = SAMPLE_BYTES, least_share: float = LEAST_SHARE, fan: int = FAN) -> Model:
    """Count all texts of ``docs`` and write the model into the shared folder; it goes when the application ends."""
    spark = docs.sparkSession
    folder = shared_path(spark, "ngrams")
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(shuffle_tasks(spark), -(-size // shard_bytes))
    steps = widths(shards, fan)
    hot = _frequent(rows, order, max(0.25 / shards, least_share), size, sample_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def packed() -> pa.RecordBatch:
            h, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            one = np.ones(len(h), dtype=np.int64)
            return _rows(_packed(history(h, sizes, order), one, one, shards, hot[order], steps[0]))

        for batch in batches:
            for part in slices(batch):
                held.append(tokens(texts(part), hashes))
                n += len(held[-1][0])
                if n >= run_tokens:
                    yield packed()
                    n = 0
        if held:
            yield packed()

    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ROWS.split(", ")[1:]])
    level = rows.mapInArrow(count, ROWS)
    for k in range(order, 0, -1):
        for whole, width in zip(steps, steps[1:], strict=False):
            level = _dealt_again(level, k, shards, hot[k], whole, width, run_tokens)
        if k == order:
            level = level.unionByName(every)
        # Shards are dealt out by number, so that every task has as many as any other.
        dealt = level.repartitionById(min(shards, TASKS), F.col("shard") % F.lit(min(shards, TASKS))).sortWithinPartitions("shard")
        level = dealt.mapInArrow(_level(k, order, shards, folder, hot, steps[0]), ROWS)
    level = saved(level.select("sums", "hot").filter("sums is not null"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(b or b"" for b in batch.column(0).to_pylist()), dtype="<i8").reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T.copy()], names=list("kctabm"))

    parts = level.select("hot").mapInArrow(spread, "k bigint, c bigint, t bigint, a bigint, b bigint, m bigint")
    numbers = parts.groupBy("k", "c").agg(*[F.sum(x).alias(x) for x in "tabm"]).collect()  # at most 1 / share rows of each order
    kept = {}
    for k in range(2, order + 1):
        own = np.array([[r[x] for x in "ctabm"] for r in numbers if r["k"] == k], dtype=np.int64).reshape(-1, 5)
        # a sampled context that no training text has keeps a row of zeros: it is unseen
        gone = np.setdiff1d(hot[k].view(np.int64), own[:, 0])
        own = np.concatenate((own, np.column_stack([gone, *[np.zeros_like(gone)] * 4])))
        kept[k] = own[np.argsort(own[:, 0].view(np.uint64))]
    last = level.groupBy().agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(SUMS * order)]).first()
    sums = np.array(last, dtype=np.int64).reshape(order, SUMS)
    d = tuple(tuple(discounts(x[2:6].tolist())) for x in sums)
    grams, total, n1, n2 = sums[0, :4].tolist()
    rest = (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * (grams - n1 - n2)) / total if total else 1.0
    return Model(folder, shards, order, int(sums[0, 6]), grams, tuple(sums[:, 0].tolist()), d, total, rest, kept)


@lru_cache(maxsize=3000)
def _mapped(path: str, columns: int) -> list[np.ndarray]:
    """The arrays of one file; raises where it is missing or not of the length that it names."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} of the language model is gone: is the shared folder mounted on every executor?")
    size = os.path.getsize(path)
    n = int(np.fromfile(path, dtype="<u8", count=1)[0]) if size >= 8 else -1
    if size != 8 * (1 + n * columns):
        raise OSError(f"{path} of the language model is damaged: {size} bytes for {n} entries")
    every = np.memmap(path, dtype="<u8", mode="r", offset=8, shape=(columns, n)) if n else np.empty((columns, 0), dtype="<u8")
    return list(every)


def _look_up(model: Model, what: str, keys: np.ndarray, shard: np.ndarray, columns: int) -> list[np.ndarray]:
    """Values of ascending (shard, key) pairs; 0 where a key is not there."""
    out = [np.zeros(len(keys), dtype=np.float64) for _ in range(columns - 1)]
    cut = np.searchsorted(shard, np.arange(model.shards + 1))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        lo, hi = cut[s], cut[s + 1]
        own, *values = _mapped(f"{model.folder}/{what}-{s}", columns)
        if not len(own):
            continue
        at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
        there = own[at] == keys[lo:hi]
        for o, v in zip(out, values, strict=True):
            o[lo:hi] = np.where(there, v[at], 0)
    return out


def _discount(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def token_scores(model: Model, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count of the word, its base log10 probability, its model log10 probability) of each token."""
    if not model.tokens:
        zero = np.zeros(len(h))
        return zero, zero, zero
    w, back = np.unique(h, return_inverse=True)
    n, c = _look_up(model, "word", w, shard_of(w, model.shards), 3)
    base = np.log10((n + 1) / (model.tokens + model.vocabulary + 1))
    p = (c - _discount(c, model.discounts[0])) / model.word_total + model.word_rest / (model.vocabulary + 1)
    n, base, p = n[back], base[back], p[back]
    words = history(h, sizes, model.order)
    for k in range(2, model.order + 1):
        before = hashed(words[-k:-1])
        b, back = np.unique(before, return_inverse=True)
        numbers = _look_up(model, f"context-{k}", b, shard_of(b, model.shards), 5)
        hot = model.frequent(k)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, b), len(hot) - 1)
            numbers = [np.where(hot[at] == b, model.hot[k][at, i + 1], x) for i, x in enumerate(numbers)]
        total, one, two, more = (x[back] for x in numbers)
        gram = hashed(words[-k:])
        shard = _dealt(before, gram, model.shards, hot)
        order = np.lexsort((gram, shard))
        c = np.empty(len(h))
        (c[order],) = _look_up(model, f"gram-{k}", gram[order], shard[order], 2)
        d = model.discounts[k - 1]
        known = np.maximum(total, 1)
        weight = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / known, 1.0)
        p = np.where(total > 0, (c - _discount(c, d)) / known, 0.0) + weight * p
    return n, base, np.log10(p)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, most=3 << 20):
                h, sizes = tokens(texts(part), hashes)
                n, base, own = token_scores(model, h, sizes)
                start = np.cumsum(sizes) - sizes
                total = np.add.reduceat(own, start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(np.add.reduceat((n > 0).astype(np.int64), start)), pa.array(np.add.reduceat(base, start)), pa.array(total), pa.array(10.0 ** (-total / sizes))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held: Column = fold(parts=7) == 2
    model = train(docs.filter(~held), order=QUERY_ORDER)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


QUERIES = {"op5_kneser_ney": op5_kneser_ney}
SQL: dict[str, str] = {}
