"""Toxicity by subword-bag embeddings.

A text is the bag of its character n-grams (3 to 7 bytes inside a word, its edges included), each hashed to a row of
an embedding table; the mean of the rows goes through a linear softmax.  Table and softmax are trained jointly, in
numpy, so that a misspelling never seen shares the vectors of its n-grams.  For scoring, table and softmax collapse
into one number per hashed n-gram, which is all that workers get.

Samples: up to ``toxic_docs`` toxic and ``clean_docs`` clean labelled documents of the training fold, of at most
``sample_chars`` characters each, in hash order of their ids; the bounds are parameters and do not grow with the corpus.
Classes are weighted back to their shares among the labelled rows.  Every whole text is scored.

Defined cases: a null text is empty; a text without n-grams gets the score of the bias alone; without labels of both
classes every score is the share of toxic labels (0 if there is none); null labels are not used; repeated label rows
count once, ids labelled both ways not at all; of an id with several texts the smallest is learned from; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fold, slices, stretches, table, texts
from pulsegrid.llm.labelled import agreed, sample_ids, with_texts

BUCKETS = 1 << 18
WIDTH = 8
SIZES = (3, 4, 5, 6, 7)
#: Means over thousands of n-grams are small numbers; this brings them to the order of one.
GAIN = 64.0
THRESHOLD = 0.5
_EDGES = bytes.maketrans(b"\t\n\x0b\x0c\r" + string.punctuation.encode(), b" " * (5 + len(string.punctuation)))


def ngrams(found: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (hashed n-grams of all texts in a row, where each text's end)."""
    raw = [b" " + t.lower().translate(_EDGES) + b" " for t in found]
    b = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    spaces = np.zeros(len(b) + 1, dtype=np.int32)
    np.cumsum(b == 0x20, out=spaces[1:])
    wide = b.astype(np.uint32)
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            yield np.empty(0, dtype=np.uint32), np.zeros(len(found), dtype=np.int64)
            continue
        # No blank inside; two texts meet in two blanks, so nothing crosses them.
        at = np.flatnonzero(spaces[n - 1 : m + n - 1] == spaces[1 : m + 1])
        h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            h ^= wide[at + j]
            h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield h >> np.uint32(14), np.searchsorted(at, ends)


def _groups(found: list[bytes], most: int = 4 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in stretches, about ``most`` bytes together, each with its text's number: no n-gram crosses a blank."""
    owners: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for d, text in enumerate(found):
        for piece in stretches(text):
            if pieces and size + len(piece) > most:
                yield owners, pieces
                owners, pieces, size = [], [], 0
            owners.append(d)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield owners, pieces


class Bag:
    """One number per hashed n-gram, and a bias: the log odds of toxic."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, found: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(found)), np.zeros(len(found), dtype=np.int64)
        for owners, pieces in _groups(found):
            for ids, ends in ngrams(pieces):
                sums = np.concatenate(([0.0], np.cumsum(self.weights.take(ids), dtype=np.float64)))[ends]
                np.add.at(total, owners, np.diff(sums, prepend=0.0))
                np.add.at(count, owners, np.diff(ends, prepend=0))
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


class _Batch:
    """The n-grams of some texts, in the order of the texts and in the order of the n-grams.

    Eight bytes an n-gram are kept, its weight and its place among the sorted; the rest follows from these at each step.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(ids) for ids, _ in rows])
        self.docs = len(rows)
        self.some = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.some]
        self.x = np.concatenate([x for _, x in rows])
        ids = np.concatenate([ids for ids, _ in rows])
        self.order = np.argsort(ids, kind="stable").astype(np.int32)
        self.active, begins = np.unique(ids[self.order], return_index=True)
        self.begins = begins.astype(np.int32)

    @property
    def place(self) -> np.ndarray:
        """The active n-gram of each, in the order of the texts."""
        out = np.empty(len(self.order), dtype=np.int32)
        out[self.order] = np.repeat(np.arange(len(self.active), dtype=np.int32), np.diff(self.begins, append=len(out)))
        return out

    @property
    def doc(self) -> np.ndarray:
        """The text of each, in the order of the n-grams."""
        return np.repeat(np.arange(self.docs, dtype=np.int32), self.sizes)[self.order]

    def means(self, table: np.ndarray) -> np.ndarray:
        """[text, width] weighted sums of the rows of the active n-grams."""
        out = np.zeros((self.docs, table.shape[1]), dtype=table.dtype)
        if len(self.some):
            out[self.some] = np.add.reduceat(table[self.place] * self.x[:, None], self.starts, axis=0)
        return out

    def back(self, inner: np.ndarray) -> np.ndarray:
        """[active n-gram, width]: what a gradient at the means is at the rows."""
        if not len(self.active):
            return np.zeros((0, inner.shape[1]), dtype=inner.dtype)
        return np.add.reduceat(inner[self.doc] * self.x[self.order][:, None], self.begins, axis=0)


def gradients(batch: _Batch, y: np.ndarray, scale: np.ndarray, table: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weighted cross-entropy of a batch, and its gradients by the active rows, the softmax and the bias."""
    mean = batch.means(table)
    z = mean @ softmax + bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1, keepdims=True)
    loss = float((scale * (np.log(total[:, 0]) - (z * y).sum(axis=1))).sum() / len(y))
    d = (p / total - y) * scale[:, None] / len(y)
    return loss, (batch.back(d @ softmax.T), mean.T @ d, d.sum(axis=0))


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's hashed n-grams, sorted, and how often each is in it."""
    return np.unique(np.concatenate([h for h, _ in ngrams([text])]), return_counts=True)


def _weighted(text: bytes, seen: np.ndarray, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of at least ``least_docs`` texts, with their share in the text times the gain."""
    ids, counts = _counted(text)
    x = (GAIN * counts / max(counts.sum(), 1)).astype(np.float32)
    keep = seen[ids] >= least_docs
    return ids.astype(np.int32)[keep], x[keep]


def fit(found: list[bytes], toxic: np.ndarray, weight: np.ndarray, *, least_docs: int = 1, epochs: int = 10, least_steps: int = 250, size: int = 128, rate: float = 0.02, decay: float = 3e-4, seed: int = 7) -> Bag:
    """Train table and softmax jointly by Adam on mini-batches, whose n-grams alone move in a step.

    N-grams of fewer than ``least_docs`` sample texts keep a zero row; by default every one is learned.
    """
    share = float((weight * toxic).sum() / weight.sum()) if len(found) else 0.0
    if not 0 < share < 1:
        return Bag(np.zeros(BUCKETS, dtype=np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for t in found:
        seen[_counted(t)[0]] += 1
    random = np.random.default_rng(seed)
    every = np.flatnonzero(seen >= least_docs)
    table = np.zeros((BUCKETS, WIDTH), dtype=np.float32)
    table[every] = random.normal(0, 0.02, (len(every), WIDTH))
    softmax = random.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.array([0.0, np.log(share / (1 - share))], dtype=np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, softmax, bias)]
    y = np.eye(2, dtype=np.float32)[toxic.astype(int)]
    scale = (weight / weight.mean()).astype(np.float32)
    parts = np.array_split(random.permutation(len(found)), max(1, len(found) // size))
    # Hashed a second time, so that the n-grams of all texts are never held beside the batches.
    batches = [(some, _Batch([_weighted(found[i], seen, least_docs) for i in some])) for some in parts]
    step, epochs = 0, max(epochs, -(-least_steps // len(batches)))
    for epoch in range(epochs):
        for k in random.permutation(len(batches)):
            some, batch = batches[k]
            step += 1
            own = batch.active
            _, (g, *others) = gradients(batch, y[some], scale[some], table[own], softmax, bias)
            pace = rate * (1 - epoch / epochs)
            for value, g, (m, v), at in ((table, g + decay * table[own], state[0], own), (softmax, others[0], state[1], slice(None)), (bias, others[1], state[2], slice(None))):
                new_m, new_v = 0.9 * m[at] + 0.1 * g, 0.99 * v[at] + 0.01 * g * g
                m[at], v[at] = new_m, new_v
                value[at] -= pace * (new_m / (1 - 0.9**step)) / (np.sqrt(new_v / (1 - 0.99**step)) + 1e-6)
    return Bag(GAIN * (table @ (softmax[:, 1] - softmax[:, 0])), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", toxic_docs: int = 1500, clean_docs: int = 3000, sample_chars: int = 50_000) -> Bag:
    """Fit on a bounded sample of labelled rows; give only rows of the training fold."""
    rows = agreed(labels, label_col)
    share = rows.agg(F.avg((F.col("mark") == 1).cast("double")).alias("p")).first()["p"] or 0.0
    short = docs.filter(F.length(F.coalesce("text", F.lit(""))) <= sample_chars)
    ids = sample_ids(rows.filter("mark = 1"), toxic_docs, "1").unionByName(sample_ids(rows.filter("mark = 0"), clean_docs, "0"))
    found = sorted((r["role"], r["id"], r["text"]) for r in with_texts(short, ids).collect())
    toxic = np.array([r[0] == "1" for r in found], dtype=bool)
    n = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    kept = [r[2].encode() for r in found]
    del found
    return fit(kept, toxic, np.where(toxic, share / n[0], (1 - share) / n[1]))


def score(docs: DataFrame, model: Bag, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(texts(part)))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held: Column = fold() == 0
    model = learn(docs.filter(~held), labels.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
