"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; everything else is unlabelled web text.  The classifier minimises the
non-negative unbiased risk of Kiryo et al. (2017) with the logistic loss,

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

and takes gradient steps that raise the second term whenever it falls below zero.  The class prior is given, or
estimated from positives and unlabelled texts alone, as by Garg et al. (2021): of a classifier of one against the other,
the share of unlabelled texts above a score is at least the prior times that of positives; the score where this bound,
with its error, is lowest gives the prior.  Each half of the sample is scored by a classifier of the other half.

Features describe the form of a text, in any language: log frequencies of pairs of character classes, and how often
words and word triples repeat.  The model is linear in them.

Samples: ``sample`` trusted positives and ``sample`` unlabelled documents of the training fold, in hash order of their
ids; the bound is a parameter and does not grow with the corpus.  Every whole text is scored.

Defined cases: a null text is empty; an empty text has the features of no pair at all and gets a score like any other;
without positives, or without documents, every score is the prior (0.5 where that is unknown); labels that are null are
not used; repeated label rows count once, ids labelled both ways are no positives; of an id with several texts the
smallest is learned from; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fold, id_text, mixed, slices, stretches, table, texts
from pulsegrid.llm.labelled import agreed, sample_ids, with_texts

SAMPLE = 6000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    out = np.full(256, 14, dtype=np.int64)
    groups = [range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), b" \t", b"\n\r", b".", b",", b"'\"-", b"!?", b"()[]{}<>", b"|", b"#$%&*@~^_=+\\/`", b";:", range(128, 256)]
    for i, g in enumerate(groups):
        out[list(g)] = i
    return out


CLASS = _classes()
CLASSES = 15
DIMENSIONS = CLASSES * CLASSES + 6
_PLACES = mixed(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)


def _hashes(found: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64)


def _without_end(line: bytes) -> bytes:
    return line.removesuffix(b"\n")


def features(text: bytes) -> np.ndarray:
    """The form of one UTF-8 text."""
    out = np.empty(DIMENSIONS, dtype=np.float32)
    raw, pairs = np.frombuffer(text, dtype=np.uint8), np.zeros(CLASSES * CLASSES)
    for i in range(0, len(raw) - 1, 1 << 18):
        c = CLASS[raw[i : i + (1 << 18) + 1]]
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.log((pairs + 0.05) / (len(raw) + 5))
    words = np.concatenate([_hashes(piece.split()) for piece in stretches(text)])
    n = len(words)
    same = np.count_nonzero(words[1:] == words[:-1])
    a, b, c = (words[i : max(0, n - 2 + i)] * _PLACES[i] for i in range(3))
    triples = len(np.unique(mixed(a + b + c)))
    lines = _hashes(line for line in map(_without_end, io.BytesIO(text)) if line)
    out[CLASSES * CLASSES :] = (
        np.log1p(n),
        len(text) / (n + 1),
        np.log((same + 0.2) / (n + 2)),
        len(np.unique(words)) / (n + 1),
        1 - (triples + 1) / (max(n - 2, 0) + 1),
        1 - (len(np.unique(lines)) + 1) / (len(lines) + 1),
    )
    return out


class Linear:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk of positives, unbiased risk of negatives, their gradients by the weights); the last column of the rows is one."""
    zp, zu = positive @ w, unlabelled @ w
    sp, su = 1 / (1 + np.exp(-zp.clip(-30, 30))), 1 / (1 + np.exp(-zu.clip(-30, 30)))
    # loss(-) = log(1 + e^z) has derivative s, loss(+) = log(1 + e^-z) has derivative s - 1
    good = prior * (positive.T @ (sp - 1)) / len(positive)
    bad = (unlabelled.T @ su) / len(unlabelled) - prior * (positive.T @ sp) / len(positive)
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()), good, bad


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 500, rate: float = 0.03, decay: float = 1e-3) -> Linear:
    """Minimise the non-negative unbiased risk by Adam over all rows."""
    if not len(positive) or not len(unlabelled):
        return Linear(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0)
    both = np.concatenate((positive, unlabelled)).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    w = np.zeros(DIMENSIONS + 1)
    p, u = (np.concatenate((((x - mean) / scale).clip(-8, 8), np.ones((len(x), 1))), axis=1) for x in (positive, unlabelled))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, good, bad = risk(w, p, u, prior)
        g = (good + bad if negative >= 0 else -bad) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(mean, scale, w[:-1], float(w[-1]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 200) -> float:
    """The share of positives among the unlabelled; 0.5 where either has fewer than two rows."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    found = []
    for k in (0, 1):
        model = _apart(positive[k::2], unlabelled[k::2], steps)
        p, u = (np.sort(model.scores(x)) for x in (positive[1 - k :: 2], unlabelled[1 - k :: 2]))
        cuts = p[:-1] if len(p) > 1 else p
        above_p, above_u = (1 - np.searchsorted(x, cuts, side="left") / len(x) for x in (p, u))
        error = np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p)))
        best = int(np.argmin(above_u / above_p + 1.01 * error / above_p))
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def _apart(positive: np.ndarray, unlabelled: np.ndarray, steps: int) -> Linear:
    """A plain logistic classifier of positives against unlabelled rows, each with half of the weight."""
    both = np.concatenate((positive, unlabelled)).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    x = np.concatenate((((both - mean) / scale).clip(-8, 8), np.ones((len(both), 1))), axis=1)
    y = np.repeat([1.0, 0.0], [len(positive), len(unlabelled)])
    weight = np.repeat([0.5 / len(positive), 0.5 / len(unlabelled)], [len(positive), len(unlabelled)])
    w, m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, steps + 1):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w).clip(-30, 30))) - y)) + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(mean, scale, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE, prior: float | None = None) -> Linear:
    """Fit on trusted positives of ``labels`` and unlabelled documents; give only rows of the training fold."""
    good = agreed(labels, label_col).filter("mark = 1")
    ids = sample_ids(good, sample, "p").unionByName(sample_ids(docs.select(id_text().alias("__id")), sample, "u"))
    rows = with_texts(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).tobytes() for t in texts(batch)], pa.binary())], names=["role", "id", "x"])

    found = rows.mapInArrow(run, "role string, id string, x binary").collect()
    found.sort(key=lambda r: (r["role"], r["id"]))
    p, u = (np.array([np.frombuffer(r["x"], dtype=np.float32) for r in found if r["role"] == role]).reshape(-1, DIMENSIONS) for role in "pu")
    # Ids are in no random order: deal the rows out by a fixed shuffle before they are halved.
    p, u = (x[np.random.default_rng(5).permutation(len(x))] for x in (p, u))
    return fit(p, u, estimate_prior(p, u) if prior is None else prior)


def score(docs: DataFrame, model: Linear, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.stack([features(t) for t in texts(part)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(x).astype(np.float64))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held: Column = fold() == 0
    model = learn(docs.filter(~held), labels.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
