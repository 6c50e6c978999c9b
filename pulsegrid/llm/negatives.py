"""Hard-negative mining by bit-sliced integer products.

Vectors are whole numbers, cut into bit planes: the sign first, then from the most significant bit down.  After some
planes of a candidate, its score against an anchor lies between the partial sum plus the most that the missing planes can
take away and the most that they can add.  The interval tightens plane by plane, and a candidate goes as soon as its
interval lies below what is needed: the worst of the best rows so far or, for negatives, the window that the positive's
score opens.  While many are left the planes are products of whole blocks; then pair by pair.  What is left after the
last plane has its exact score, so nothing is approximate.

Anchors are a stated share of the rows, so they go through in blocks of at most ``ANCHORS``; a block, and the best rows of
its anchors, are all that is broadcast.  Each block reads the rows twice: for the positives, then for the negatives that
their scores admit.  A task keeps a few rows per anchor, whatever it reads; Spark merges the tasks' rows by anchor.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors are scored
against those of the same length only, empty ones score 0; ties in score go to the smaller id; repeated rows count each,
and an anchor's own row alone is not its positive; an anchor without a positive, or a positive without a negative, has no
row; an empty table gives an empty result; further columns are ignored.  Scores that do not fit 53 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import saved, scratch_folder, table

#: Anchors of one block, and rows that a task scores at once.
ANCHORS = 2048
ROWS = 2048
#: From this share of surviving pairs down they are followed pair by pair.
SPARSE = 1 / 16
#: Pairs scored at once.
PAIRS = 1 << 15


class Block:
    """A block of anchors: numbers, labels, and the bounds of what missing planes can change."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.vectors, self.labels = vectors, labels
        self.float = vectors.astype(np.float64)
        self.less = np.minimum(vectors, 0).sum(axis=1).astype(np.float64)
        self.more = np.maximum(vectors, 0).sum(axis=1).astype(np.float64)
        self.most = int(np.abs(vectors).sum(axis=1).max(initial=0))

    def exact(self, of: np.ndarray, rows: np.ndarray, need, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs in ``alive`` (anchors ``of`` by rows) that ``need`` lets pass to the end.

        ``need(anchor, row, low, high)`` says of each pair whether it may still qualify, given the bounds of its score: either
        of whole blocks, with ``anchor`` a column and ``row`` None, or of pairs.
        """
        width = max(1, int(max(-rows.min(initial=0) - 1, rows.max(initial=0))).bit_length())
        if self.most << width >= 1 << 53:
            raise ValueError("scores of these vectors do not fit 53 bits")
        vectors, less, more = self.float[of], self.less[of], self.more[of]
        total = np.zeros((len(of), len(rows)))
        columns = np.flatnonzero(alive.any(axis=0))  # rows that no anchor needs are dropped
        total, alive = total[:, columns], alive[:, columns]
        planes = [(width, -(1 << width)), *((b, 1 << b) for b in range(width - 1, -1, -1))]  # numbers in two's complement: the sign, then the bits
        for at, (bit, weight) in enumerate(planes):
            if not len(columns):
                break
            plane = ((rows[columns] >> bit) & 1).astype(np.float64)
            total += weight * (vectors @ plane.T)
            rest = (1 << bit) - 1
            alive &= need(of[:, None], None, total + (rest * less)[:, None], total + (rest * more)[:, None], alive)
            if rest and np.count_nonzero(alive) <= SPARSE * alive.size:
                i, j = np.nonzero(alive)
                return self._pairs(of, columns, rows, i, j, total[i, j], planes[at + 1 :], need)
            stay = alive.any(axis=0)
            if np.count_nonzero(stay) < 0.75 * len(columns):
                columns, total, alive = columns[stay], total[:, stay], alive[:, stay]
        i, j = np.nonzero(alive)
        return of[i], columns[j], total[i, j].astype(np.int64)

    def _pairs(self, of, columns, rows, i, j, score, planes, need) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for lo in range(0, len(i), PAIRS):
            a, c, s = of[i[lo : lo + PAIRS]], columns[j[lo : lo + PAIRS]], score[lo : lo + PAIRS]
            for bit, weight in planes:
                s = s + weight * np.einsum("ij,ij->i", self.float[a], ((rows[c] >> bit) & 1).astype(np.float64))
                rest = weight - 1
                keep = need(a, c, s + rest * self.less[a], s + rest * self.more[a], None)
                a, c, s = a[keep], c[keep], s[keep]
            out.append((a, c, s.astype(np.int64)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


class Best:
    """The first few rows of each query, by falling score and rising id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.worst = np.full(queries, -np.inf)  # below this score nothing gets in

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        keep = place < self.most
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = place == self.most - 1
        self.worst[q[full]] = s[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.query, self.score, self.id)], names=["query", "score", "vec_id"])


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of the rows whose vectors have this length, a bounded number at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            ids, labels, vectors = batch.slice(lo, ROWS).columns
            ends = vectors.offsets.to_numpy()
            fits = np.flatnonzero(np.diff(ends) == length)
            flat = vectors.values.to_numpy()[(ends[fits][:, None] + np.arange(length)).ravel()].reshape(len(fits), length)
            yield ids.to_numpy()[fits], labels.to_numpy()[fits], flat.astype(np.int64)


def _best_of_label(block: Block, length: int, most: int):
    """The first ``most`` rows of each anchor's label, its own row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.labels), most)

        def need(anchor, row, low, high, alive):
            worst = best.worst[anchor]
            if row is None and low.shape[1] > most:  # enough rows here may be above this one already
                sure = np.where(alive, low, -np.inf)
                worst = np.maximum(worst, np.partition(sure, -most, axis=1)[:, -most][:, None])
            return high >= worst

        for ids, labels, vectors in _parts(batches, length):
            for label in np.intersect1d(labels, block.labels):
                of, rows = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
                a, c, score = block.exact(of, vectors[rows], need, np.ones((len(of), len(rows)), dtype=bool))
                best.add(a, score, ids[rows[c]])
        yield best.batch()

    return run


def _best_in_window(block: Block, length: int, low: np.ndarray, high: np.ndarray, most: int):
    """The first ``most`` rows of other labels whose score lies in each query's window; query = anchor * windows + window."""
    windows = low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(low.size, most)
        top = high.max(axis=1)

        def need(anchor, row, least, greatest, alive):
            floor = np.maximum(low, best.worst.reshape(low.shape))  # a window that is closed has an infinite floor
            if row is None:
                return (greatest >= floor.min(axis=1)[anchor]) & (least <= top[anchor])
            return ((greatest[:, None] >= floor[anchor]) & (least[:, None] <= high[anchor])).any(axis=1)

        for ids, labels, vectors in _parts(batches, length):
            a, c, score = block.exact(np.arange(len(block.labels)), vectors, need, block.labels[:, None] != labels)
            for w in range(windows):
                ok = (score >= low[a, w]) & (score <= high[a, w])
                best.add(a[ok] * windows + w, score[ok], ids[c[ok]])
        yield best.batch()

    return run


def _merged(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def quantised(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * component) of every row that takes part."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("int")))


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v).

    A negative's score is between ``low`` and ``high`` percent of the positive's, bounds included.
    """
    spark = rows.sparkSession
    rows = saved(rows)
    anchors = rows.filter(is_anchor).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies")).withColumn("length", F.size("v"))
    anchors = saved(anchors)
    buckets = max(1, -(-anchors.count() // (ANCHORS // 2)))
    anchors = anchors.withColumn("bucket", F.pmod(F.xxhash64("vec_id", "v"), F.lit(buckets)))
    anchors = saved(anchors.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("length", "bucket").orderBy("vec_id", "label", "v")) - 1) / ANCHORS)))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    folder, wrote = scratch_folder(spark, "negatives"), False
    blocks = anchors.select("length", "bucket", "part").distinct().orderBy("length", "bucket", "part").collect()
    for length, bucket, part in blocks:
        own = anchors.filter((F.col("length") == length) & (F.col("bucket") == bucket) & (F.col("part") == part)).orderBy("vec_id", "label", "v").collect()  # ANCHORS at most
        block = Block(np.array([r["v"] for r in own], dtype=np.int64).reshape(len(own), length), np.array([r["label"] for r in own], dtype=np.int64))
        near = _merged(rows.mapInArrow(_best_of_label(block, length, positives + 1), "query bigint, score bigint, vec_id bigint"), positives + 1).orderBy("query", "rank").collect()
        found: list[list[tuple[int, int]]] = [[] for _ in own]
        for r in near:
            found[r["query"]].append((r["vec_id"], r["score"]))
        for mine, r in zip(found, own, strict=True):
            itself = (r["vec_id"], sum(x * x for x in r["v"]))
            if itself in mine:  # else it would come after all of these
                mine.remove(itself)
            del mine[positives:]
        floor, ceiling = np.full((len(own), positives), np.inf), np.full((len(own), positives), -np.inf)
        for i, mine in enumerate(found):
            for k, (_, score) in enumerate(mine):
                if score >= 0:  # below zero the window is empty
                    floor[i, k], ceiling[i, k] = -(-low * score // 100), high * score // 100
        pairs = [(i * positives + k, own[i]["vec_id"], vec_id, score, own[i]["copies"]) for i, mine in enumerate(found) for k, (vec_id, score) in enumerate(mine)]
        if not pairs:
            continue
        pairs = spark.createDataFrame(pairs, "query bigint, anchor_id bigint, positive_id bigint, positive_score bigint, copies bigint")
        far = _merged(rows.mapInArrow(_best_in_window(block, length, floor, ceiling, negatives), "query bigint, score bigint, vec_id bigint"), negatives)
        out = far.join(F.broadcast(pairs), "query").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))  # ANCHORS * positives rows at most
        out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).coalesce(8).write.mode("append").parquet(folder)
        wrote = True
    if not wrote:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


#: All anchors against all rows, in plain SQL.
NEGATIVES_SQL = """
WITH _rows AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
_scores AS (
  SELECT a.rid AS arid, b.rid AS brid, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM _rows a JOIN _rows b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
_positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, other_id) AS k FROM _scores WHERE same) WHERE k <= 5),
_negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.k ORDER BY n.score DESC, n.other_id) AS r
  FROM _positives p JOIN _scores n ON p.arid = n.arid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM _negatives WHERE r <= 3"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": NEGATIVES_SQL}
