"""SimHash near-duplicates, searched with BK-trees.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles.  Fingerprints at most
``radius`` bits apart are linked; components of links are the groups of near copies.

Search: the 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints within the radius agree in two blocks at
least, so each distinct fingerprint goes to one shard per pair of blocks, keyed by their bits.  A shard's fingerprints
form a BK-tree (children keyed by their Hamming distance to the parent), and a query follows only the edges whose
distance is within the radius of its own distance to the node.  A shard beyond ``shard_rows`` is sharded once more: its
other blocks are halved, and of the halves as many as ``radius`` agree.  What is still larger, numbers that differ in few
bits, is cut into parts (see ``link``).  Trees meet their queries through the shuffle, which takes the place of a driver broadcast: fingerprints of
all documents never reach the driver.  A shard yields links from each linked set to its smallest fingerprint; that keeps
all components and stays linear.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
fewer words than the shingle size make one shingle; equal texts have equal fingerprints; null ids are kept and never
name a component unless no other id is there; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import by_group, maybe_broadcast, saved, shuffle_tasks, slices, stretches, table, texts
from pulsegrid.llm.components import components

SEED = 42
RADIUS = 2
#: Rows of a shard that one task works on together.
SHARD_ROWS = 1024
#: Shards of more than one row are picked out by a broadcast up to so many (some dozen bytes each), so that payloads move once.
FULL_ROWS = 200_000
#: About so many rows of a large shard go to all its parts.
ANCHORS = 32


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    digest = xxhash.xxh64_intdigest
    votes, count = np.zeros(64, dtype=np.int64), 0
    held: list[bytes] = []  # words that shingles of the next stretch begin with
    for piece in stretches(text):
        words = held + piece.lower().split()
        n = len(words) - shingle + 1
        if n <= 0:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
        for i in range(0, n, 1 << 14):
            votes += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        count, held = count + n, words[n:]
    if not count:
        return digest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts(part)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


class BKTree:
    """Distinct numbers under Hamming distance; a child hangs from its parent by an edge named with their distance."""

    def __init__(self, values: Iterable[int] = ()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indices of all numbers within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)


def _linked(tree: list[tuple[object, int]], queries: list[tuple[object, int]], radius: int, same: Callable[[object, object], bool] | None = None) -> list[tuple[object, object]]:
    """Links that join the (id, fingerprint) pairs within the radius: each linked id with the smallest of its set.

    ``same`` is a further test of two ids; pairs already joined through others are not tested again.
    """
    parent: dict[object, object] = {}

    def find(x: object) -> object:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    by_print: dict[int, list[object]] = {}
    for i, fp in tree:
        by_print.setdefault(fp, []).append(i)
    index = BKTree(by_print)
    for q, fp in queries:
        own = find(q)
        for at in index.within(fp, radius):
            for i in by_print[index.values[at]]:
                other = find(i)
                if own != other and (same is None or same(q, i)):
                    low, high = (own, other) if own < other else (other, own)
                    parent[high] = low
                    own = low
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _shard_keys(fp: Column, radius: int) -> Column:
    """One struct (which, bits) per pair of blocks."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    return F.array(*[F.struct(F.lit(k).alias("which"), block[i].alias("one"), block[j].alias("two")) for k, (i, j) in enumerate(combinations(range(n), 2))])


def _finer_keys(fp: Column, which: Column, radius: int) -> Column:
    """One struct (choice, bits) per choice of ``radius`` of the halves of the blocks that the shard's two leave."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    out = None
    for k, pair in enumerate(combinations(range(n), 2)):
        halves = [(lo, hi) for i in range(n) if i not in pair for mid in [(cuts[i] + cuts[i + 1]) // 2] for lo, hi in ((cuts[i], mid), (mid, cuts[i + 1]))]
        taken = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in halves]
        keys = F.array(*[F.struct(F.lit(c).alias("choice"), F.concat_ws(".", *[taken[i].cast("string") for i in some]).alias("bits")) for c, some in enumerate(combinations(range(len(halves)), radius))])
        out = F.when(which == k, keys) if out is None else out.when(which == k, keys)
    return out


def _meet(rows: DataFrame, group: list[str], radius: int, payload: str | None, same: Callable[[object, object], bool] | None) -> DataFrame:
    """rows (id, fp, group columns, tree, query, payload) -> links (a, b): in each group the queries search the trees' rows."""
    kind = rows.schema["id"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[object] = []
        b: list[object] = []
        for t in by_group(batches, group):
            ids = t.column("id").to_pylist()
            pairs = list(zip(ids, t.column("fp").to_numpy().view(np.uint64).tolist(), strict=True))
            tree, query = t.column("tree").to_pylist(), t.column("query").to_pylist()
            test = None
            if payload is not None:
                held = dict(zip(ids, t.column(payload).to_pylist(), strict=True))
                test = lambda x, y, held=held: same(held[x], held[y])
            for x, y in _linked([p for p, u in zip(pairs, tree, strict=True) if u], [p for p, u in zip(pairs, query, strict=True) if u], radius, test):
                a.append(x)
                b.append(y)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], names=["a", "b"])

    dealt = rows.repartition(shuffle_tasks(rows.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def link(keys: DataFrame, by: list[str], *, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, payload: str | None = None, same: Callable[[object, object], bool] | None = None, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keys (id, fp, shard columns) -> links (a, b) that connect all ids of a shard within the radius, directly or through others.

    ``same`` may test two payloads further.  ``finer`` lays the rows of shards beyond ``shard_rows`` out over further
    shard columns, which it adds, such that no two within the radius miss each other; so they cost in proportion to
    their number.  Where there is none, or what it makes is still too large, a shard is cut into parts.  First each part is
    searched by itself, together with some anchors of the shard that go to all parts; near copies all join the shard's
    largest component there.  Then only rows outside that component go to all parts and are searched for there: pairs
    inside it are connected already, so no link between components is lost, and a large group of near copies costs in
    proportion to its size.
    """
    keys = saved(keys)
    whole = F.lit(True)
    full = saved(keys.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1"))
    plain = keys.join(maybe_broadcast(full.filter(F.col("_n") <= shard_rows).drop("_n"), FULL_ROWS), by).withColumn("tree", whole).withColumn("query", whole)
    links = _meet(plain, by, radius, payload, same)
    if full.filter(F.col("_n") > shard_rows).isEmpty():
        return links
    hot = keys.join(maybe_broadcast(full.filter(F.col("_n") > shard_rows), FULL_ROWS), by)
    if finer is not None:
        spread = finer(hot.drop("_n"))
        more = [c for c in spread.columns if c not in keys.columns]
        return links.unionByName(link(spread, [*by, *more], radius=radius, shard_rows=shard_rows, payload=payload, same=same))
    hot = hot.withColumn("_parts", F.ceil(F.col("_n") * 2 / F.lit(shard_rows)).cast("int"))
    hot = saved(hot.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("_parts")).cast("int")))
    parts = F.sequence(F.lit(0), F.col("_parts") - 1)
    is_anchor = F.pmod(F.xxhash64("id", F.lit("anchor")), F.col("_n")) < ANCHORS
    anchors = hot.filter(is_anchor).withColumn("_to", F.explode(parts)).filter("_to <> part").withColumn("part", F.col("_to")).drop("_to")
    group = [*by, "part"]
    first = hot.unionByName(anchors).withColumn("tree", whole).withColumn("query", whole)
    links = saved(links.unionByName(_meet(first, group, radius, payload, same)))
    known = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rooted = hot.join(known, F.col("id") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "id")).drop("_node")
    largest = rooted.groupBy(*by, "_root").agg(F.count("*").alias("_c")).groupBy(*by).agg(F.max(F.struct("_c", "_root")).alias("_l")).select(*by, F.col("_l._root").alias("_largest"))
    outside = saved(rooted.join(largest, by).filter(F.col("_root") != F.col("_largest")).drop("_largest", "_root"))
    if outside.isEmpty():
        return links
    asked = outside.withColumn("part", F.explode(parts)).withColumn("tree", F.lit(False)).withColumn("query", whole)
    return links.unionByName(_meet(asked.unionByName(hot.withColumn("tree", whole).withColumn("query", F.lit(False))), group, radius, payload, same))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, root, component_id, fingerprint) for every document."""
    prints = saved(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    keys = distinct.select(F.col("fp").alias("id"), "fp", F.explode(_shard_keys(F.col("fp"), radius)).alias("k")).select("id", "fp", "k.*")
    finer = lambda hot: hot.select("*", F.explode(_finer_keys(F.col("fp"), F.col("which"), radius)).alias("_f")).select(*hot.columns, "_f.*")
    linked = components(link(keys, ["which", "one", "two"], radius=radius, shard_rows=shard_rows, finer=finer)).withColumnRenamed("node", "fp")
    named = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    groups = saved(named.select("fp", "root").join(names, "root"))
    found = prints.join(groups, "fp")
    return found.select("doc_id", "fp", "root", "component_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
