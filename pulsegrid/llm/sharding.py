"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

Equal texts form one group, so that copies are not dealt over the shards; a group is an atom of its bytes with three
coordinates: the logarithm of the text's size, and codes of the source and of the language (of its copies the smallest).
A group above ``1 / PORTIONS`` of a leaf is cut into portions by the hash of its ids, as no shard could hold it evenly.

A node is split along its widest coordinate (its range as a share of the range of all documents), at the weighted median:
atoms in order of the coordinate, then of the text's MD5, then of the portion.  Nodes split until each is one of the
leaves, whose number follows from the target bytes; of an odd number of leaves the left side gets the smaller share.

The median is found without a sort of the whole: bytes are summed in cells between a bracket's ends, the cell where the
wanted share is reached becomes the next bracket, first along the coordinate, then along the MD5, until a bracket holds
few atoms, which one window orders.  So each step is a map-side sum whose result is bounded by nodes times cells.  All
nodes of a level go together.  Slots are counted in ranges of a hash, with the ranges' totals summed before.

Defined cases: a null text has no bytes, as the empty one, and is equal to it; null sources, languages and ids count as
values of their own; repeated rows get slots each; ties end in the MD5; an empty table gives an empty result; where there
are fewer groups than leaves some shards stay empty; a document above a leaf's bytes is a shard's own, uneven one; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import id_text, maybe_broadcast, saved, table

#: A group of more than a leaf's bytes / PORTIONS is cut.
PORTIONS = 20
#: Cells that a bracket is cut into.
CELLS = 1024
#: A bracket of at most so many atoms is ordered by one window.
FEW = 20_000
#: Rows of one window when slots are counted, about.
RANGE = 50_000
DIMS = ("d0", "d1", "d2")


def _number(hex_text: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def _code(col: str) -> Column:
    """A number in 32 bits for a value; null is a value."""
    return _number(F.md5(F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null")).cast("binary")), 8)


def _described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(doc_id, size, t, text_crc32, d0, d1, d2, copies): narrow rows, equal ones as one; the text is read once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.md5(text.cast("binary")).alias("t"), F.crc32(text.cast("binary")).alias("text_crc32"), _code(source_col).alias("d1"), _code(lang_col).alias("d2"),
    )
    rows = own.groupBy("doc_id", "size", "t", "text_crc32").agg(F.count("*").alias("copies"), F.min("d1").alias("d1"), F.min("d2").alias("d2"))
    return rows.withColumn("d0", F.round(F.log2(F.col("size")) * 1000).cast("long"))


def _medians(atoms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, dim, left, cut, lo, low) of each splitting node: ``cut`` is (coordinate, t, p) of the last atom that goes left.

    An atom goes left if its middle byte is among the first ``want`` of its node.  Where ``cut`` is null, what comes before
    the coordinate ``lo`` and the MD5 number ``low`` goes left.
    """
    rows = atoms.join(maybe_broadcast(nodes.select("node", "dim")), "node").select("node", _along("dim").alias("c"), "t", "p", "w", _number(F.col("t"), 12).alias("h"))
    # A bracket: the atoms with lo <= c <= hi and low <= h <= high; ``base`` bytes come before it.
    bounds = [F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")]
    bracket = rows.groupBy("node").agg(*bounds).join(maybe_broadcast(nodes.select("node", "want")), "node")
    bracket = saved(bracket.withColumn("base", F.lit(0).cast("long")))
    wide = (F.col("n") > FEW) & ((F.col("lo") < F.col("hi")) | (F.col("low") < F.col("high")))

    def within(b: DataFrame) -> DataFrame:
        return rows.join(maybe_broadcast(b.drop("n")), "node").filter("c between lo and hi and h between low and high")

    while not bracket.filter(wide).isEmpty():
        first = F.col("lo") < F.col("hi")  # along the coordinate, then along the MD5
        at, start, end = (F.when(first, F.col(a)).otherwise(F.col(b)) for a, b in (("c", "h"), ("lo", "low"), ("hi", "high")))
        inside = within(bracket.filter(wide)).withColumn("cell", F.floor((at - start) * CELLS / (end - start + 1)))
        cells = inside.groupBy("node", "cell").agg(*bounds, F.sum("w").alias("sum"))
        below = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.join(maybe_broadcast(bracket.select("node", "want", "base")), "node")
        cells = cells.withColumn("base", F.col("base") + F.coalesce(F.sum("sum").over(below), F.lit(0)))
        reached = Window.partitionBy("node").orderBy(F.col("base") + F.col("sum") < F.col("want"), "cell")
        hit = cells.withColumn("_r", F.row_number().over(reached)).filter("_r = 1")
        bracket = saved(bracket.filter(~wide).unionByName(hit.select(bracket.columns)))
    ordered = Window.partitionBy("node").orderBy("c", "t", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = within(bracket).withColumn("_up_to", F.col("base") + F.sum("w").over(ordered)).filter(2 * F.col("_up_to") - F.col("w") <= 2 * F.col("want"))
    cut = last.groupBy("node").agg(F.max(F.struct("c", "t", "p")).alias("cut"))
    return nodes.select("node", "dim", "left").join(bracket.select("node", "lo", "low"), "node").join(cut, "node", "left")


def _along(dim: str) -> Column:
    return F.when(F.col(dim) == 0, F.col("d0")).when(F.col(dim) == 1, F.col("d1")).otherwise(F.col("d2"))


def kd_leaves(atoms: DataFrame, leaves: int) -> DataFrame:
    """atoms (t, p, w, d0, d1, d2) -> (t, p, leaf), leaf from 0 to leaves - 1, by splits at weighted medians."""
    total = atoms.agg(*[F.max(d) - F.min(d) for d in DIMS]).first()
    share = [F.col(d) / F.lit(float(r)) if r else F.lit(0.0) for d, r in zip(DIMS, total, strict=True)]
    widest = F.when((share[0] >= share[1]) & (share[0] >= share[2]), 0).when(share[1] >= share[2], 1).otherwise(2)
    # A node has the leaves first .. first + parts - 1.
    atoms = saved(atoms.withColumns({"node": F.lit(1).cast("long"), "first": F.lit(0), "parts": F.lit(leaves)}))
    while not (open_ := atoms.filter("parts > 1")).isEmpty():
        nodes = open_.groupBy("node", "parts").agg(F.sum("w").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS])
        left = F.floor(F.col("parts") / 2).cast("int")
        nodes = saved(nodes.select("node", widest.alias("dim"), left.alias("left"), F.floor(F.col("bytes") * left / F.col("parts")).alias("want")))
        cuts = saved(_medians(open_, nodes))
        at = _along("dim")
        before = (at < F.col("lo")) | ((at == F.col("lo")) & (_number(F.col("t"), 12) < F.col("low")))
        side = F.coalesce(F.struct(at.alias("c"), F.col("t"), F.col("p")) <= F.col("cut"), before)
        moved = open_.join(maybe_broadcast(cuts), "node").withColumn("_left", side)
        pick = lambda a, b: F.when(F.col("_left"), a).otherwise(b)
        moved = moved.select("t", "p", "w", *DIMS, (2 * F.col("node") + pick(F.lit(0), F.lit(1))).alias("node"), pick(F.col("first"), F.col("first") + F.col("left")).alias("first"), pick(F.col("left"), F.col("parts") - F.col("left")).alias("parts"))
        atoms = saved(atoms.filter("parts <= 1").select(moved.columns).unionByName(moved))
    return atoms.select("t", "p", F.col("first").alias("leaf"))


def kd_shards(docs: DataFrame, *, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots count from 0 in each shard.

    Either a number of shards, or the bytes that a shard shall have.
    """
    rows = saved(_described(docs, id_col, text_col, source_col, lang_col))
    weight = F.sum(F.col("size") * F.col("copies"))
    total = rows.agg(weight).first()[0] or 0
    if target_bytes is not None:
        shards = max(1, -(-total // target_bytes))
    portion = max(1, total // (shards * PORTIONS))
    groups = rows.groupBy("t").agg(weight.alias("w"), F.min("d0").alias("d0"), F.min("d1").alias("d1"), F.min("d2").alias("d2"))
    groups = saved(groups.withColumn("k", F.ceil(F.col("w") / F.lit(portion))))
    # At most shards * PORTIONS groups are large.
    large = groups.filter("k > 1").select("t", "k")
    rows = rows.join(maybe_broadcast(large), "t", "left").withColumn("p", F.coalesce(_number(F.md5(id_text().cast("binary")), 8) % F.col("k"), F.lit(0)))
    parts = rows.filter("k > 1").groupBy("t", "p").agg(weight.alias("w"))
    parts = parts.join(groups.drop("w", "k"), "t").select("t", "p", "w", *DIMS)
    atoms = groups.filter("k <= 1").select("t", F.lit(0).cast("long").alias("p"), "w", *DIMS).unionByName(parts)
    placed = saved(rows.join(kd_leaves(atoms, shards), ["t", "p"]).select("doc_id", "size", "t", "text_crc32", "copies", F.col("leaf").alias("shard"), _number(F.md5(F.concat(id_text(), F.lit("|"), F.col("t")).cast("binary")), 12).alias("key")))
    counts = saved(placed.groupBy("shard").agg(F.count("*").alias("n")))
    placed = placed.join(maybe_broadcast(counts), "shard").withColumn("range", F.floor(F.col("key") / F.lit(16.0**12) * F.ceil(F.col("n") / RANGE)))
    sums = placed.groupBy("shard", "range").agg(F.sum("copies").alias("sum"))
    below = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.select("shard", "range", F.coalesce(F.sum("sum").over(below), F.lit(0)).alias("base")))
    within = Window.partitionBy("shard", "range").orderBy("key", "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(maybe_broadcast(sums), ["shard", "range"])
    start = F.col("base") + F.col("before")
    return placed.withColumn("slot", F.explode(F.sequence(start, start + F.col("copies") - 1))).select("doc_id", "size", "text_crc32", "shard", "slot")


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_kd_shards": op13_kd_shards}
SQL: dict[str, str] = {}
