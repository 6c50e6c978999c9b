"""Overviews without a row per sample: columns from whole chunks, and a stored tree for any zoom.

A tree has levels: level k has one least and one greatest value for every ``FAN ** k`` samples of a signal, counted from the
signal's start, so level 0 is the samples.  ``tree`` makes the levels of each chunk by itself, in rows of bounded size; a
node that two chunks share is there twice, with the part of each, which least and greatest do not mind.  ``zoom`` takes from
each level what a column needs: whole nodes of the coarsest level that fits into a column, and towards the column's ends
ever finer ones.  Stored by level, a zoom far out reads the samples near its columns' ends only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.signal import sized

FAN = 16
LEVELS = 4
#: Samples, or nodes, of one row.
ROW = 4096


def _slice(values: Column, start: Column, stop: Column) -> Column:
    """values[start:stop], counted from 0; empty where stop is not above start."""
    return F.slice(values, (F.greatest(start, F.lit(0)) + 1).cast("int"), F.greatest(stop - F.greatest(start, F.lit(0)), F.lit(0)).cast("int"))


def _up_to(low: Column, high: Column) -> Column:
    """low, low + 1 ... high; empty where high is below low."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("bigint")


def _ranges(columns: Column, mins: Column, maxs: Column, ends) -> Column:
    """(col, mn, mx) of each column, from the pieces [start, stop) of the arrays that ``ends(col)`` lists."""

    def one(c: Column) -> Column:
        pieces = ends(c)
        least = F.array_min(F.array(*[F.array_min(_slice(mins, a, b)) for a, b in pieces]))
        most = F.array_max(F.array(*[F.array_max(_slice(maxs, a, b)) for a, b in pieces]))
        return F.struct(c.alias("col"), least.alias("mn"), most.alias("mx"))

    return F.filter(F.transform(columns, one), lambda r: r["mn"].isNotNull())


def _scaled(columns: DataFrame, width: int, *keys: str) -> DataFrame:
    """Columns with the scale of the whole, widened by one either way for a constant signal; those past the width go."""
    scale = columns.groupBy(*keys).agg(F.min("mn").alias("_lo"), F.max("mx").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    scale = scale.select(*keys, F.when(flat, F.col("_lo") - 1).otherwise(F.col("_lo")).alias("lo"), F.when(flat, F.col("_hi") + 1).otherwise(F.col("_hi")).alias("hi"))
    return columns.filter(F.col("col") < width).join(scale, list(keys))


def overview_chunks(chunks: DataFrame, width: int, *keys: str) -> DataFrame:
    """``signal.overview`` from chunks (keys, chunk_index, samples): each chunk gives a row for each column it reaches."""
    rows = sized(chunks.select(*keys, "chunk_index", "samples"), *keys).filter(F.size("samples") > 0)
    per, first = F.greatest(F.lit(1), _div(F.col("total"), width)), F.col("first")
    columns = _up_to(_div(first, per), _div(first + F.size("samples") - 1, per))
    made = _ranges(columns, F.col("samples"), F.col("samples"), lambda c: [(c * per - first, (c + 1) * per - first)])
    columns = rows.select(*keys, F.explode(made).alias("c")).select(*keys, "c.*").groupBy(*keys, "col").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    return _scaled(columns, width, *keys)


def tree(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, level, start, mins, maxs): nodes from number ``start`` on; to be stored by level."""
    rows = sized(chunks.select(*keys, "chunk_index", "samples"), *keys).filter(F.size("samples") > 0)
    first, n = F.col("first"), F.size("samples")
    cut = _up_to(_div(first, ROW), _div(first + n - 1, ROW))
    piece = lambda t: F.struct(F.greatest(t * ROW, first).alias("start"), _slice(F.col("samples"), t * ROW - first, F.least((t + 1) * ROW - first, n)).alias("mins"))
    own = rows.select(*keys, F.explode(F.transform(cut, piece)).alias("p")).select(*keys, F.lit(0).alias("level"), "p.start", "p.mins", F.col("p.mins").alias("maxs"))
    start = F.col("start")

    def level(k: int) -> Column:
        size = FAN**k
        nodes = _up_to(_div(start, size), _div(start + F.size("mins") - 1, size))
        part = lambda b: _slice(F.col("mins"), b * size - start, F.least((b + 1) * size - start, F.size("mins")))
        return F.struct(F.lit(k).alias("level"), _div(start, size).alias("start"), F.transform(nodes, lambda b: F.array_min(part(b))).alias("mins"), F.transform(nodes, lambda b: F.array_max(part(b))).alias("maxs"))

    zero = F.struct(F.col("level"), start.alias("start"), F.col("mins"), F.col("maxs"))
    return own.select(*keys, F.explode(F.array(zero, *[level(k) for k in range(1, LEVELS + 1)])).alias("n")).select(*keys, "n.*")


def zoom(nodes: DataFrame, low: int, high: int, width: int, *keys: str) -> DataFrame:
    """(keys, col, mn, mx) of samples low to high - 1 in columns of max(1, floor((high - low) / width)) samples.

    Columns without a sample are left out, as is what lies past the last whole column.
    """
    per = max(1, (high - low) // width)
    top = max(k for k in range(LEVELS + 1) if FAN**k <= per)
    end = min(high, low + per * width)
    out = None
    for k in range(top + 1):
        size, above = FAN**k, FAN ** (k + 1)
        start, n = F.col("start"), F.size("mins")
        # Columns that the row's nodes reach.
        first, last = F.greatest(_div(start * size - low, per), F.lit(0)), F.least(_div((start + n) * size - 1 - low, per), F.lit(_last(low, end, per)))

        def ends(c: Column, k: int = k, size: int = size, above: int = above) -> list[tuple[Column, Column]]:
            """Nodes of this level in the column, but for what the level above has: numbers in the row."""
            a, b = c * per + low, F.least((c + 1) * per + low, F.lit(end))
            own_a, own_b = F.ceil(a / size), _div(b, size)
            if k == top:
                return [(own_a - F.col("start"), own_b - F.col("start"))]
            up_a, up_b = F.ceil(a / above) * FAN, _div(b, above) * FAN
            none = up_a >= up_b
            return [(own_a - F.col("start"), F.when(none, own_b).otherwise(up_a) - F.col("start")), (F.when(none, own_b).otherwise(up_b) - F.col("start"), own_b - F.col("start"))]

        rows = nodes.filter((F.col("level") == k) & (start * size < end) & ((start + n) * size > low))
        if k < top:  # finer nodes lie at the ends of columns only
            reach = above + size
            rows = rows.filter(_div((start + n) * size + reach - low, per) > _div(start * size - reach - low, per))
        made = _ranges(_up_to(first, last), F.col("mins"), F.col("maxs"), ends)
        part = rows.select(*keys, F.explode(made).alias("c")).select(*keys, "c.*")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "col").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def _last(low: int, end: int, per: int) -> int:
    return max(0, (end - low - 1) // per)
