"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key of its id and text.  Within a source, documents are range-sorted by that key: keys fall
into equal ranges of about ``rows_per_range`` documents, range totals are prefix-summed per source, and a
window inside each range completes the prefix sum, so that no task ever holds a whole source.  A source whose
target is above its size is repeated in whole epochs; the rest of its budget is cut at the exact word.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; sources of size 0
have target 0; an empty table gives an empty result; repeated rows count each; rows that tie in key and id are
ordered by size, and equal rows are interchangeable.  Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, id_text, maybe_broadcast, saved, table

#: 16^15: keys are the first 15 hex digits of an MD5.
KEYS = float(16**15)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, n, source_size) -> with target: shares of the grand total by weight, stopped at ``cap`` times the size.

    Resharing the excess by weight until none is above gives least(cap, weight * level).  In ascending order of
    cap/weight the level is the largest of (total - caps before) / (weights from here on).
    One row per source goes through one task here; nothing per document does.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("_w", F.element_at(cycle, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.lit(cap).cast("long") * F.col("source_size"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_w").over(after).cast("double")
    s = s.withColumn("_level", level)
    s = s.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w").cast("double") * F.max("_level").over(every)))
    return s.select("source", "n", "source_size", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", rows_per_range: int = 4096) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.  Reruns agree."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(text_col).cast("string").alias("text"))
    # Narrow rows, kept: the text is read once.  Its hash in the key parts rows that share an id or have none.
    rows = saved(rows.withColumn("_key", F.conv(F.substring(F.md5(F.concat(F.lit(seed), id_text(), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))), 1, 15), 16, 10).cast("long")).drop("text"))
    per_source = targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, cap)
    ranges = F.ceil(F.col("n") / F.lit(rows_per_range))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    per_source = saved(per_source.select(F.col("source").alias("_source"), "source_size", "target", ranges.alias("_ranges"), epochs.alias("_epochs"), (F.floor("target").cast("long") - epochs * F.col("source_size")).alias("_rest")))
    rows = rows.join(maybe_broadcast(per_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_range", F.floor(F.col("_key").cast("double") / F.lit(KEYS) * F.col("_ranges")).cast("long"))
    in_range = Window.partitionBy("source", "_range")
    up_to = in_range.orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(F.col("source").alias("_source"), F.col("_range").alias("_at")).agg(F.sum("size").alias("_sum"))
    below = Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_at", F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_up_to", F.sum("size").over(up_to))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
    start = F.col("_base") + F.col("_up_to") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - start))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(documents: str = "documents", seed: str = "mix") -> str:
    """DuckDB SQL for the query, over any relation with the columns of documents."""
    return f"""
WITH _rows AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('{seed}' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(md5(text), '')), 1, 15) AS k FROM {documents}),
_sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM _rows GROUP BY source),
_weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS c FROM _sizes),
_levels AS (SELECT *, CAST(sum(source_size) OVER () - COALESCE(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM _weighed),
_targets AS (SELECT source, source_size, least(CAST(c AS DOUBLE), CAST(w AS DOUBLE) * max(level) OVER ()) AS target FROM _levels),
_budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM _targets),
_placed AS (SELECT r.doc_id, r.size, b.source_size, b.target, b.epochs, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
  sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.size AS start
  FROM _rows r JOIN _budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM _placed"""


QUERIES = {"op7_mixing": op7_mixing}
SQL = {"op7_mixing": mixing_sql()}
