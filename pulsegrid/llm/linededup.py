"""Line dedup by site-relative frequency, in DataFrame functions.

Pages are grouped by host.  A line's frequency on a host is the number of the host's pages that contain it divided by
the host's number of pages; lines above ``ratio`` are boilerplate and are dropped from every page of the host.  A line
must stand on ``least`` pages, two by default: on a host of few pages one page alone is above any ratio, and what stands
once is not repeated.

Only hashes are shuffled to find them: one row per distinct line of a page, summed before the shuffle by (host, line
hash), so that a host with a third of all pages spreads over all tasks by its lines.  A host can have at most
(mean lines per page) / ratio boilerplate lines, so what a page needs is small; it is broadcast behind a check of its
size and otherwise joined with the host's pages dealt out over salted copies.

Lines are compared after trimming and folding runs of white space; empty lines are layout and stay where they are.
Lines end with LF, CR LF or CR; a line that stays keeps its end, and the last one that stays has none.

Defined cases: a null text stays null; an empty text stays empty; a null host is a host of its own; a page repeated in
the table counts as often as it stands there; a line counts once per page; ties at the ratio are kept (only lines
above it go); an empty table gives an empty result; columns other than the text come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, saved, small, table

RATIO = 0.08
LEAST = 2
#: Boilerplate hashes up to this many rows are broadcast (16 bytes each).
BROADCAST_HASHES = 200_000
SALTS = 64


def line_key(line: Column) -> Column:
    """The hash under which lines count as the same; null for a line without text."""
    folded = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D\xA0]+", " "))
    return F.when(folded != "", F.xxhash64(folded))


def lines_of(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r", -1)


def ends_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\r\n|\n|\r"), F.lit(0))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def boilerplate(rows: DataFrame, *, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """rows (host, text) -> (host, key, pages, host_pages, frequency) of every line above the ratio."""
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: k.isNotNull()))
    counts = rows.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    totals = totals.withColumnRenamed("host", "_host")
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return found.withColumn("frequency", F.col("pages") / F.col("host_pages")).filter(F.col("frequency") > ratio)


def drop_boilerplate(docs: DataFrame, host: Column, *, text_col: str = "text", ratio: float = RATIO, least: int = LEAST, count: str | None = None) -> DataFrame:
    """The rows of ``docs`` with their boilerplate lines removed; no row goes.

    ``count`` names a column to add for the number of lines that went; without it there is none.
    """
    rows = docs.select(host.alias("host"), F.col(text_col).cast("string").alias("text"))
    found = saved(boilerplate(rows, ratio=ratio, least=least).select("host", "key"))
    own, of, keys, salt, deal, lines, stays, went = fresh(docs, "__own", "__host", "__keys", "__salt", "__deal", "__lines", "__stays", "__went")
    per_host = found.groupBy("host").agg(F.collect_set("key").alias(keys)).withColumnRenamed("host", of)
    out = docs.withColumn(own, host)
    same = F.col(own).eqNullSafe(F.col(of))
    if small(found, BROADCAST_HASHES):
        out = out.join(F.broadcast(per_host), same, "left")
    else:
        salted = per_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn(deal, F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int"))
        out = out.join(salted, same & (F.col(deal) == F.col(salt)), "left").drop(salt, deal)
    some = F.col(keys).isNotNull()
    out = out.withColumn(lines, F.when(some, F.arrays_zip(lines_of(F.col(text_col)).alias("line"), ends_of(F.col(text_col)).alias("end"))))
    out = out.withColumn(stays, F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(keys), line_key(x["line"])), F.lit(False))))
    out = out.withColumn(went, F.coalesce(F.size(lines) - F.size(stays), F.lit(0)))
    first = F.transform(F.slice(stays, F.lit(1), F.greatest(F.size(stays) - 1, F.lit(0))), lambda x: F.concat(x["line"], x["end"]))
    joined = F.concat(F.array_join(first, ""), F.coalesce(F.try_element_at(F.col(stays), F.lit(-1))["line"], F.lit("")))
    out = out.withColumn(text_col, F.when(some & (F.col(went) > 0), joined).otherwise(F.col(text_col)))
    if count is not None:
        out = out.withColumn(count, F.col(went))
    return out.drop(own, of, keys, lines, stays, went)


def _digest(out: DataFrame, key: str, text: str) -> DataFrame:
    return out.select(key, F.col("_dropped").cast("long").alias("dropped_lines"), F.length(text).cast("long").alias("kept_chars"), F.md5(F.coalesce(text, F.lit(""))).alias("kept_md5"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source: what stays of each text, and how many lines went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _digest(drop_boilerplate(docs, F.col("source"), count="_dropped"), "doc_id", "text")


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages by the host of their address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return _digest(drop_boilerplate(pages, host_of(F.col("url")), text_col="html", count="_dropped"), "page_id", "html")


QUERIES = {"op6_line_dedup": op6_line_dedup, "line_dedup_pages": line_dedup_pages}


def line_dedup_sql(rows: str = "documents", host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> str:
    """DuckDB SQL: every column of the rows, with the text that stays, and dropped lines."""
    ends = "'\\r\\n|\\n|\\r'"
    return f"""
WITH _rows AS (SELECT row_number() OVER () AS rid, {host} AS _host, * FROM {rows}),
_lines AS (SELECT rid, _host, u.i, list_extract(ls, u.i) AS line, COALESCE(list_extract(es, u.i), '') AS tail FROM (SELECT rid, _host, regexp_split_to_array({text}, {ends}) AS ls, regexp_extract_all({text}, {ends}) AS es FROM _rows), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u),
_keyed AS (SELECT *, nullif(trim(regexp_replace(line, '[\\x20\\x09-\\x0D\\x{{A0}}]+', ' ', 'g')), '') AS k FROM _lines),
_pages AS (SELECT _host, count(*) AS host_pages FROM _rows GROUP BY _host),
_found AS (SELECT c._host, c.k FROM (SELECT _host, k, count(DISTINCT rid) AS pages FROM _keyed WHERE k IS NOT NULL GROUP BY _host, k) c JOIN _pages p ON c._host IS NOT DISTINCT FROM p._host
  WHERE c.pages >= {least} AND CAST(c.pages AS DOUBLE) / p.host_pages > {ratio}),
_marked AS (SELECT l.*, f.k IS NOT NULL AS goes FROM _keyed l LEFT JOIN _found f ON l._host IS NOT DISTINCT FROM f._host AND l.k = f.k),
_last AS (SELECT *, max(i) FILTER (WHERE NOT goes) OVER (PARTITION BY rid) AS last_i FROM _marked),
_kept AS (SELECT rid, count(*) FILTER (WHERE goes) AS dropped, string_agg(line || CASE WHEN i < last_i THEN tail ELSE '' END, '' ORDER BY i) FILTER (WHERE NOT goes) AS kept FROM _last GROUP BY rid)
SELECT r.* EXCLUDE (rid, _host) REPLACE (CASE WHEN COALESCE(k.dropped, 0) > 0 THEN COALESCE(k.kept, '') ELSE r.{text} END AS {text}), COALESCE(k.dropped, 0) AS dropped_lines
FROM _rows r LEFT JOIN _kept k ON r.rid = k.rid"""


def _digest_sql(key: str, text: str, inner: str) -> str:
    return f"SELECT {key}, CAST(dropped_lines AS BIGINT) AS dropped_lines, CAST(length({text}) AS BIGINT) AS kept_chars, md5(COALESCE({text}, '')) AS kept_md5 FROM ({inner})"


SQL = {
    "op6_line_dedup": _digest_sql("doc_id", "text", line_dedup_sql()),
    "line_dedup_pages": _digest_sql("page_id", "html", line_dedup_sql("pages", "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))", "html")),
}
