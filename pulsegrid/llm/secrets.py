"""Secret scan over an incremental blob ledger, in DataFrame functions only.

A blob is one distinct text, addressed by its SHA-256.  The ledger is a table of (blob, rule_version) pairs already
scanned together with their findings; the version is a checksum of all rules, so that a changed rule scans anew.  A run
content-addresses every path (document or historical version), scans only pairs that the ledger has not seen, appends
what it found to the ledger, and joins the ledger's findings back to all paths.

Texts stay where they lie: what is shuffled is ids, blobs and findings.  A text moves only where the blobs to choose
from are too many to broadcast.  Every rule takes time in proportion to the text: no rule starts twice in one run of
its characters, and positions are summed in blocks.

Defined cases: a null text is the empty blob; an empty table gives an empty result; repeated rows are paths of
their own; positions are code points, end exclusive; further columns of the input are ignored; a blob that the ledger
holds twice (two runs at once) counts once.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import id_text, saved, scratch_folder, small, table

#: The base rules, in the order in which kinds are listed (pattern, kept matches).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
#: Rules that the method adds to the base ones.
ADDED = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "ghtoken": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "urlcred": r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/@]++@",
}
RULES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | ADDED
#: What a text must hold for a rule to be tried.
NEEDS = {"access": "AKIA", "pem": "-----BEGIN ", "ghtoken": "gh", "jwt": "eyJ", "urlcred": "://"}
#: A checksum of the rules: ledger entries made by other rules do not count as seen.
RULE_VERSION = zlib.crc32(repr(sorted(RULES.items())).encode())
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, rule_version bigint, spans {SPANS}"
#: The session setting that names a ledger to keep between runs of the query.
LEDGER_SETTING = "pulsegrid.secrets.ledger"


def _spans(text: Column, kind: str, rank: int) -> Column:
    """One rule's spans: a text is its pieces between matches and its matches in turn, so their lengths give positions.

    The lengths are summed within blocks of about the root of their number, then over the blocks.
    """
    pattern = RULES[kind]
    none = F.array().cast(SPANS)

    def measured(piece: Column, match: Column) -> Column:
        keep = F.length(F.regexp_extract(match, pattern, 1)) >= 6 if kind == "assign" else match.isNotNull()
        return F.struct(F.length(piece).alias("gap"), F.length(match).alias("n"), keep.alias("keep"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + m["n"]).alias("end"))
        return F.struct((start + m["n"]).alias("at"), F.when(m["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def blocks(parts: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(parts))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(parts), width), lambda i: F.aggregate(F.slice(parts, i, width), F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block["out"], lambda x: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), (x["end"] + by).alias("end")))

    def placed(done: Column) -> Column:
        # the last piece has no match, so its block's length is null: nothing follows it
        ends = F.aggregate(done, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(x["at"], F.lit(0)))))
        return F.flatten(F.zip_with(done, F.slice(ends, F.lit(1), F.size(done)), shifted))

    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)
    there = text.rlike(pattern)
    if kind in NEEDS:
        there = text.contains(NEEDS[kind]) & there
    return F.when(there, let(parts, lambda p: let(blocks(p), placed))).otherwise(none)


def spans_of(text: Column) -> Column:
    """All spans of a text by start, then kind as listed."""
    return F.sort_array(F.concat(*[_spans(text, kind, rank) for rank, kind in enumerate(RULES)]))


def scan(paths: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths: doc_id, blob; ledger entries of this run: blob, rule_version, spans).

    ``ledger`` holds the entries of earlier runs.  Of a blob that it has not seen one path is scanned, the one whose id
    is smallest as text (all rows of that id and text, where they repeat).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = paths.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    addressed = source.withColumn("blob", F.unhex(F.sha2("text", 256)))
    known = saved(addressed.select("doc_id", "blob"))
    first = known.groupBy("blob").agg(F.min(id_text()).alias("_first"), F.count("*").alias("_n"))
    if ledger is not None and not (seen := ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob")).isEmpty():
        first = saved(first.join(seen, "blob", "left_anti"))
        side = first.select("blob", "_first")
        side = F.broadcast(side) if small(side) else side.hint("shuffle_hash")
        unseen = addressed.withColumn("_first", id_text()).join(side, ["blob", "_first"], "left_semi")
    elif small(repeated := first.filter("_n > 1").select("blob", "_first")):
        chosen = F.col("_first").isNull() | (F.col("_first") == id_text())
        unseen = addressed.join(F.broadcast(repeated), "blob", "left").filter(chosen)
    else:
        unseen = addressed.withColumn("_first", id_text()).join(first.select("blob", "_first").hint("shuffle_hash"), ["blob", "_first"], "left_semi")
    found = unseen.select("blob", F.lit(RULE_VERSION).cast("long").alias("rule_version"), spans_of(F.col("text")).alias("spans"))
    return known, found.dropDuplicates(["blob"])


def scan_into(paths: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans) of every path, through the ledger in ``folder``, which is made or added to."""
    spark = paths.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)
    ledger = spark.read.schema(LEDGER).parquet(folder)
    known, fresh = scan(paths, ledger, id_col=id_col, text_col=text_col)
    fresh.write.mode("append").parquet(folder)
    ledger = spark.read.schema(LEDGER).parquet(folder).filter(F.col("rule_version") == RULE_VERSION)
    if not ledger.groupBy("blob").count().filter("count > 1").isEmpty():
        ledger = saved(ledger.dropDuplicates(["blob"]))
    # Nothing but the shuffle stands between the join and its sides, so that the paths of one hot blob can be split.
    return known.join(ledger, "blob").select("doc_id", "blob", "spans")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is that of the session's setting; without one each call has its own, and scans every blob."""
    findings = scan_into(table(spark, sf_dir, "documents"), spark.conf.get(LEDGER_SETTING, None) or scratch_folder(spark, "secrets"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return findings.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_secrets": op4_secrets}
SQL: dict[str, str] = {}
