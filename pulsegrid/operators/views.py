"""Stored results that follow a change of their tables: only what the change can reach is worked out again.

A view's rows are dealt into buckets by the hash of its key.  From two snapshots of each table, the rows that differ give
the keys that are reached; the view is recomputed for their buckets alone and written as a new version of them.  A manifest
that names each bucket's version is written last, so readers see all of a refresh or nothing of it, and files of other
buckets are never touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: restrict(table, column) keeps the rows whose key is in a bucket that is worked out.
Restrict = Callable[[DataFrame, str], DataFrame]
View = Callable[[Restrict], DataFrame]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is whole, rising."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(top):
        return []
    found = [f.getPath() for f in store.listStatus(top)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("bucket int, version int").parquet(f"{path}/manifest/version={version}").select("bucket", "version")


def _write(rows: DataFrame, key: str, path: str, version: int, manifest: DataFrame, buckets: int) -> None:
    dealt = rows.withColumn("_bucket", _bucket(F.col(key), buckets))
    dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows/_version={version}")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def build(spark: SparkSession, view: View, key: str, path: str, *, buckets: int = 64) -> None:
    """The whole view, as the first version."""
    if _versions(spark, path):
        raise ValueError(f"{path} has a view already: refresh it")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("version"))
    _write(view(lambda df, _: df), key, path, 0, every, buckets)


def changed(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """(old row or null, new row or null) of ids whose rows differ; an id stands once in a table."""
    names = old.columns
    a = old.select(F.struct(*names).alias("old"))
    b = new.select(F.struct(*names).alias("new"))
    return a.join(b, F.col(f"old.{id_col}") == F.col(f"new.{id_col}"), "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def refresh(spark: SparkSession, view: View, key: str, path: str, changes: list[tuple[DataFrame, DataFrame, str]]) -> int:
    """Bring the stored view to the new tables; how many buckets were worked out again.

    ``changes`` lists (old table, new table, column that holds the view's key); ``view`` reads the new tables.
    """
    now = _versions(spark, path)[-1]
    manifest = _manifest(spark, path, now)
    buckets = manifest.count()
    keys = [changed(old, new).select(F.explode(F.array(f"old.{col}", f"new.{col}")).alias("k")) for old, new, col in changes]
    reached = reduce(DataFrame.unionByName, keys).filter("k is not null").select(_bucket(F.col("k"), buckets).alias("b")).distinct()
    reached = [r[0] for r in reached.collect()]  # as many as there are buckets at most
    if not reached:
        return 0
    rows = view(lambda df, col: df.filter(_bucket(F.col(col), buckets).isin(*reached)))
    _write(rows, key, path, now + 1, manifest.withColumn("version", F.when(F.col("bucket").isin(*reached), now + 1).otherwise(F.col("version"))), buckets)
    return len(reached)


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The view's rows as of its last refresh."""
    reader = spark.read.schema(f"{schema}, _version int, _bucket int") if schema else spark.read
    rows = reader.parquet(f"{path}/rows")
    manifest = _manifest(spark, path, _versions(spark, path)[-1])
    return rows.join(F.broadcast(manifest), (F.col("_bucket") == F.col("bucket")) & (F.col("_version") == F.col("version"))).drop("_bucket", "_version", "bucket", "version")
