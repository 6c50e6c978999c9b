"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; it goes when the application ends."""
    context = spark.sparkContext
    top = getattr(context, "_pulsegrid_kept", None)
    if top is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not shared:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="shared-")
        top = f"{shared.rstrip('/')}/pulsegrid-kept-{uuid.uuid4().hex[:12]}"
        path = context._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._pulsegrid_kept = top
    return f"{top}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table below ``spark.checkpoint.dir`` (in local mode a temporary folder where that is unset).

    A table has its real size, whereas a checkpoint keeps estimates that multiply with every join of a loop.
    """
    where = folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
