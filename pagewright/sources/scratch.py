"""Tables in a folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path that driver and executors share.

    It lies below ``spark.checkpoint.dir``, or the folder that the context's
    setCheckpointDir() was given.  Only where neither is set and all runs in this
    process (a local master) is a temporary folder made, which goes when Python
    ends; on a cluster that is an error, as each machine would have its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to a shared folder and read again: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
