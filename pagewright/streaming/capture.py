"""Incremental capture of images as a stream of files: each micro-batch against the last known digests.

The state is a written table of (image_id, page, sha256); a batch joins it and
appends what changed.  Batches are numbered, so one that is run again replaces
its own output and reads the state of the batch before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.images import PAGE_SIZE, pages

STATE = "image_id string, page long, sha256 string"


def step(images: DataFrame, state: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(image_id, page, sha256, raw, status): changes of the images in this batch; the others are not touched."""
    now = pages(images, page_size).withColumn("now", F.sha2("raw", 256))
    was = state.join(images.select("image_id").distinct(), "image_id", "left_semi").withColumnRenamed("sha256", "was")
    both = now.join(was, ["image_id", "page"], "full")
    status = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    return both.select("image_id", "page", F.col("now").alias("sha256"), F.when(status != "unchanged", F.col("raw")).alias("raw"), status.alias("status"))


def after(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with a batch's changes."""
    same = state.join(changes.select("image_id", "page"), ["image_id", "page"], "left_anti")
    return same.unionByName(changes.where("status <> 'removed'").select("image_id", "page", "sha256"))


def start(spark: SparkSession, source: str, out: str, *, page_size: int = PAGE_SIZE) -> StreamingQuery:
    """Watch a folder of images; below out: changes/batch=N, state/N, checkpoint."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    images = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("image_id"), "length", "content")

    def run(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        state = own.read.schema(STATE).parquet(f"{out}/state/{number - 1}") if number else own.createDataFrame([], STATE)
        step(batch, state, page_size).write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        changes = own.read.parquet(f"{out}/changes/batch={number}")
        after(state, changes).write.mode("overwrite").parquet(f"{out}/state/{number}")

    return images.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
