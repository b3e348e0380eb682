"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import scratch as folders
from ..sources.scratch import forget, scratch

__all__ = ["BATCH_ROWS", "SPACE", "WORD", "by_batch", "forget", "held_out", "hot_join", "scratch", "spread", "stored", "temporary"]

#: A word is a run of anything but space and the ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Rows and bytes in one Arrow batch: they bound a Python worker's memory, but for a single longer row.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


#: Bytes for each core up to which a table of few files is dealt out anew.
SMALL_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of few small files dealt over all cores, as a file's row group is one task's.

    Others stay as they are: a table with as many files as cores, or with more
    than SMALL_BYTES for each core, has enough tasks of its own.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if size <= cores * SMALL_BYTES else df


#: Tables that stored() has written since the innermost temporary() began, if one has.
_written: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to a shared folder and read again: cuts the lineage."""
    table = folders.stored(df, name, codec)
    if _written:
        _written[-1].append(table)
    return table


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """A list of tables to keep: all others that stored() writes meanwhile are deleted at the end, when nothing reads them."""
    _written.append([])
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        made = _written.pop()
        for table in made:
            if not any(table is k for k in keep):
                forget(table)
            elif _written:
                _written[-1].append(table)


#: Rows of one key from which it is joined apart.
HOT_ROWS = 1000


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], *, most: int = 1_000_000, counts: str | None = None, keep: list[DataFrame] | None = None) -> DataFrame:
    """Inner join of rows with a table that has one row a key, without all rows of a hot key meeting in one task.

    Keys of more than HOT_ROWS rows, and of more than a share of 1 / ``most`` of
    all, are looked up by broadcast (fewer than ``most`` table rows); the others are
    joined by shuffle.  ``counts`` names a column of the table with the number of
    rows a key has (it is left out); otherwise they are counted.  The table is
    written, and noted in ``keep``.
    """
    if counts is None:
        counts = "hot_rows"
        table = table.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(counts)), keys)
    table = stored(table, "hot-table")
    if keep is not None:
        keep.append(table)
    total, largest = table.agg(F.sum(counts), F.max(counts)).first()
    bar = max(HOT_ROWS, (total or 0) // most)
    plain = rows.join(table.drop(counts), keys)
    if (largest or 0) <= bar:
        return plain
    hot = F.broadcast(table.where(F.col(counts) > bar).drop(counts))
    rest = rows.join(hot, keys, "left_anti").join(table.where(F.col(counts) <= bar).drop(counts), keys)
    return rows.join(hot, keys).unionByName(rest)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32(id as text) mod 3 is 1."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (crc % 3) == 1


def by_batch(df: DataFrame, make, schema: str | StructType) -> DataFrame:
    """mapInArrow with a function that is built once in each task.

    ``make()`` returns a function from a RecordBatch to a dict of columns with
    the names of ``schema`` (or to None for no rows); after a task's batches it
    is called with None if it has an attribute ``last``.  Texts vary from a word to
    megabytes, so the session's batches are set to BATCH_ROWS rows and BATCH_BYTES
    bytes (Spark reads these settings when it plans, so they stay set).
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema)

    def column(values, kind: pa.DataType) -> pa.Array:
        if isinstance(values, pa.Array):
            return values if values.type.equals(kind) else values.cast(kind)
        return pa.array(values, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def made(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield made(out)
        if hasattr(work, "last"):
            yield made(work(None))

    return df.mapInArrow(run, schema)
