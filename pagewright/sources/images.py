"""Byte images and their pages.

An image is a row (image_id, length, content); a page is a row (image_id, page,
raw) of ``page_size`` bytes.  Pages are cut in the projection that reads the
image: no shuffle, and a page carries its own bytes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: bytes of a page in the physical format.
PAGE_SIZE = 2048


def binary_images(spark: SparkSession, path: str) -> DataFrame:
    """Files below path as images; the captured length is the file's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_id"), "length", "content")


def text_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in UTF-8 as images: real bytes where no database files are at hand."""
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.col(key).alias("image_id"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def geometry(length: Column, page_size: int) -> dict[str, Column]:
    """page_count and error_code: zero_page_size comes before partial_page."""
    if page_size == 0:
        return {"page_count": F.lit(None).cast("long"), "error_code": F.lit("zero_page_size")}
    whole = length % page_size == 0
    return {
        "page_count": F.when(whole, F.floor(length / page_size)).cast("long"),
        "error_code": F.when(~whole, F.lit("partial_page")),
    }


def pages(images: DataFrame, page_size: int = PAGE_SIZE, *, short_last: bool = False) -> DataFrame:
    """(image_id, page, raw) of every image; images with a partial page give none, unless short_last."""
    size = F.lit(page_size).cast("long")
    count = F.ceil(F.col("length") / size) if short_last else F.when(F.col("length") % size == 0, F.floor(F.col("length") / size))
    count = count.cast("long")
    numbers = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
    cut = images.select("image_id", "content", F.explode(numbers).alias("page"))
    return cut.select("image_id", "page", F.substring("content", (F.col("page") * page_size + 1).cast("int"), F.lit(page_size)).alias("raw"))


def byte(raw: Column, at: Column | int) -> Column:
    """The byte at a zero-based place as an int; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
