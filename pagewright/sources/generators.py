"""Deterministic inputs: bytes, probe images, page histories.

Whole-number arithmetic on ``range`` only, so another engine can make the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import PAGE_SIZE


def packed_bytes(n: int, value) -> Column:
    """A binary of n bytes; value(i) gives the byte at place i as a column."""
    one = lambda i: F.lpad(F.hex(value(i).cast("long")), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), ""))


def rotated(i: Column) -> Column:
    """The low byte of i * 0x9e3779b97f4a7c15 rotated left by 17: bits 47 to 54 of the product.

    Products of longs may overflow, so the constant's low 55 bits are multiplied
    in two parts, each kept below 2**55.
    """
    low, high = 0x9E3779B97F4A7C15 & 0x7FFFFFF, (0x9E3779B97F4A7C15 >> 27) & 0xFFFFFFF
    i = i.cast("long").bitwiseAND(F.lit(0x3FFFFFFF).cast("long"))
    part = i * low + F.shiftleft((i * high).bitwiseAND(F.lit(0xFFFFFFF).cast("long")), 27)
    return F.shiftright(part, 47).bitwiseAND(F.lit(255).cast("long"))


def random_bytes(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Images of the bench sizes."""
    rows = spark.createDataFrame([(f"bytes-{n}", n) for n in sizes], "image_id string, length long")
    content = lambda n: packed_bytes(n, rotated)
    out = F.lit(None).cast("binary")
    for n in sizes:
        out = F.when(F.col("length") == n, content(n)).otherwise(out)
    return rows.withColumn("content", out)


def probe_images(spark: SparkSession, page_counts: list[int], page_size: int = PAGE_SIZE) -> DataFrame:
    """Images that start with a standard signature at byte 4; from byte 19 on, byte i is i mod 251."""
    rows = spark.createDataFrame([(f"probe-{n}", n) for n in page_counts], "image_id string, n long")
    text = F.concat(F.unhex(F.lit("00000000")), F.lit(b"Standard Jet DB"))
    out = F.lit(None).cast("binary")
    for n in page_counts:
        rest = packed_bytes(n * page_size, lambda i: i % 251)
        out = F.when(F.col("n") == n, F.concat(text, F.substring(rest, 20, 2**31 - 1)) if n else F.lit(b"")).otherwise(out)
    return rows.select("image_id", out.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def observations(spark: SparkSession, n_bytes: int, value, *, versions: int = 3, replicas: int = 6, phases: tuple[str, ...] = ("creator", "reopen")) -> DataFrame:
    """(condition, version, encryption, replica, phase, prefix): conditions version x encryption, byte i from value(version, encrypted, replica, phase, i)."""
    grid = spark.range(versions * 2 * replicas * len(phases)).select(
        F.col("id").cast("int").alias("n"),
    )
    p = F.col("n") % len(phases)
    r = F.floor(F.col("n") / len(phases)).cast("int") % replicas + 1
    c = F.floor(F.col("n") / (len(phases) * replicas)).cast("int")
    named = grid.select(c.alias("condition"), F.floor(c / 2).cast("int").alias("version"), (c % 2).alias("encryption"), r.alias("replica"), p.alias("p"))
    prefix = packed_bytes(n_bytes, lambda i: value(F.col("version"), F.col("encryption"), F.col("replica"), F.col("p"), i))
    phase = F.element_at(F.array(*map(F.lit, phases)), (F.col("p") + 1).cast("int"))
    return named.withColumn("prefix", prefix).select("condition", "version", "encryption", "replica", phase.alias("phase"), "prefix")


def page_history(spark: SparkSession, n_replicas: int, checkpoints: list[str], n_pages: int, value) -> DataFrame:
    """page_index (replica, ordinal, checkpoint, page, sha256) where value(replica, ordinal, page) names a page's state; a null state is a missing page."""
    rows = spark.range(n_replicas * len(checkpoints) * n_pages).select(
        (F.floor(F.col("id") / (len(checkpoints) * n_pages)) + 1).cast("int").alias("replica"),
        (F.floor(F.col("id") / n_pages) % len(checkpoints)).cast("int").alias("ordinal"),
        (F.col("id") % n_pages).alias("page"),
    )
    state = value(F.col("replica"), F.col("ordinal"), F.col("page")).cast("string")
    name = F.element_at(F.array(*map(F.lit, checkpoints)), F.col("ordinal") + 1)
    return rows.select("replica", "ordinal", name.alias("checkpoint"), "page", F.sha2(state.cast("binary"), 256).alias("sha256")).where("sha256 is not null")
