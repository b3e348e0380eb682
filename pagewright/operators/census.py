"""Whole-image counts, digests and page comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import differing, fnv1a64, swapped
from ..sources.images import byte
from .kinds import page_kind


def kind_histogram(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages by kind and, where unknown, by first byte."""
    kind, tag = page_kind(F.col("page"), byte(F.col("raw"), 0))
    return pages.select(*keys, kind.alias("kind"), tag.alias("tag")).groupBy(*keys, "kind", "tag").agg(F.count(F.lit(1)).alias("n_pages"))


def classified(pages: DataFrame) -> DataFrame:
    kind, tag = page_kind(F.col("page"), byte(F.col("raw"), 0))
    return pages.withColumns({"kind": kind, "tag": tag})


def kind_snapshot(pages: DataFrame) -> DataFrame:
    """One row an image: counts of the named kinds, a map of unknown first bytes, the total, and whether they add up."""
    counts = kind_histogram(pages, "image_id")
    named = ("database_definition", "data", "table_definition", "intermediate_index", "leaf_index", "extended_usage_bitmap")
    unknown = F.sort_array(F.collect_list(F.when(F.col("kind") == "unknown", F.struct("tag", "n_pages"))))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n_pages")).otherwise(0)).alias(k) for k in named]
    rows = counts.groupBy("image_id").agg(*sums, unknown.alias("unknown"), F.sum("n_pages").alias("page_count"))
    total = sum((F.col(k) for k in named), F.aggregate("unknown", F.lit(0).cast("long"), lambda a, x: a + x["n_pages"]))
    return rows.withColumn("adds_up", total == F.col("page_count"))


def first_bytes(pages: DataFrame) -> DataFrame:
    """First byte by value; how many pages have it, and how many of those have 1 as second byte."""
    two = pages.select(byte(F.col("raw"), 0).alias("first"), byte(F.col("raw"), 1).alias("second"))
    return two.groupBy("first").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("second") == 1).alias("second_is_one"))


def stride_bytes(images: DataFrame, stride: int) -> DataFrame:
    """The byte at each multiple of the stride, by image: how many, distinct ones in order, those not zero."""
    last = F.col("length") - 1
    places = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")))
    sampled = images.select("image_id", F.transform(places, lambda i: byte(F.col("content"), i)).alias("v")).where("v is not null")
    return sampled.select("image_id", F.size("v").alias("n_samples"), F.sort_array(F.array_distinct("v")).alias("distinct_bytes"), F.size(F.filter("v", lambda x: x != 0)).alias("n_nonzero"))


def page_digests(pages: DataFrame) -> DataFrame:
    return pages.withColumn("sha256", F.sha2("raw", 256))


def distinct_blobs(pages: DataFrame) -> DataFrame:
    """(sha256, raw, n_pages): each different page once.

    Digests are counted with map-side sums, so copies of a page meet as counts.
    """
    return page_digests(pages).groupBy("sha256").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n_pages"))


def new_blobs(pages: DataFrame, store: DataFrame, max_blobs: int | None = None) -> DataFrame:
    """Blobs that the store lacks; with a ceiling, error_code says that the store would pass it."""
    fresh = distinct_blobs(pages).join(store.select("sha256"), "sha256", "left_anti")
    if max_blobs is None:
        return fresh
    counts = fresh.agg(F.count(F.lit(1)).alias("n_new")).join(store.agg(F.count(F.lit(1)).alias("n_old")))
    return fresh.join(counts).withColumn("error_code", F.when(F.col("n_new") + F.col("n_old") > max_blobs, "blob_ceiling")).drop("n_new", "n_old")


def image_digests(images: DataFrame) -> DataFrame:
    """SHA-256 and FNV-1a of whole images: ordered folds, one task an image."""
    return images.select("image_id", "length", F.sha2("content", 256).alias("sha256"), fnv1a64(F.col("content")).alias("fnv1a64"))


def page_pairs(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Pages of both images at one place, where both have it."""
    a = left.select(*keys, "page", F.col("raw").alias("left_raw"))
    b = right.select(*keys, "page", F.col("raw").alias("right_raw"))
    return a.join(b, [*keys, "page"])


def page_transitions(pairs: DataFrame) -> DataFrame:
    """First byte of the left page by that of the right."""
    return pairs.groupBy(byte(F.col("left_raw"), 0).alias("left_first"), byte(F.col("right_raw"), 0).alias("right_first")).agg(F.count(F.lit(1)).alias("n_pages"))


def pair_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """Equal and changed pages."""
    equal = F.col("left_raw") == F.col("right_raw")
    return pairs.groupBy(*keys).agg(F.count_if(equal).alias("equal_pages"), F.count_if(~equal).alias("changed_pages"))


def changed_offsets(pairs: DataFrame) -> DataFrame:
    """How many pages change at each offset; equal pages are left out before their bytes are compared."""
    return (
        pairs.where("left_raw <> right_raw")
        .select(F.explode(differing(F.col("left_raw"), F.col("right_raw"))).alias("off"))
        .groupBy("off")
        .agg(F.count(F.lit(1)).alias("n_changed"))
    )


def outer_diff(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Every page that differs or that one side lacks, with its differing bytes within the common length."""
    a = left.select(*keys, "page", F.col("raw").alias("left_raw"))
    b = right.select(*keys, "page", F.col("raw").alias("right_raw"))
    both = a.join(b, [*keys, "page"], "full").where(~F.col("left_raw").eqNullSafe(F.col("right_raw")))
    at = F.when(F.col("left_raw").isNotNull() & F.col("right_raw").isNotNull(), differing(F.col("left_raw"), F.col("right_raw")))
    return both.select(
        *keys,
        "page",
        F.when(F.col("left_raw").isNull(), "right_only").when(F.col("right_raw").isNull(), "left_only").otherwise("changed").alias("status"),
        F.size(at).alias("n_diff"),
        F.array_min(at).alias("first_diff"),
        F.array_max(at).alias("last_diff"),
        (F.coalesce(F.octet_length("left_raw"), F.lit(0)) - F.coalesce(F.octet_length("right_raw"), F.lit(0))).alias("extra_bytes"),
    ).withColumn("n_diff", F.when(F.col("status") == "changed", F.col("n_diff")))


def scan_ceiling(length: Column, page_count: Column, max_bytes: int, max_pages: int) -> Column:
    """Why a whole scan is refused: bytes first, then pages."""
    return F.when(length > max_bytes, "scan_byte_limit_exceeded").when(page_count > max_pages, "scan_page_limit_exceeded")


def probe(images: DataFrame, *, page_size: int, max_bytes: int, max_pages: int) -> DataFrame:
    """One row an image: kind, pages, digest and exact work of a whole scan, or the code of what refused it."""
    from .decode import candidates

    found = candidates(images, page_size=page_size, max_bytes=max_bytes)
    code = F.coalesce("error_code", scan_ceiling(F.col("length"), F.col("page_count"), max_bytes, max_pages))
    found = found.withColumn("error_code", code)
    sound = F.col("error_code").isNull()
    return found.select(
        "image_id",
        "length",
        "kind",
        F.when(sound, F.col("page_count")).alias("pages_visited"),
        F.when(sound, F.col("length") + F.col("page_count")).alias("work_units"),
        F.when(sound, fnv1a64(F.col("content"))).alias("fnv1a64"),
        "error_code",
    )


def masked(offsets: DataFrame, length: int, *keys: str) -> DataFrame:
    """Offsets packed into a bit mask, lowest bit first, with its record: bit_count, first, last, sha256.

    A mask has at most ``length`` bits, so a group is bounded by it.
    """
    return mask_of(offsets.groupBy(*keys).agg(F.sort_array(F.collect_set("off")).alias("offs")), length, *keys)


def mask_of(grouped: DataFrame, length: int, *keys: str) -> DataFrame:
    """masked() of rows that have their different offsets as an array, offs."""
    size = (length + 7) // 8
    none = F.lit(0).cast("long")
    bit = lambda o: F.call_function("shiftleft", F.lit(1).cast("long"), (o % 64).cast("int"))
    by_word = F.transform(
        F.sequence(F.lit(0), F.lit((size - 1) // 8)),
        lambda w: swapped(F.lpad(F.hex(F.aggregate(F.filter("offs", lambda o: F.floor(o / 64) == w), none, lambda a, o: a.bitwiseOR(bit(o)))), 16, "0"), 8),
    )
    mask = F.unhex(F.substring(F.array_join(by_word, ""), 1, 2 * size))
    return grouped.withColumn("mask", mask).select(
        *keys, F.size("offs").alias("bit_count"), F.array_min("offs").alias("first_off"), F.array_max("offs").alias("last_off"), F.sha2("mask", 256).alias("sha256"), "mask"
    )


def touched_pages(offsets: DataFrame, page_size: int, *keys: str) -> DataFrame:
    return offsets.select(*keys, F.floor(F.col("off") / page_size).alias("page")).distinct()


def rebuilt(pages: DataFrame) -> DataFrame:
    """(image_id, sha256, length): an image's digest from its pages in order.

    An image is one value of bounded size, so its pages meet in one task by need.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", F.hex("raw").alias("x")))), lambda p: p["x"])
    whole = F.unhex(F.array_join(ordered, ""))
    return pages.groupBy("image_id").agg(whole.alias("content")).select("image_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("length"))


