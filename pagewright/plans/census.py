"""Queries over page images of documents: geometry, kinds, bytes, digests, pairs, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import fnv1a64
from ..operators import census as ops
from ..sources.images import geometry, pages, text_images

#: Bytes of a page of a text image, and of a stride.
TEXT_PAGE, STRIDE = 64, 128


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_images(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(images(spark, sf_dir), TEXT_PAGE, short_last=True)


#: DuckDB: images, pages with hex digits, and a byte of a page's digits.
D = "d AS (SELECT doc_id AS image_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS length FROM documents)"
P = f"""{D}, p AS (SELECT image_id, page, substr(h, (2 * {TEXT_PAGE} * page + 1)::BIGINT, 2 * {TEXT_PAGE}) AS x
  FROM (SELECT image_id, hex(b) AS h, unnest(range(0, (length + {TEXT_PAGE} - 1) // {TEXT_PAGE})) AS page FROM d))"""


def byte_of(x: str, at: int | str) -> str:
    return f"('0x' || nullif(substr({x}, (2 * ({at}) + 1)::BIGINT, 2), ''))::INT"


KIND = """CASE WHEN page = 0 AND v = 0 THEN 'database_definition' WHEN page > 0 AND v = 1 THEN 'data' WHEN page > 0 AND v = 2 THEN 'table_definition'
  WHEN page > 0 AND v = 3 THEN 'intermediate_index' WHEN page > 0 AND v = 4 THEN 'leaf_index' WHEN page > 0 AND v = 5 THEN 'extended_usage_bitmap' ELSE 'unknown' END"""


def page_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind and, where unknown, first byte."""
    return ops.kind_histogram(text_pages(spark, sf_dir))


def page_kind_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named kinds, unknown ones and the total of each image."""
    snap = ops.kind_snapshot(text_pages(spark, sf_dir))
    return snap.select("image_id", "data", "database_definition", F.size("unknown").cast("long").alias("n_unknown_tags"), "page_count", "adds_up")


def page_geometry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages of an image, or partial_page."""
    return images(spark, sf_dir).select("image_id", "length", *[v.alias(k) for k, v in geometry(F.col("length"), TEXT_PAGE).items()])


def first_byte_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes of pages, and how many of those pages have 1 as second byte (code points below 256 only need ASCII here: 'e')."""
    return ops.first_bytes(text_pages(spark, sf_dir))


def stride_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes at each multiple of the stride."""
    found = ops.stride_bytes(images(spark, sf_dir), STRIDE)
    return found.select("image_id", F.col("n_samples").cast("long").alias("n_samples"), F.size("distinct_bytes").cast("long").alias("n_distinct"), F.array_min("distinct_bytes").alias("least"), F.array_max("distinct_bytes").alias("most"))


def page_digest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different page once, with its number of copies."""
    return ops.distinct_blobs(text_pages(spark, sf_dir)).select("sha256", "n_pages")


def new_page_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the images with odd ids that no image with an even id has."""
    every = text_pages(spark, sf_dir)
    store = ops.page_digests(every.where("image_id % 2 = 0")).select("sha256").distinct()
    return ops.new_blobs(every.where("image_id % 2 = 1"), store).select("sha256", "n_pages")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image beside the next one."""
    every = text_pages(spark, sf_dir)
    return ops.page_pairs(every, every.withColumn("image_id", F.col("image_id") - 1), "image_id")


_PAIRS = f"{P}, q AS (SELECT a.image_id, a.page, a.x AS l, b.x AS r FROM p a JOIN p b ON b.image_id = a.image_id + 1 AND b.page = a.page)"


def page_pair_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First byte of a page by that of the next image's page at its place."""
    return ops.page_transitions(_pairs(spark, sf_dir))


def page_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal and changed pages of neighbouring images."""
    return ops.pair_summary(_pairs(spark, sf_dir), "image_id")


def changed_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages change at each offset."""
    return ops.changed_offsets(_pairs(spark, sf_dir))


def page_pair_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that differ from the next image's, or that one of the two lacks."""
    every = text_pages(spark, sf_dir)
    ids = images(spark, sf_dir).where("length > 0").select("image_id").distinct()
    left = every.join(ids.select((F.col("image_id") - 1).alias("image_id")), "image_id", "left_semi")
    right = every.withColumn("image_id", F.col("image_id") - 1).join(ids, "image_id", "left_semi")
    return ops.outer_diff(left, right, "image_id").drop("extra_bytes")


def image_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole images, rebuilt from their pages in order and compared."""
    whole = images(spark, sf_dir).select("image_id", F.sha2("content", 256).alias("sha256"))
    again = ops.rebuilt(text_pages(spark, sf_dir)).select("image_id", F.col("sha256").alias("rebuilt"), "length")
    return whole.join(again, "image_id").select("image_id", "sha256", "length", (F.col("sha256") == F.col("rebuilt")).alias("same"))


def fnv1a64_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit FNV-1a of every whole image; a fold over bytes, which SQL has no fast form of: held against plain Python."""
    return images(spark, sf_dir).select("image_id", fnv1a64(F.col("content")).alias("fnv1a64"))


def probe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-scan ceilings of each image: bytes, then pages, then exact work."""
    shaped = images(spark, sf_dir).withColumn("page_count", F.ceil(F.col("length") / TEXT_PAGE))
    code = ops.scan_ceiling(F.col("length"), F.col("page_count"), 4096, 40)
    return shaped.select("image_id", code.alias("error_code"), F.when(code.isNull(), F.col("page_count") * TEXT_PAGE + F.col("page_count")).alias("work_units"))


def mask_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit masks of the offsets where a page of an image differs from the next image's at its place."""
    from ..functions.bytes import differing

    offs = _pairs(spark, sf_dir).where("left_raw <> right_raw").select("image_id", "page", differing(F.col("left_raw"), F.col("right_raw")).alias("offs")).where("size(offs) > 0")
    return ops.mask_of(offs, TEXT_PAGE, "image_id", "page").select("image_id", "page", F.col("bit_count").cast("long").alias("bit_count"), "first_off", "last_off", F.lower(F.hex("mask")).alias("mask"))


QUERIES = {
    f.__name__: f
    for f in (
        page_kind_histogram, page_kind_snapshot, page_geometry_check, first_byte_census, stride_bytes, page_digest_dedupe, new_page_blobs, page_pair_transitions,
        page_pair_summary, changed_byte_offsets, page_pair_outer_diff, image_sha256, fnv1a64_per_image, probe_scan, mask_records,
    )
}

SQL = {
    "page_kind_histogram": f"WITH {P}, k AS (SELECT {KIND} AS kind, v FROM (SELECT page, {byte_of('x', 0)} AS v FROM p)) SELECT kind, CASE WHEN kind = 'unknown' THEN v END AS tag, count(*) AS n_pages FROM k GROUP BY ALL",
    "page_kind_snapshot": f"""WITH {P}, k AS (SELECT image_id, {KIND} AS kind, v FROM (SELECT image_id, page, {byte_of('x', 0)} AS v FROM p))
      SELECT image_id, count(*) FILTER (kind = 'data') AS data, count(*) FILTER (kind = 'database_definition') AS database_definition,
        count(DISTINCT CASE WHEN kind = 'unknown' THEN v END) AS n_unknown_tags, count(*) AS page_count, true AS adds_up FROM k GROUP BY image_id""",
    "page_geometry_check": f"WITH {D} SELECT image_id, length, CASE WHEN length % {TEXT_PAGE} = 0 THEN length // {TEXT_PAGE} END AS page_count, CASE WHEN length % {TEXT_PAGE} <> 0 THEN 'partial_page' END AS error_code FROM d",
    "first_byte_census": f"WITH {P} SELECT {byte_of('x', 0)} AS first, count(*) AS n_pages, count(*) FILTER ({byte_of('x', 1)} = 1) AS second_is_one FROM p GROUP BY 1",
    "stride_bytes": f"""WITH {D}, s AS (SELECT image_id, {byte_of('h', 'o')} AS v FROM (SELECT image_id, hex(b) AS h, unnest(range(0, length, {STRIDE})) AS o FROM d))
      SELECT image_id, count(*) AS n_samples, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS most FROM s GROUP BY image_id""",
    "page_digest_dedupe": f"WITH {P} SELECT sha256(unhex(x)) AS sha256, count(*) AS n_pages FROM p GROUP BY 1",
    "new_page_blobs": f"WITH {P} SELECT sha256(unhex(x)) AS sha256, count(*) AS n_pages FROM p WHERE image_id % 2 = 1 AND x NOT IN (SELECT x FROM p WHERE image_id % 2 = 0) GROUP BY 1",
    "page_pair_transitions": f"WITH {_PAIRS} SELECT {byte_of('l', 0)} AS left_first, {byte_of('r', 0)} AS right_first, count(*) AS n_pages FROM q GROUP BY 1, 2",
    "page_pair_summary": f"WITH {_PAIRS} SELECT image_id, count(*) FILTER (l = r) AS equal_pages, count(*) FILTER (l <> r) AS changed_pages FROM q GROUP BY image_id",
    "changed_byte_offsets": f"""WITH {_PAIRS}, o AS (SELECT l, r, unnest(range(0, least(length(l), length(r)) // 2)) AS off FROM q WHERE l <> r)
      SELECT off::INT AS off, count(*) AS n_changed FROM o WHERE substr(l, 2 * off + 1, 2) <> substr(r, 2 * off + 1, 2) GROUP BY 1""",
    "page_pair_outer_diff": f"""WITH {P}, ids AS (SELECT DISTINCT image_id FROM p),
      a AS (SELECT * FROM p WHERE image_id + 1 IN (FROM ids)), b AS (SELECT image_id - 1 AS image_id, page, x FROM p WHERE image_id - 1 IN (FROM ids)),
      f AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.page, b.page) AS page, a.x AS l, b.x AS r FROM a FULL JOIN b ON a.image_id = b.image_id AND a.page = b.page),
      g AS (SELECT *, list_filter(range(0, least(length(l), length(r)) // 2), lambda o: substr(l, 2 * o + 1, 2) <> substr(r, 2 * o + 1, 2)) AS spots FROM f WHERE l IS DISTINCT FROM r)
      SELECT image_id, page, CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'changed' END AS status,
        CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN len(spots)::INT END AS n_diff, list_min(spots)::INT AS first_diff, list_max(spots)::INT AS last_diff FROM g""",
    "image_sha256": f"WITH {D} SELECT image_id, sha256(b) AS sha256, length, true AS same FROM d WHERE length > 0",
    "probe_scan": f"""WITH {D}, g AS (SELECT *, (length + {TEXT_PAGE} - 1) // {TEXT_PAGE} AS n FROM d), c AS (SELECT *, CASE WHEN length > 4096 THEN 'scan_byte_limit_exceeded' WHEN n > 40 THEN 'scan_page_limit_exceeded' END AS error_code FROM g)
      SELECT image_id, error_code, CASE WHEN error_code IS NULL THEN n * {TEXT_PAGE} + n END AS work_units FROM c""",
    "mask_records": f"""WITH {_PAIRS}, o AS (SELECT image_id, page, list_filter(range(0, least(length(l), length(r)) // 2), lambda o: substr(l, 2 * o + 1, 2) <> substr(r, 2 * o + 1, 2)) AS spots FROM q WHERE l <> r)
      SELECT image_id, page, len(spots)::BIGINT AS bit_count, list_min(spots)::INT AS first_off, list_max(spots)::INT AS last_off,
        list_aggregate(list_transform(range(0, {TEXT_PAGE // 8}), lambda b: lower(printf('%02x', list_sum(list_transform(list_filter(spots, lambda o: o // 8 = b), lambda o: (1 << (o % 8)::INT)::BIGINT) || [0::BIGINT])::BIGINT))), 'string_agg', '') AS mask
      FROM o WHERE len(spots) > 0""",
}
