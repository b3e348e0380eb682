"""Queries over decoders, on images and records that arithmetic makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import read_int, read_uint, set_bits, write_int
from ..operators import decode as ops
from ..sources.generators import packed_bytes


def signature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature by nation key: the three known, a near miss and a short image."""
    texts = [b"Standard Jet DB", b"Jet System DB 1", b"Temp Jet DB xyz", b"Standard Jet DC", b"Temp"]
    image = F.element_at(F.array(*[F.lit(b"\0\1\0\0" + t) for t in texts]), F.col("n_nationkey") % 5 + 1)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("image_id"), image.alias("content"))
    found = ops.candidates(nations.withColumn("length", F.octet_length("content").cast("long")), page_size=1, max_bytes=100)
    return found.select("image_id", "kind", "error_code")


def _slot(i):
    """A slot's bytes by its index: writing, corrupted, or its index."""
    return F.when(i % 7 == 0, F.lit("0000")).when(i % 7 == 1, F.lit("0100")).otherwise(F.lpad(F.hex(i % 256), 4, "0"))


def commit_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of a page zero: role, ordinal and class."""
    region = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: _slot(i)), ""))
    page = F.concat(F.unhex(F.repeat(F.lit("00"), ops.SLOTS_AT)), region)
    zero = spark.range(1).select(F.lit("image").alias("image_id"), F.lit(0).alias("page"), page.alias("raw"))
    return ops.commit_slots(zero)


def inline_bitmap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys as start page and bitmap of an inline map: each set bit's page, or why it is none."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    record = F.concat(F.unhex(F.lit("00")), write_int(F.col("id"), 4), write_int(F.col("id") * 2654435761 % 65536, 2))
    parts = suppliers.select("id", record.alias("record")).select("id", ops.allocation_map(F.col("record")).alias("m"))
    found = parts.select("id", F.explode(ops.inline_pages(F.col("m.start_page"), F.col("m.bitmap"), F.lit(90).cast("long"))).alias("p"))
    return found.select("id", "p.page", "p.error_code")


def indirect_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as raw references of an indirect map: zeros and repeats stay."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    record = F.concat(F.unhex(F.lit("01")), write_int(F.col("id"), 4), write_int(F.col("id") * 0, 4), write_int(F.col("id") % 1000, 4))
    maps = orders.select("id", record.alias("record")).select("id", ops.allocation_map(F.col("record")).alias("m"))
    found = maps.select("id", F.explode(ops.map_references(F.col("m.refs"))).alias("r"))
    return found.select("id", "r.slot", "r.page")


def allocation_map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with records of each type and size."""
    sizes = spark.range(0, 60).select(F.col("id"), (F.col("id") % 12).cast("int").alias("n"), F.floor(F.col("id") / 12).cast("int").alias("kind"))
    record = F.unhex(F.when(F.col("n") > 0, F.concat(F.lpad(F.hex("kind"), 2, "0"), F.repeat(F.lit("0A"), F.col("n") - 1))).otherwise(""))
    return sizes.select("id", record.alias("record")).select("id", ops.allocation_map(F.col("record")).alias("m")).select("id", "m.map_type", F.size("m.refs").alias("n_refs"), "m.error_code").withColumn("n_refs", F.when(F.col("map_type") == "indirect", F.col("n_refs")))


def little_endian_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 2, 4 and 8 bytes, unsigned and signed, written and read again."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    value = F.col("id") * 1234567 - 500000000
    raw = F.concat(write_int(value, 8), write_int(value.bitwiseAND(65535), 2))
    made = parts.select("id", raw.alias("raw"))
    return made.select("id", read_int(F.col("raw"), 0, 8).alias("i64"), read_uint(F.col("raw"), 0, 4).alias("u32"), read_int(F.col("raw"), 0, 4).alias("i32"), read_uint(F.col("raw"), 8, 2).alias("u16"), read_int(F.col("raw"), 8, 2).alias("i16"))


def pointer_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as four-byte pointers in both layouts, with the pages that the six base formulas give."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), write_int(F.col("p_partkey") * 65537 % 4294967296, 4).alias("raw"))
    both = parts.select("id", "raw", F.explode(F.array(*map(F.lit, ops.POINTER_LAYOUTS))).alias("layout"))
    page = lambda n: ops.pointer(F.col("raw"), n)
    first, second = ops.POINTER_LAYOUTS
    p = F.when(F.col("layout") == first, page(first)).otherwise(page(second))
    placed = both.select("id", "layout", p["page"].alias("page"), p["slot"].alias("slot"))
    return placed.select("*", F.explode(F.array(*map(F.lit, ops.BASE_FORMULAS))).alias("formula")).withColumn("base", ops.extended_base(F.col("formula"), F.col("slot"), F.col("page")))


def extended_page_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative bits of extended pages: header of four bytes, first byte 5."""
    raw = F.concat(F.unhex(F.lit("05000000")), packed_bytes(8, lambda i: (F.col("id") * 31 + i * 7) % 256))
    rows = spark.range(50).select("id", raw.alias("raw"))
    return rows.select("id", F.explode(ops.extended_bits(F.col("raw"))).alias("bit"))


def unused_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear bits of bitmaps, as the other polarity counts them."""
    rows = spark.range(50).select("id", packed_bytes(4, lambda i: (F.col("id") * 37 + i * 11) % 256).alias("raw"))
    return rows.select("id", F.explode(set_bits(F.col("raw"), clear=True)).alias("bit"))


def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as a chain of pages: repeats, range and depth."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    chain = items.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("step"), (F.col("p") % 30).alias("page"))
    return ops.repeated_pages(chain, 28, max_depth=4)


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read requests and the first reason to refuse them: limit, overflow, start, end."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    offset = F.when(F.col("id") % 11 == 0, F.lit(2**63 - 5)).otherwise(F.col("id") % 3000)
    size = (F.col("id") * 7) % 600
    return orders.select("id", ops.checked_request(offset, size, F.lit(2048).cast("long"), F.lit(512).cast("long")).alias("error_code"))


QUERIES = {
    f.__name__: f
    for f in (signature_kinds, commit_slots, inline_bitmap_pages, indirect_references, allocation_map_errors, little_endian_numbers, pointer_layouts, extended_page_bits, unused_bits, chain_walk, read_requests)
}

_BITS = "unnest(list_filter(range(0, {n}), lambda j: (v[(j // 8 + 1)::BIGINT] >> (j % 8)::INT) & 1 = {on}))::INT AS bit"
_BASES = " UNION ALL ".join(
    f"SELECT id, layout, page, slot, '{f}' AS formula, {'slot::BIGINT * 16352' if f.startswith('slot') else 'page'} + {(-1 if f.endswith('minus_one') else 1 if f.endswith('plus_one') else 0)} AS base FROM p"
    for f in ops.BASE_FORMULAS
)

SQL = {
    "signature_kinds": """SELECT n_nationkey AS image_id, CASE n_nationkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'system' WHEN 2 THEN 'temporary' END AS kind,
      CASE n_nationkey % 5 WHEN 3 THEN 'unrecognized_signature' WHEN 4 THEN 'short_read' END AS error_code FROM nation""",
    "commit_slots": """WITH s AS (SELECT i::INT AS idx, CASE i % 7 WHEN 0 THEN '0000' WHEN 1 THEN '0100' ELSE lower(printf('%04x', i % 256)) END AS raw FROM range(0, 256) t(i))
      SELECT 'image' AS image_id, idx, CASE WHEN idx = 0 THEN 'exclusive' ELSE 'shared' END AS role, CASE WHEN idx > 0 THEN idx END AS ordinal, raw,
        CASE raw WHEN '0000' THEN 'physically_writing' WHEN '0100' THEN 'corrupted_page_access' ELSE 'other' END AS class FROM s""",
    "inline_bitmap_pages": """WITH s AS (SELECT s_suppkey AS id, s_suppkey * 2654435761 % 65536 AS w FROM supplier), b AS (SELECT id, w, unnest(range(0, 16)) AS j FROM s)
      SELECT id, id + j AS page, CASE WHEN id + j >= 90 THEN 'page_out_of_range' END AS error_code FROM b WHERE (w >> j::INT) & 1 = 1""",
    "indirect_references": "SELECT o_orderkey AS id, 0 AS slot, o_orderkey AS page FROM orders UNION ALL SELECT o_orderkey, 1, 0 FROM orders UNION ALL SELECT o_orderkey, 2, o_orderkey % 1000 FROM orders",
    "allocation_map_errors": """WITH r AS (SELECT i AS id, (i % 12)::INT AS n, i // 12 AS kind FROM range(0, 60) t(i)),
      e AS (SELECT *, CASE WHEN n = 0 THEN 'empty_record' WHEN kind = 0 AND n < 5 THEN 'inline_record_too_short' WHEN kind = 1 AND (n - 1) % 4 <> 0 THEN 'indirect_payload_misaligned' WHEN kind > 1 THEN 'unsupported_record_type' END AS error_code FROM r)
      SELECT id, CASE WHEN error_code IS NULL THEN CASE kind WHEN 0 THEN 'inline' ELSE 'indirect' END END AS map_type, CASE WHEN error_code IS NULL AND kind = 1 THEN ((n - 1) // 4)::INT END AS n_refs, error_code FROM e""",
    "little_endian_numbers": """WITH v AS (SELECT p_partkey AS id, p_partkey * 1234567 - 500000000 AS x FROM part), u AS (SELECT id, x, x & 4294967295 AS u32, x & 65535 AS u16 FROM v)
      SELECT id, x AS i64, u32, CASE WHEN u32 >= 2147483648 THEN u32 - 4294967296 ELSE u32 END AS i32, u16, CASE WHEN u16 >= 32768 THEN u16 - 65536 ELSE u16 END AS i16 FROM u""",
    "pointer_layouts": f"""WITH v AS (SELECT p_partkey AS id, p_partkey * 65537 % 4294967296 AS x FROM part),
      p AS (SELECT id, 'u24le_page_then_u8_slot' AS layout, x & 16777215 AS page, (x >> 24)::INT AS slot FROM v UNION ALL SELECT id, 'u8_slot_then_u24le_page', x >> 8, (x & 255)::INT FROM v) {_BASES}""",
    "extended_page_bits": f"WITH r AS (SELECT i AS id, list_transform(range(0, 8), lambda k: (i * 31 + k * 7) % 256) AS v FROM range(0, 50) t(i)) SELECT id, {_BITS.format(n=64, on=1)} FROM r",
    "unused_bits": f"WITH r AS (SELECT i AS id, list_transform(range(0, 4), lambda k: (i * 37 + k * 11) % 256) AS v FROM range(0, 50) t(i)) SELECT id, {_BITS.format(n=32, on=0)} FROM r",
    "chain_walk": """WITH i AS (SELECT l_orderkey AS chain, l_linenumber AS step, min(l_partkey) % 30 AS page FROM lineitem GROUP BY 1, 2),
      b AS (SELECT *, CASE WHEN page >= 28 THEN 'page_out_of_range' WHEN row_number() OVER (PARTITION BY chain, page ORDER BY step) > 1 THEN 'repeated_page' END AS bad FROM i),
      d AS (SELECT *, (count(*) FILTER (bad IS NULL) OVER (PARTITION BY chain ORDER BY step))::BIGINT AS depth FROM b)
      SELECT chain, step, page, depth, CASE WHEN bad IS NOT NULL THEN bad WHEN depth > 4 THEN 'depth_exceeded' END AS error_code FROM d""",
    "read_requests": """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 9223372036854775803 ELSE o_orderkey % 3000 END AS o, (o_orderkey * 7) % 600 AS n FROM orders)
      SELECT id, CASE WHEN n > 512 THEN 'read_limit_exceeded' WHEN o > 9223372036854775807 - n THEN 'range_overflow' WHEN o > 2048 THEN 'offset_out_of_bounds' WHEN o + n > 2048 THEN 'short_read' END AS error_code FROM r""",
}
