"""Decoders of the physical format: signatures, geometry, slots, allocation maps, pointers.

Every decoder is a projection; what is wrong with a row is a stable text in
``error_code`` (null if nothing is), and the order of the tests is the order of
the cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import chunk, chunks, lower_hex, read_uint, set_bits
from ..sources.images import PAGE_SIZE, byte, geometry

#: Where the signature stands and what it says.
SIGNATURE_AT, SIGNATURE_SIZE = 4, 15
SIGNATURES = (("standard", b"Standard Jet DB"), ("system", b"Jet System DB "), ("temporary", b"Temp Jet DB "))

#: The region of connection slots on page zero.
SLOTS_AT, SLOTS, SLOT_SIZE = 0x600, 256, 2
SLOT_CLASSES = {"0000": "physically_writing", "0100": "corrupted_page_access"}

#: Allocation records and extended bitmap pages.
INLINE, INDIRECT, INLINE_HEADER, REFERENCE_SIZE, EXTENDED_HEADER = 0, 1, 5, 4, 4
EXTENDED_BITS = (PAGE_SIZE - EXTENDED_HEADER) * 8
POINTER_LAYOUTS = ("u24le_page_then_u8_slot", "u8_slot_then_u24le_page")
BASE_FORMULAS = (
    "slot_relative_expected_0_16352",
    "slot_relative_off_by_minus_one",
    "slot_relative_off_by_plus_one",
    "referenced_page_relative",
    "referenced_page_relative_off_by_minus_one",
    "referenced_page_relative_off_by_plus_one",
)


def signature(content: Column) -> Column:
    """standard, system or temporary; null for another signature or a short image."""
    observed = chunk(content, SIGNATURE_AT, SIGNATURE_SIZE)
    kind = F.lit(None).cast("string")
    for name, text in reversed(SIGNATURES):
        kind = F.when(F.substring(observed, 1, len(text)) == F.lit(text), F.lit(name)).otherwise(kind)
    return kind


def checked_request(offset: Column, size: Column, length: Column, limit: Column) -> Column:
    """Why a read of size bytes is refused: its size, its end beyond numbers, its start, its end; else null."""
    most = F.lit(2**63 - 1)
    return (
        F.when(size > limit, "read_limit_exceeded")
        .when(offset > most - size, "range_overflow")
        .when(offset > length, "offset_out_of_bounds")
        .when(offset + size > length, "short_read")
    )


def read_at(images: DataFrame, offset: Column, size: int, limit: int) -> DataFrame:
    """images with raw (null if refused) and error_code."""
    code = checked_request(offset, F.lit(size).cast("long"), F.col("length"), F.lit(limit).cast("long"))
    return images.withColumn("error_code", code).withColumn("raw", F.when(code.isNull(), chunk(F.col("content"), offset, size)))


def candidates(images: DataFrame, *, page_size: int = PAGE_SIZE, max_bytes: int = 256 << 20) -> DataFrame:
    """images with kind, page_count and error_code: input limit, then signature, then geometry."""
    shape = geometry(F.col("length"), page_size)
    kind = signature(F.col("content"))
    code = (
        F.when(F.col("length") > max_bytes, "input_limit_exceeded")
        .when(F.col("length") < SIGNATURE_AT + SIGNATURE_SIZE, "short_read")
        .when(kind.isNull(), "unrecognized_signature")
        .otherwise(shape["error_code"])
    )
    return images.withColumns({"kind": kind, "page_count": shape["page_count"], "error_code": code})


def database_pages(images: DataFrame, *, page_size: int = PAGE_SIZE, max_bytes: int = 256 << 20) -> DataFrame:
    """candidates() with page zero (raw) and whether its signature is still the image's."""
    found = candidates(images, page_size=page_size, max_bytes=max_bytes)
    zero = F.when(F.col("error_code").isNull(), chunk(F.col("content"), 0, page_size))
    return found.withColumn("raw", zero).withColumn("signature_unchanged", F.when(F.col("raw").isNotNull(), signature(F.col("raw")) == F.col("kind")))


def page_range(page: Column, page_size: int) -> dict[str, Column]:
    """First byte and end of a page; null where the numbers overflow."""
    start = F.try_multiply(page.cast("long"), F.lit(page_size).cast("long"))
    return {"start": start, "end": F.try_add(start, F.lit(page_size).cast("long"))}


def valid_reference(page: Column, page_count: Column) -> Column:
    return (page >= 0) & (page < page_count)


def commit_slots(page_zero: DataFrame) -> DataFrame:
    """(image_id, idx, role, ordinal, raw, class) of each slot of page zero; slot 0 is exclusive, the others shared."""
    region = chunks(F.col("raw"), SLOT_SIZE, skip=SLOTS_AT, end=SLOTS_AT + SLOTS * SLOT_SIZE)
    slots = page_zero.where("page = 0").select("image_id", F.posexplode(region).alias("idx", "slot"))
    text = lower_hex(F.col("slot"))
    kind = F.lit("other")
    for raw, name in SLOT_CLASSES.items():
        kind = F.when(text == raw, F.lit(name)).otherwise(kind)
    role = F.when(F.col("idx") == 0, "exclusive").otherwise("shared")
    return slots.select("image_id", "idx", role.alias("role"), F.when(F.col("idx") > 0, F.col("idx")).alias("ordinal"), text.alias("raw"), kind.alias("class"))


def allocation_map(record: Column) -> Column:
    """(map_type, start_page, bitmap, refs, error_code) of an allocation record."""
    kind, size = byte(record, 0), F.octet_length(record)
    code = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_record")
        .when((kind == INLINE) & (size < INLINE_HEADER), "inline_record_too_short")
        .when((kind == INDIRECT) & ((size - 1) % REFERENCE_SIZE != 0), "indirect_payload_misaligned")
        .when(~kind.isin(INLINE, INDIRECT), "unsupported_record_type")
    )
    sound = code.isNull()
    inline, indirect = sound & (kind == INLINE), sound & (kind == INDIRECT)
    n = F.floor((size - 1) / REFERENCE_SIZE).cast("int")
    numbers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: read_uint(record, i * REFERENCE_SIZE + 1, REFERENCE_SIZE))
    refs = F.when(n > 0, numbers).otherwise(F.array().cast("array<bigint>"))
    return F.struct(
        F.when(inline, "inline").when(indirect, "indirect").alias("map_type"),
        F.when(inline, read_uint(record, 1, 4)).alias("start_page"),
        F.when(inline, F.substring(record, INLINE_HEADER + 1, 2**31 - 1)).alias("bitmap"),
        F.when(indirect, refs).alias("refs"),
        code.alias("error_code"),
    )


def inline_pages(start_page: Column, bitmap: Column, page_count: Column) -> Column:
    """(page, error_code) for each set bit of an inline map; only set bits are tested against the geometry."""
    number = lambda bit: start_page + bit.cast("long")
    code = lambda page: F.when(page > 0xFFFFFFFF, "page_number_overflow").when(page >= page_count, "page_out_of_range")
    return F.transform(set_bits(bitmap), lambda b: F.struct(number(b).alias("page"), code(number(b)).alias("error_code")))


def map_references(refs: Column) -> Column:
    """(slot, page) of every raw reference; zeros and repeats stay."""
    return F.transform(refs, lambda r, i: F.struct(i.alias("slot"), r.alias("page")))


def extended_bits(raw: Column) -> Column:
    """Relative set bits of an extended bitmap page; null unless its first byte is 5."""
    return F.when(byte(raw, 0) == 5, set_bits(raw, skip=EXTENDED_HEADER))


def unsupported_traversal(rule: str) -> str:
    """The three rules without evidence stay refused: where a map lies, what a raw reference means, an extended page's base."""
    if rule not in ("map_location", "raw_reference", "extended_page_base"):
        raise ValueError(rule)
    return f"unsupported_{rule}"


def pointer(raw: Column, layout: str) -> Column:
    """(page, slot) of a four-byte pointer."""
    page_at, slot_at = (0, 3) if layout == POINTER_LAYOUTS[0] else (1, 0)
    return F.struct(read_uint(raw, page_at, 3).alias("page"), byte(raw, slot_at).alias("slot"))


def extended_base(formula: Column, slot: Column, reference: Column) -> Column:
    """The page that bit 0 of an extended bitmap stands for, by formula."""
    by_slot = slot.cast("long") * EXTENDED_BITS
    shift = F.when(formula.endswith("minus_one"), -1).when(formula.endswith("plus_one"), 1).otherwise(0)
    return F.when(formula.startswith("slot_relative"), by_slot).otherwise(reference.cast("long")) + shift


def active_slots(raw: Column, start: int = 0, end: int | None = None) -> Column:
    """(slot, page) of the references that are not zero of an indirect record, which lies from start to end."""
    stop = F.octet_length(raw) if end is None else F.lit(end)
    n = F.floor((stop - start - 1) / REFERENCE_SIZE).cast("int")
    numbered = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("slot"), read_uint(raw, i * REFERENCE_SIZE + (start + 1), REFERENCE_SIZE).alias("page")))
    return F.when(n > 0, F.filter(numbered, lambda s: s["page"] != 0))


def repeated_pages(chain: DataFrame, page_count: int, max_depth: int = 4096) -> DataFrame:
    """A chain of pages (chain, step, page) with depth and error_code: out of range, seen before, too deep.

    The caller gives the steps; following a reference is not this operator's.
    """
    from pyspark.sql import Window

    seen = F.row_number().over(Window.partitionBy("chain", "page").orderBy("step")) > 1
    ordered = Window.partitionBy("chain").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = chain.withColumn("bad", F.when(~valid_reference(F.col("page"), F.lit(page_count)), "page_out_of_range").when(seen, "repeated_page"))
    depth = F.sum(F.col("bad").isNull().cast("long")).over(ordered)
    return marked.withColumn("depth", depth).select("chain", "step", "page", "depth", F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("depth") > max_depth, "depth_exceeded").alias("error_code"))
