"""Little-endian numbers, bits and digests on binary columns.

Everything here is a built-in expression (whole-stage code where Spark has it),
but for the two float reads and writes, whose bit patterns SQL can't
reinterpret, and the FNV-1a fold.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.images import byte

#: Parameters of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def chunk(raw: Column, at: Column | int, size: int) -> Column:
    """size bytes from a zero-based place; null if they are not all there."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(raw, (at + 1).cast("int"), F.lit(size))
    return F.when((at >= 0) & (F.octet_length(part) == size), part)


def swapped(digits: Column, size: int) -> Column:
    """Hex digits of size bytes with the bytes in the other order (reverse() would take a binary for text)."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _digits(raw: Column, at: Column, size: int) -> Column:
    """Hex digits of size bytes, the last byte first.

    Each byte is cut from raw itself: inside a lambda nothing is computed once
    for several uses, so nothing here is worth sharing.
    """
    return F.concat(*[F.hex(F.substring(raw, (at + (i + 1)).cast("int"), F.lit(1))) for i in reversed(range(size))])


def _fits(raw: Column, at: Column, size: int) -> Column:
    return (at >= 0) & (F.octet_length(raw) >= at + size)


def read_uint(raw: Column, at: Column | int, size: int) -> Column:
    """Unsigned little-endian number of 1 to 8 bytes: long, or decimal(20,0) for 8 bytes; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(_fits(raw, at, size), F.conv(_digits(raw, at, size), 16, 10).cast("long" if size < 8 else "decimal(20,0)"))


def read_int(raw: Column, at: Column | int, size: int) -> Column:
    """Signed little-endian number of 1, 2, 4 or 8 bytes; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    if size == 8:  # conv to a negative base reads the bits as signed
        return F.when(_fits(raw, at, 8), F.conv(_digits(raw, at, 8), 16, -10).cast("long"))
    value, half = read_uint(raw, at, size), 1 << (8 * size - 1)
    return F.when(value >= half, value - 2 * half).otherwise(value)


@F.pandas_udf(T.DoubleType())
def _f32(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else struct.unpack("<f", b)[0])


@F.pandas_udf(T.DoubleType())
def _f64(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else struct.unpack("<d", b)[0])


def read_float(raw: Column, at: Column | int, size: int) -> Column:
    """Little-endian IEEE number of 4 or 8 bytes as a double."""
    return (_f32 if size == 4 else _f64)(chunk(raw, at, size))


def write_int(value: Column, size: int) -> Column:
    """Little-endian bytes of a number; two's complement, so signed and unsigned are one; null out of range."""
    low, high = -(1 << (8 * size - 1)), 1 << (8 * size)
    whole = value.cast("long") if size == 8 else F.when((value >= low) & (value < high), value.cast("long"))
    return F.unhex(swapped(F.substring(F.lpad(F.hex(whole), 16, "0"), 17 - 2 * size, 2 * size), size))


@F.pandas_udf(T.BinaryType())
def _pack_f32(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None or pd.isna(x) else struct.pack("<f", x))


@F.pandas_udf(T.BinaryType())
def _pack_f64(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None or pd.isna(x) else struct.pack("<d", x))


def write_float(value: Column, size: int) -> Column:
    return (_pack_f32 if size == 4 else _pack_f64)(value.cast("double"))


def lower_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def set_bits(bitmap: Column, *, clear: bool = False, skip: int = 0) -> Column:
    """Indices of the set (or clear) bits of a bitmap, lowest bit of the first byte first; the bitmap may begin after skip bytes."""
    octets = F.octet_length(bitmap) - skip
    every = F.when(octets > 0, F.sequence(F.lit(0), octets * 8 - 1)).otherwise(F.array().cast("array<int>"))
    wanted = F.lit(0 if clear else 1)
    return F.filter(every, lambda i: F.getbit(byte(bitmap, F.floor(i / 8).cast("int") + skip), i % 8).cast("int") == wanted)


def chunks(raw: Column, size: int, *, skip: int = 0, end: Column | int | None = None) -> Column:
    """The whole chunks of a binary in order, from skip up to end."""
    stop = F.octet_length(raw) if end is None else F.least(F.octet_length(raw), F.lit(end) if isinstance(end, int) else end)
    n = F.floor((stop - skip) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, (i * size + skip + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def differing(left: Column, right: Column) -> Column:
    """Offsets within the common length where two binaries differ; equal ones are told apart first."""
    n = F.least(F.octet_length(left), F.octet_length(right))
    none = F.array().cast("array<int>")
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(left, (i + 1).cast("int"), F.lit(1)) != F.substring(right, (i + 1).cast("int"), F.lit(1)))
    return F.when((n == 0) | (left == right), none).otherwise(places)


@F.pandas_udf(T.StringType())
def _fnv1a64(raw: pd.Series) -> pd.Series:
    def fold(octets):
        state = FNV_OFFSET
        for v in octets or b"":
            state = (state ^ v) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        return f"{state:016x}"

    return raw.map(fold)


def fnv1a64(raw: Column) -> Column:
    """64-bit FNV-1a in lower hex: an ordered fold, so one task for each image.

    A fold in SQL reads the image anew for every byte, so long ones take the
    square of their length; this one is linear.
    """
    return _fnv1a64(raw)


def framed(*parts: tuple[Column, int]) -> Column:
    """Binaries, each after its length as a big-endian number of so many bytes."""
    out = []
    for raw, width in parts:
        out += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 2 * width, "0")), raw]
    return F.concat(*out)
