import random
import struct

import pytest
from pyspark.sql import functions as F

from pagewright.functions import bytes as B
from pagewright.functions import text as T


def one(spark, value, kind, *columns):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return tuple(df.select(*columns).first())


def test_numbers_of_every_size(spark):
    raw = bytes(range(250, 256)) + bytes(range(10))
    x = F.col("x")
    got = one(spark, raw, "binary", *[f(x, 1, n) for n in (1, 2, 4, 8) for f in (B.read_uint, B.read_int)])
    want = [struct.unpack_from("<" + c, raw, 1)[0] for c in "BbHhIiQq"]
    assert [int(g) for g in got] == want


def test_reads_beyond_the_end_are_null(spark):
    x = F.col("x")
    assert one(spark, b"abc", "binary", B.read_uint(x, 2, 2), B.read_int(x, 3, 1), B.chunk(x, 0, 4)) == (None, None, None)


def test_floats_round_trip(spark):
    for value in (0.0, -0.0, 1.5, -3.25e-30, 1e300):
        raw = one(spark, value, "double", B.write_float(F.col("x"), 8))[0]
        assert bytes(raw) == struct.pack("<d", value)
        assert struct.pack("<d", one(spark, bytes(raw), "binary", B.read_float(F.col("x"), 0, 8))[0]) == bytes(raw)


@pytest.mark.parametrize(("value", "size", "text"), [(258, 4, "02010000"), (-1, 2, "ffff"), (-2, 8, "feffffffffffffff"), (255, 1, "ff"), (256, 1, None)])
def test_written_numbers(spark, value, size, text):
    raw = one(spark, value, "long", B.write_int(F.col("x"), size))[0]
    assert (bytes(raw).hex() if raw is not None else None) == text


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return f"{h:016x}"


@pytest.mark.parametrize("size", [0, 1, 2, 100, 2048])
def test_fnv(spark, size):
    data = random.Random(size).randbytes(size)
    assert one(spark, data, "binary", B.fnv1a64(F.col("x")))[0] == fnv(data)


def test_set_bits(spark):
    assert one(spark, bytes([5, 128]), "binary", B.set_bits(F.col("x")))[0] == [0, 2, 15]
    assert one(spark, bytes([0xFE]), "binary", B.set_bits(F.col("x"), clear=True))[0] == [0]
    assert one(spark, b"", "binary", B.set_bits(F.col("x")))[0] == []


@pytest.mark.parametrize(
    ("value", "text"),
    [(0.0, "0.0"), (-0.0, "-0.0"), (1e10, "10000000000.0"), (1e-4, "0.0001"), (1e-5, "1e-05"), (1e16, "1e+16"), (123456789012345.6, "123456789012345.6"), (-1.5e-7, "-1.5e-07"), (1e100, "1e+100"), (float("nan"), None)],
)
def test_float_spelling(spark, value, text):
    assert one(spark, value, "double", T.canonical_double(F.col("x")))[0] == text


def test_single_spelling(spark):
    assert one(spark, 0.1, "double", T.canonical_single(F.col("x")))[0] == "0.1"
    assert one(spark, 1e20, "double", T.canonical_single(F.col("x")))[0] == "1e+20"
    assert one(spark, 16777216.0, "double", T.canonical_single(F.col("x")))[0] == "16777216.0"


@pytest.mark.parametrize(
    ("shape", "good", "bad"),
    [
        ("sha256", "a" * 64, "A" * 64),
        ("hex", "0a", "0"),
        ("guid", "0f8fad5b-d9cb-469f-a165-70867728950e", "0f8fad5bd9cb469fa16570867728950e"),
        ("decimal", "-0.50", "01"),
        ("datetime", "2020-01-02T03:04:05.5", "2020-01-02T03:04:05Z"),
        ("commit", "0" * 40, "0" * 39),
        ("scenario_id", "DAO-READ-A_1", "DAO-READ-ab1"),
    ],
)
def test_shapes(spark, shape, good, bad):
    for value, want in ((good, True), (bad, False), (good + "\n", False), (None, False)):
        assert one(spark, value, "string", T.has_shape(F.col("x"), shape))[0] is want


def test_json_string(spark):
    import json

    for value in ('a"b\\c', "tab\tnew\nline\x01\x1f", "é🙂/"):
        assert one(spark, value, "string", T.json_string(F.col("x")))[0] == json.dumps(value, ensure_ascii=False)


def test_utc_times(spark):
    assert one(spark, "2024-01-02T03:04:05Z", "string", T.utc_time(F.col("x")))[0].hour == 3
    assert one(spark, "2024-01-02T03:04:05+02:00", "string", T.utc_time(F.col("x")))[0] is None
