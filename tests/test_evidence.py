"""Checks that no query runs by itself."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.operators import census, decode, delta, evidence, snapshot
from pagewright.sources.images import pages


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_exact_keys(spark):
    df = spark.createDataFrame([(["a", "x"],)], "k array<string>")
    r = df.select(*[v.alias(n) for n, v in evidence.exact_keys(F.col("k"), ["a", "b"]).items()]).first()
    assert (r.unknown, r.missing) == (["x"], ["b"])


def test_cases_and_mutants_leave_residues(spark):
    a = spark.createDataFrame([("1", 5), ("2", 6)], "id string, v int")
    b = spark.createDataFrame([("2", 7), ("3", 8)], "id string, w int")
    for found, left in (evidence.matched_cases(a, b), evidence.joined_mutants(a, b)):
        assert rows(found, "id", "v", "w") == [("2", 6, 7)]
        assert rows(left, "id", "side") == [("1", "left_only"), ("3", "right_only")]


@pytest.mark.parametrize(("base", "now", "metric", "regressed"), [(100.0, 115.0, "median_latency_ns", False), (100.0, 115.1, "median_latency_ns", True), (100.0, 85.0, "throughput_per_second", False), (100.0, 84.9, "throughput_per_second", True), (100.0, 50.0, "peak_rss_bytes", False)])
def test_regression_bounds(spark, base, now, metric, regressed):
    one = lambda v: spark.createDataFrame([("x", metric, v)], "id string, metric string, value double")
    assert evidence.regressions(one(base), one(now)).first().regressed is regressed


def test_ratio_is_exact(spark):
    df = spark.createDataFrame([(85, 100), (84, 100), (0, 0), (2**62, 2**62)], "a long, b long")
    assert [r[0] for r in df.select(evidence.meets_ratio(F.col("a"), F.col("b"), 85)).collect()] == [True, False, False, True]


def test_intervals_of_many_parts(spark):
    part = evidence.PART
    intervals = spark.createDataFrame([("f", 10, 3 * part + 5), ("f", 4 * part, 4 * part + 1)], "file string, start long, end long")
    offs = [9, 10, part - 1, part, 3 * part + 4, 3 * part + 5, 4 * part, 4 * part + 1, 9 * part]
    changes = spark.createDataFrame([("f", o) for o in offs] + [("g", 0)], "file string, off long")
    got = rows(evidence.changes_outside(changes, intervals, "file"), "file", "off")
    assert got == [("f", 9), ("f", 3 * part + 5), ("f", 4 * part + 1), ("f", 9 * part), ("g", 0)]


def test_interval_order_of_codes(spark):
    data = [("a", 0, 5, 5), ("b", 0, 0, 99), ("c", 0, 4, 6), ("c", 1, 2, 3), ("d", 0, 0, 4), ("d", 1, 3, 5), ("e", 0, 0, 4), ("e", 1, 4, 5), ("e", 2, 7, 8)]
    df = spark.createDataFrame(data, "file string, idx int, start long, end long")
    got = {(r.file, r.idx): r.error_code for r in evidence.interval_errors(df, F.lit(50), "file").collect() if r.error_code}
    assert got == {("a", 0): "empty_interval", ("b", 0): "interval_out_of_bounds", ("c", 1): "interval_order", ("d", 1): "interval_overlap", ("e", 1): "adjacent_intervals"}


def test_framed_digest(spark):
    df = spark.createDataFrame([("s", "b", b"22"), ("s", "a", b"")], "suite string, path string, blob binary")
    want = hashlib.sha256(b"D" + b"\0\0\0\1a" + bytes(8) + b"\0\0\0\1b" + bytes(7) + b"\2" + b"22").hexdigest()
    assert evidence.framed_digest(df, "suite", domain=b"D").first().digest == want


def test_schedule(spark):
    got = rows(evidence.growth_schedule(spark, [10, 10, 25], 4, 4), "step", "threshold", "batches", "page_count")
    assert got == [(1, 10, 2, 12), (2, 10, 0, 12), (3, 25, 4, 28)]


def test_digests_of_images_and_pages(spark):
    images = spark.createDataFrame([("i", b"abcd" * 4, 16), ("e", b"", 0)], "image_id string, content binary, length long")
    cut = pages(images, 4)
    assert rows(census.page_digests(cut), "page", "sha256") == [(n, hashlib.sha256(b"abcd").hexdigest()) for n in range(4)]
    assert rows(census.rebuilt(cut), "sha256", "length") == [(hashlib.sha256(b"abcd" * 4).hexdigest(), 16)]
    assert {r.image_id: r.fnv1a64 for r in census.image_digests(images).collect()}["e"] == "cbf29ce484222325"
    assert rows(census.classified(cut).limit(1), "kind", "tag") == [("unknown", 97)]
    assert rows(census.touched_pages(spark.createDataFrame([(1,), (5,), (6,)], "off int"), 4), "page") == [(0,), (1,)]


def test_page_ranges(spark):
    df = spark.createDataFrame([(3,), (2**62,)], "page long")
    got = [tuple(r) for r in df.select(*decode.page_range(F.col("page"), 2048).values()).collect()]
    assert got == [(6144, 8192), (None, None)]


def test_blob_ceiling(spark):
    page = spark.createDataFrame([("i", 0, b"a"), ("i", 1, b"b")], "image_id string, page long, raw binary")
    empty = spark.createDataFrame([], "sha256 string")
    assert rows(census.new_blobs(page, empty, 1), "error_code") == [("blob_ceiling",)] * 2
    assert rows(census.new_blobs(page, empty, 2), "error_code") == [(None,)] * 2


def test_row_json_and_kinds(spark):
    schema = snapshot.ROWS
    value = lambda kind, v, raw=None, page=None: {"kind": kind, "value": v, "raw_hex": raw, "code_page": page}
    df = spark.createDataFrame([("s", "t", "k", {"b": value("text", 'q"', page=1252), "a": value("null", None, raw="0a"), "c": value("long", "7")})], schema)
    text = df.select(snapshot.values_json(F.col("values"))).first()[0]
    assert text == '{"a":{"kind":"null","raw_hex":"0a","value":null},"b":{"code_page":1252,"kind":"text","value":"q\\""},"c":{"kind":"long","value":7}}'
    kinds = spark.createDataFrame([("single", "1e39", None), ("double", "NaN", None), ("long", "1", 5), ("memo", "x", 5), ("byte", "-1", None), ("boolean", "true", None)], "k string, v string, p int")
    got = [r[0] for r in kinds.select(snapshot.value_error(F.col("k"), F.col("v"), F.col("p"))).collect()]
    assert got == ["not_finite", "not_finite", "code_page_not_allowed", None, "out_of_range", None]
    spelled = kinds.where("k = 'boolean'").select(snapshot.semantic_json(F.col("k"), F.col("v"))).first()[0]
    assert spelled == "true"


def test_cells_and_bounds(spark):
    obs = spark.createDataFrame([(1, b"\x01\x02\x03")], "condition int, prefix binary")
    assert rows(delta.cells(obs, 1, 3), "off", "v") == [(1, 2), (2, 3)]
    assert delta.bounded_intake(spark.range(3), 3).first().error_code is None
