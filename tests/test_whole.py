"""Queries read whole tables and whole texts: held against plain Python on small fixtures."""

from hashlib import sha256

import pytest

from pagewright.plans import registry

TEXTS = [
    "a b  c" * 3,
    "é" + "x " * 2500 + "ü" + " tail" * 30,
    ("word " * 700 + "ß!") + "z" * 3000,
    "plain ascii only " * 400,
    "x" * 2047 + "é" + " y!" * 5,
    "",
    None,
    " " * 4200,
    "日本語 テキスト " * 300 + "end",
    "\n \x00 \t" * 900 + "é ",
]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Documents with ids that are no multiples of anything, and their bytes."""
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(i + 1, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, {i: (t or "").encode() for i, t in rows}


def run(spark, folder, name, *columns):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, folder).select(*columns).collect())


def test_prefix_sum_intervals_reads_every_byte(spark, texts):
    folder, raws = texts
    want = [(d, i, b[: i + 1].count(32), b[max(0, i - 31) : i + 1].count(32)) for d, b in raws.items() for i in range(len(b))]
    assert run(spark, folder, "prefix_sum_intervals", "page", "off", "flag_upto", "in_interval") == want


def _top(b):
    return max((i for i, v in enumerate(b) if v > 127), default=-1)


def test_last_changed_offsets_reads_every_byte(spark, texts):
    folder, raws = texts
    got = registry.QUERIES["last_changed_offsets"](spark, folder).orderBy("page", "off").collect()
    tops = {d: _top(b) for d, b in raws.items()}
    want = [(d, i, tops[d] if tops[d] >= i else -1, tops[d] + 1 if tops[d] >= i else None) for d, b in raws.items() for i in range(len(b))]
    assert [tuple(r[c] for c in ("page", "off", "last_from", "suffix_start")) for r in got] == want


def test_suffix_slack_reads_every_byte(spark, texts):
    folder, raws = texts
    want = [(d, 0 if _top(b) < 0 or 33 in b[_top(b) + 1 :] else len(b) - 1 - _top(b)) for d, b in raws.items() if b]
    assert run(spark, folder, "suffix_slack", "page", "slack") == want
    assert max(s for _, s in want) > 100


def test_fnv1a64_has_every_image(spark, texts):
    folder, raws = texts

    def fnv(b):
        h = 0xCBF29CE484222325
        for v in b:
            h = (h ^ v) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    assert run(spark, folder, "fnv1a64_per_image", "image_id", "fnv1a64") == [(d, fnv(b)) for d, b in raws.items()]


def cut(b):
    return [b[i : i + 64] for i in range(0, len(b), 64)]


def test_opened_blobs_opens_every_page(spark, texts):
    folder, raws = texts
    bad = lambda p: sha256(p).hexdigest() < "2"
    want = [(d, k, None if bad(p) else len(p), "unreconstructable_snapshot" if bad(p) else None) for d, b in raws.items() for k, p in enumerate(cut(b))]
    got = registry.QUERIES["opened_blobs"](spark, folder).select("ordinal", "page", "n_bytes", "error_code").orderBy("ordinal", "page").collect()
    assert [tuple(r) for r in got] == want
    assert any(c and k > 3 and k % 2 for _, k, _, c in want)


def test_mask_records_masks_every_page(spark, texts):
    folder, raws = texts
    want = []
    for d, b in raws.items():
        for k, (x, y) in enumerate(zip(cut(b), cut(raws.get(d + 1, b"")), strict=False)):
            offs = [i for i in range(min(len(x), len(y))) if x[i] != y[i]]
            if offs:
                want.append((d, k, len(offs), offs[0], offs[-1], sum(1 << o for o in offs).to_bytes(8, "little").hex()))
    assert run(spark, folder, "mask_records", "image_id", "page", "bit_count", "first_off", "last_off", "mask") == want
    assert max(k for _, k, *_ in want) > 10


def test_incremental_capture_has_every_page_of_every_image(spark, texts):
    folder, raws = texts
    want = []
    for d, b in raws.items():
        for k, p in enumerate(cut(b)):
            status = "removed" if k % 5 == 3 else "added" if k % 7 == 2 else "changed" if k % 4 == 1 else "unchanged"
            want.append((d, k, status, len(p) + (k % 4 == 1) if status in ("added", "changed") else None))
    got = registry.QUERIES["incremental_capture"](spark, folder).select("image_id", "page", "status", "n_bytes").orderBy("image_id", "page").collect()
    assert [tuple(r) for r in got] == want


def test_changes_outside_intervals_compares_every_pair(spark, texts):
    folder, raws = texts
    want = []
    for d, b in raws.items():
        offs = [i for i, (x, y) in enumerate(zip(b, raws.get(d + 1, b""), strict=False)) if x != y and (i % 50 >= 30 or i >= 2050)]
        if offs:
            want.append((d, offs[0], len(offs)))
    assert run(spark, folder, "changes_outside_intervals", "doc_id", "first_off", "n_outside") == want
    assert len(want) > 3


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts, suppliers and orders whose ids go beyond any small range."""
    folder = str(tmp_path_factory.mktemp("tables"))
    parts = [(i, f"n{i}", f"Brand#{i // 100}", f"t{i}", i % 50) for i in range(1, 251)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, (i - 1) // 30) for i in range(1, 91)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(i,) for i in range(1, 201)], "o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_snapshot_deep_diff_reads_every_part(spark, tables):
    want = [("/part/999/p_size", "allowed_difference_not_observed"), ("/part/12/p_size", "allowed_difference_not_observed")]
    for i in range(1, 251):
        for c in ("p_name", "p_size", "p_type"):
            code = "key_difference" if i % 17 == 3 else "type_difference" if c == "p_name" and i % 10 == 9 else "value_difference" if c == "p_size" and i % 10 == 1 else None
            if code and (i, c) != (11, "p_size"):
                want.append((f"/part/{i}/{c}", code))
    assert run(spark, tables, "snapshot_deep_diff", "path", "error_code") == sorted(want)


def test_varying_attributes_reads_every_part(spark, tables):
    want = [(f"Brand#{b}", a, n if a == "p_type" else 50) for b, n in ((0, 99), (1, 100), (2, 51)) for a in ("p_size", "p_type")]
    assert run(spark, tables, "varying_attributes", "p_brand", "attribute", "n_values") == want


def test_platform_records_reads_every_supplier(spark, tables):
    want = [(i, 30, "repeated") if i < 3 else (i, 0, "missing") for i in range(20)]
    assert run(spark, tables, "platform_records", "platform", "n", "error_code") == want


def test_interval_list_validation_reads_every_order(spark, tables):
    got = run(spark, tables, "interval_list_validation", "file", "idx", "start", "end")
    want = [(i // 50, i % 50, i % 50 * 20 + i % 7, i % 50 * 20 + i % 7 + i % 50 * 37 % 23) for i in range(1, 201)]
    assert got == want
