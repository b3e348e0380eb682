"""The checkpoint model search against loops over the same bytes."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import checkpoints as ops
from pagewright.operators import decode

NAMES = [f"c{i}" for i in range(6)]
GROWTH, CHURN = [("c0", "c1"), ("c1", "c2")], [("c3", "c4"), ("c4", "c5")]
COUNTS = [300, 310, 325, 325, 325, 325]


def pages_of(replica):
    """One page a checkpoint: a pointer that grows at 10, one that churns at 20, both-ways noise at 30."""
    rng = random.Random(5)
    base = bytearray(rng.randrange(1, 250) for _ in range(64))
    out = []
    for i in range(6):
        page = bytearray(base)
        page[10:14] = (100 + min(i, 2)).to_bytes(3, "little") + bytes([7])
        page[20:24] = bytes([9]) + (200 + (i == 4)).to_bytes(3, "little")
        page[30:34] = (40 + i).to_bytes(3, "little") + bytes([replica])
        out.append(bytes(page))
    return out


@pytest.fixture(scope="module")
def history(spark):
    rows = [(r, i, NAMES[i], 1, p) for r in (1, 2) for i, p in enumerate(pages_of(r))]
    return spark.createDataFrame(rows, "replica int, ordinal int, checkpoint string, page long, raw binary")


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(r, i, NAMES[i], n) for r in (1, 2) for i, n in enumerate(COUNTS)], "replica int, ordinal int, checkpoint string, page_count long")


def pointer(raw, layout):
    return (int.from_bytes(raw[:3], "little"), raw[3]) if layout.startswith("u24") else (int.from_bytes(raw[1:], "little"), raw[0])


def test_pointer_windows(spark, history, counts):
    intervals = spark.createDataFrame([(r, 1, 5, 60) for r in (1, 2)], "replica int, page long, start int, end int")
    got = {(r.replica, r.off, r.layout, r.role) for r in ops.pointer_windows(history, counts, intervals, GROWTH, CHURN).collect()}
    want = set()
    for r in (1, 2):
        pages = pages_of(r)
        for off in range(5, 57):
            for layout in decode.POINTER_LAYOUTS:
                w = [p[off : off + 4] for p in pages]
                if not all(1 <= pointer(x, layout)[0] < n for x, n in zip(w, COUNTS, strict=True)):
                    continue
                at = dict(zip(NAMES, w, strict=True))
                grows, churns = any(at[a] != at[b] for a, b in GROWTH), any(at[a] != at[b] for a, b in CHURN)
                if grows != churns:
                    want.add((r, off, layout, "used" if grows else "free"))
    assert got == want
    assert (1, 10, decode.POINTER_LAYOUTS[0], "used") in got and (1, 20, decode.POINTER_LAYOUTS[1], "free") in got


def test_changed_bytes_and_interval(history):
    moved = ops.changed_bytes(history, [(a, b) for a, b in zip(NAMES, NAMES[1:], strict=False)])
    pages = pages_of(1)
    want = {o for a, b in zip(pages, pages[1:], strict=False) for o in range(64) if a[o] != b[o]}
    assert {r.off for r in moved.where("replica = 1").collect()} == want
    row = ops.record_interval(moved).where("replica = 1").first()
    assert (row.start, row.end, row.error_code) == (min(want), max(want) + 1, None)


def test_formulas(spark):
    """Slot 0 leads to page 3, slot 1 to page 5; bits stand for slot-relative pages, which only one formula predicts."""
    size = decode.PAGE_SIZE

    def extended(bits):
        raw = bytearray(size)
        raw[0] = 5
        for b in bits:
            raw[4 + b // 8] |= 1 << (b % 8)
        return bytes(raw)

    n = {"g0": 40, "g1": 50, "g2": 60}
    edges = []
    for o, (name, count) in enumerate(n.items()):
        edges.append((1, o, name, 0, 3, extended(range(20, count)), None))
        edges.append((1, o, name, 1, 5, extended([]), None))
    edges = spark.createDataFrame(edges, "replica int, ordinal int, checkpoint string, slot int, ref long, raw binary, error_code string")
    counts = spark.createDataFrame([(1, k, v) for k, v in n.items()], "replica int, checkpoint string, page_count long")
    got = ops.surviving_formulas(ops.predicted_pages(edges), counts, [("g0", "g1"), ("g1", "g2")])
    assert [r.formula for r in got.collect()] == ["slot_relative_expected_0_16352"]


def test_reference_edges(spark):
    slots = spark.createDataFrame([(1, "a", 0, 2), (1, "a", 1, 9), (1, "a", 2, 3)], "replica int, checkpoint string, slot int, ref long")
    pages = spark.createDataFrame([(1, "a", 2, bytes([5, 0])), (1, "a", 3, bytes([1, 0]))], "replica int, checkpoint string, page long, raw binary")
    counts = spark.createDataFrame([(1, "a", 5)], "replica int, checkpoint string, page_count long")
    got = {r.slot: r.error_code for r in ops.reference_edges(slots, pages, counts).collect()}
    assert got == {0: None, 1: "reference_out_of_range", 2: "not_an_extended_bitmap"}


def test_slots_of_a_record(spark):
    raw = bytes([1]) + (0).to_bytes(4, "little") + (7).to_bytes(4, "little") + (70000).to_bytes(4, "little")
    rows = spark.createDataFrame([(1, 0, "a", 1, b"xx" + raw + b"yy")], "replica int, ordinal int, checkpoint string, page long, raw binary")
    assert [(r.slot, r.ref) for r in ops.slot_references(rows, 2, 15).collect()] == [(1, 7), (2, 70000)]


def test_inline_boundaries(spark):
    raw = [bytes([0, 1, 0, 0, 0, 3, 0, 0]), bytes([0, 1, 0, 0, 0, 7, 1, 0])]
    history = spark.createDataFrame([(1, i, f"c{i}", 1, r) for i, r in enumerate(raw)], "replica int, ordinal int, checkpoint string, page long, raw binary")
    intervals = spark.createDataFrame([(1, 1, 0, 8)], "replica int, page long, start int, end int")
    assert [r.boundary for r in ops.inline_boundaries(history, intervals, F.col("start") + 5).collect()] == [7]


def test_freeze_and_holdout(spark, tmp_path):
    models = spark.createDataFrame([(1, "x"), (2, "y")], "page int, layout string")
    path = str(tmp_path / "frozen")
    digest = ops.freeze(models, path)
    with pytest.raises(Exception, match="(?i)exist"):
        ops.freeze(models, path)
    derived = spark.createDataFrame([(2, "y"), (3, "z")], "page int, layout string")
    assert {r.page: r.held for r in ops.holdout(path, digest, derived, "page", "layout").collect()} == {1: False, 2: True}
    with pytest.raises(ValueError, match="changed"):
        ops.holdout(path, "0" * 64, derived, "page", "layout")
    assert ops.frozen_digest(models.repartition(7)) == digest


def test_capture(spark):
    current = spark.createDataFrame([(0, b"a"), (1, b"b"), (3, b"n")], "page long, raw binary")
    prior = current.where("page < 2").select("page", F.sha2(F.when(F.col("page") == 1, F.lit(b"old")).otherwise(F.col("raw")), 256).alias("sha256"))
    prior = prior.unionByName(spark.createDataFrame([(2, "gone")], "page long, sha256 string"))
    got = {r.page: (r.status, r.raw and bytes(r.raw), r.sha256 is None) for r in ops.capture(current, prior).collect()}
    assert got == {0: ("unchanged", None, False), 1: ("changed", b"b", False), 2: ("removed", None, True), 3: ("added", b"n", False)}


def test_opened_blobs_are_tested(spark):
    import hashlib

    good, bad = hashlib.sha256(b"x").hexdigest(), hashlib.sha256(b"y").hexdigest()
    index = spark.createDataFrame([(1, 0, "a", 1, good), (1, 0, "a", 2, bad)], "replica int, ordinal int, checkpoint string, page long, sha256 string")
    blobs = spark.createDataFrame([(good, b"x"), (bad, b"z")], "sha256 string, raw binary")
    got = {r.page: r.error_code for r in ops.opened(index, blobs, index).collect()}
    assert got == {1: None, 2: "unreconstructable_snapshot"}


def test_model_counts_and_agreement(spark):
    pointers = spark.createDataFrame([(1, 1, o, "a", role) for o, role in ((1, "used"), (2, "used"), (5, "free"))], "replica int, page long, off int, layout string, role string")
    formulas = spark.createDataFrame([(1, "f"), (1, "g")], "replica int, formula string")
    assert ops.model_count(pointers, formulas).first().n_models == 4
    both = spark.createDataFrame([(1, "m"), (2, "m"), (2, "n")], "replica int, model string")
    assert [r.model for r in ops.replicas_agree(both, 2, "model").collect()] == ["m"]
    outcomes = {r.replica: r.outcome for r in ops.layer_outcome(both, spark.createDataFrame([(1,), (2,), (3,)], "replica int"), "model").collect()}
    assert outcomes == {1: "one_model", 2: "ambiguous_model", 3: "no_surviving_model"}


def test_polarity_conflicts(spark):
    a = spark.createDataFrame([(1, "c", 1), (1, "c", 2)], "replica int, checkpoint string, page long")
    b = spark.createDataFrame([(1, "c", 2), (1, "c", 3)], "replica int, checkpoint string, page long")
    assert {(r.page, r.side) for r in ops.polarity_conflicts(a, b).collect()} == {(1, "predicted_only"), (3, "inline_only")}


def test_pages_in_use(spark):
    raw = bytes([0]) + (100).to_bytes(4, "little") + bytes([0b101])
    df = spark.createDataFrame([(raw,)], "r binary")
    assert df.select(ops.in_use_pages(F.col("r"), ops.POLARITIES[0])).first()[0] == [100, 102]
    assert df.select(ops.in_use_pages(F.col("r"), ops.POLARITIES[1])).first()[0] == [101, 103, 104, 105, 106, 107]


def test_whole_histories(spark):
    good = "0" * 64
    index = [(1, 0, "a", p, good) for p in range(2)] + [(1, 1, "b", p, good) for p in (0, 2)] + [(2, 0, "a", 0, "X")] + [(2, 5, "z", 0, good)]
    index = spark.createDataFrame(index, "replica int, ordinal int, checkpoint string, page long, sha256 string")
    counts = spark.createDataFrame([(1, 0, "a", 2), (1, 1, "b", 2), (2, 0, "a", 1), (2, 5, "z", 1)], "replica int, ordinal int, checkpoint string, page_count long")
    got = {(r.replica, r.checkpoint): r.error_code for r in ops.history_errors(index, counts, ["a", "b"]).collect()}
    assert got == {(1, "b"): "pages_not_contiguous", (2, "a"): "bad_digest", (2, "b"): "missing_checkpoint", (2, "z"): "unknown_checkpoint"}


def test_closure_of_deep_trees_and_cycles(spark):
    from pagewright.operators import evidence

    edges = [(i, i - 1) for i in range(1, 9)] + [(101, 100), (102, 101), (100, 102)]
    nodes = spark.createDataFrame([(n, p, 1) for n, p in edges], "node long, parent long, rss long")
    roots = spark.createDataFrame([(0,), (5,), (100,), (500,)], "root long")
    got = {r.root: r.total for r in evidence.closure_sum(nodes, roots, "rss").collect()}
    assert got == {0: 8, 5: 4, 100: 3}
