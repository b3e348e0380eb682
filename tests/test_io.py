"""Sources, sinks, the stream and the command line."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import budget, census, decode
from pagewright.sources import evidence as files
from pagewright.sources import generators, images, sinks
from pagewright.streaming import capture


def probe_bytes(pages):
    raw = bytearray(i % 251 for i in range(pages * 2048))
    raw[:4] = bytes(4)
    raw[4:19] = b"Standard Jet DB"
    return bytes(raw)


def test_generated_probe_images(spark):
    got = {r.image_id: bytes(r.content) for r in generators.probe_images(spark, [0, 1, 2]).collect()}
    assert got == {"probe-0": b"", "probe-1": probe_bytes(1), "probe-2": probe_bytes(2)}


def test_generated_bytes(spark):
    def want(i):
        x = i * 0x9E3779B97F4A7C15 % 2**64
        return (x << 17 | x >> 47) & 255

    got = {r.length: bytes(r.content) for r in generators.random_bytes(spark, [64, 4096]).collect()}
    assert got[4096] == bytes(map(want, range(4096)))
    assert got[64] == got[4096][:64]


def test_images_and_pages(spark, tmp_path):
    (tmp_path / "a.mdb").write_bytes(probe_bytes(3))
    (tmp_path / "b.mdb").write_bytes(b"x" * 100)
    found = images.binary_images(spark, str(tmp_path))
    assert images.pages(found).count() == 3
    short = images.pages(found, short_last=True)
    assert short.count() == 4
    assert short.where("octet_length(raw) = 100").count() == 1
    codes = {r.length: r.error_code for r in decode.candidates(found).collect()}
    assert codes == {3 * 2048: None, 100: "unrecognized_signature"}
    assert decode.database_pages(found.where("length > 100")).first().signature_unchanged


def test_read_at(spark):
    one = spark.createDataFrame([(b"abcdef", 6)], "content binary, length long")
    for offset, size, limit, code, raw in ((1, 3, 10, None, b"bcd"), (4, 3, 10, "short_read", None), (7, 0, 10, "offset_out_of_bounds", None), (0, 4, 3, "read_limit_exceeded", None), (6, 0, 3, None, b"")):
        r = decode.read_at(one, F.lit(offset).cast("long"), size, limit).first()
        assert (r.error_code, r.raw and bytes(r.raw) or (b"" if r.raw is not None else None)) == (code, raw)


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return f"{h:016x}"


def test_probe_and_cli(spark, tmp_path, capsys):
    path = tmp_path / "a.mdb"
    path.write_bytes(probe_bytes(2))
    r = census.probe(images.binary_images(spark, str(path)), page_size=2048, max_bytes=10000, max_pages=5).first()
    assert (r.kind, r.pages_visited, r.work_units, r.fnv1a64) == ("standard", 2, 4098, fnv(probe_bytes(2)))
    assert cli.main(["probe", str(path), "--scan-pages", "--max-scan-bytes", "5000", "--max-pages", "9"]) == 0
    assert json.loads(capsys.readouterr().out)["raw_scan"]["checksum_hex"] == fnv(probe_bytes(2))
    for args, code in (
        ([], "unknown_command"), (["probe"], "missing_file"), (["probe", "f", "--scan-pages", "--scan-pages"], "duplicate_option"), (["probe", "f", "--max-pages"], "missing_option_value"),
        (["probe", "f", "--max-pages", "0"], "invalid_limit"), (["probe", "f", "--x"], "unknown_option"), (["probe", "f", "--scan-pages"], "scan_limits_required"),
        (["probe", "f", "--max-pages", "1"], "scan_not_requested"), (["probe", "f", "g"], "unexpected_argument"),
    ):
        assert cli.main(args) == 2
        assert json.loads(capsys.readouterr().err)["error"] == code
    for args, code in (
        (["--max-input-bytes", "10"], "input_limit_exceeded"), (["--scan-pages", "--max-scan-bytes", "10", "--max-pages", "9"], "scan_byte_limit_exceeded"),
        (["--scan-pages", "--max-scan-bytes", "9999", "--max-pages", "1"], "scan_page_limit_exceeded"),
    ):
        assert cli.main(["probe", str(path), *args]) == 1
        assert json.loads(capsys.readouterr().err)["error"] == code
    path.write_bytes(probe_bytes(1)[:-1])
    assert cli.main(["probe", str(path)]) == 1
    assert json.loads(capsys.readouterr().err)["error"] == "not_2k_aligned"
    assert cli.main(["probe", str(tmp_path / "none")]) == 1
    assert json.loads(capsys.readouterr().err)["error"] == "open_failed"


def test_publish(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "out")
    seen = []
    sinks.publish(df, path, validate=lambda x: x.count() == 5, hook=seen.append)
    assert tuple(seen) == sinks.STAGES
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(9), path, validate=lambda x: True)
    assert spark.read.parquet(path).count() == 5
    for stage in sinks.STAGES[:-1]:

        def fail(at, stage=stage):
            if at == stage:
                raise RuntimeError(at)

        other = str(tmp_path / f"fails-{stage}")
        with pytest.raises(RuntimeError):
            sinks.publish(df, other, validate=lambda x: True, hook=fail)
        assert not (tmp_path / f"fails-{stage}").exists()
        assert not (tmp_path / f"fails-{stage}.staged").exists()
    with pytest.raises(ValueError, match="validation"):
        sinks.publish(df, str(tmp_path / "bad"), validate=lambda x: False)
    assert not (tmp_path / "bad").exists()


def test_blob_store(spark, tmp_path):
    page = lambda *raws: spark.createDataFrame([("i", n, r) for n, r in enumerate(raws)], "image_id string, page long, raw binary")
    path = str(tmp_path / "store")
    census.distinct_blobs(page(b"a", b"a", b"b")).select("sha256", "raw").write.parquet(path)
    store = spark.read.parquet(path)
    assert sinks.add_blobs(page(b"a", b"c"), store, path, 3) == 1
    with pytest.raises(ValueError, match="ceiling"):
        sinks.add_blobs(page(b"d", b"e"), spark.read.parquet(path), path, 4)
    assert spark.read.parquet(path).count() == 3


def test_page_store_and_patches(spark, tmp_path):
    import hashlib

    good = hashlib.sha256(b"x" * 16).hexdigest()
    (tmp_path / good).write_bytes(b"x" * 16)
    (tmp_path / ("0" * 64)).write_bytes(b"y" * 16)
    (tmp_path / ("1" * 64)).write_bytes(b"y")
    got = {r.sha256[0]: r.error_code for r in files.page_store(spark, str(tmp_path), 16).collect()}
    assert got == {good[0]: None, "0": "digest_differs", "1": "bad_size"}
    df = spark.createDataFrame([(b"abcdef",)], "c binary")
    new = lambda at, raw: df.select(sinks.patched(F.col("c"), F.lit(at), F.lit(raw))).first()[0]
    assert bytes(new(2, b"XY")) == b"abXYef"
    assert bytes(new(0, b"X")) == b"Xbcdef"
    assert new(5, b"XY") is None


def test_masks(spark, tmp_path):
    df = spark.createDataFrame([([0, 9], 10), ([], 3)], "o array<int>, n int")
    assert [bytes(r[0]) for r in df.select(sinks.pack_bits("o", "n")).collect()] == [bytes([1, 2]), bytes([0])]
    sinks.write_masks(df.select(F.lit("m").alias("name"), sinks.pack_bits("o", "n").alias("mask")).limit(1), str(tmp_path))
    assert (tmp_path / "m.bin").read_bytes() == bytes([1, 2])


def test_strict_json(spark, tmp_path):
    texts = {"ok": '{"a": 1}', "twice": '{"a": 1, "a": 2}', "nan": '{"a": NaN}', "cut": '{"a"', "deep": "[" * 70 + "]" * 70, "big": '"' + "x" * 300 + '"'}
    for name, t in texts.items():
        (tmp_path / f"{name}.json").write_text(t)
    got = {r.path.rsplit("/", 1)[1]: (r.error_code, r.doc and r.doc.a) for r in files.strict_json(spark, str(tmp_path), "a int", max_bytes=256).collect()}
    assert got == {"ok.json": (None, 1), "twice.json": ("duplicate_key", None), "nan.json": ("malformed", None), "cut.json": ("malformed", None), "deep.json": ("too_deep", None), "big.json": ("too_large", None)}


def test_manifest_and_tree(spark, tmp_path):
    import hashlib

    tree = tmp_path / "tree"
    (tree / "d").mkdir(parents=True)
    (tree / "a").write_bytes(b"1")
    (tree / "d" / "b").write_bytes(b"22")
    (tree / "d" / "quarantine-c").write_bytes(b"3")
    found = files.tree_files(spark, str(tree), max_entries=3, max_depth=1)
    assert {r.path: (r.size, r.depth, r.error_code) for r in found.collect()} == {"a": (1, 1, None), "d/b": (2, 2, "too_deep"), "d/quarantine-c": (1, 2, "too_deep")}
    assert files.without_quarantined(found).count() == 2
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = {"files": [{"id": "A", "path": "a", "size_bytes": 1, "sha256": sha(b"1")}, {"id": "B", "path": "d/b", "size_bytes": 2, "sha256": sha(b"x")}, {"id": "C", "path": "none", "size_bytes": 0, "sha256": sha(b"")}]}
    (tmp_path / "m.json").write_text(json.dumps(listed))
    got = {r.id: r.error_code for r in files.verified_corpus(files.manifest(spark, str(tmp_path / "m.json")), found).collect()}
    assert got == {"A": None, "B": "digest_differs", "C": "missing_file"}


def test_benchmark_coverage_and_mutants(spark, tmp_path):
    case = tmp_path / "bench" / "g" / "f" / "new"
    case.mkdir(parents=True)
    (case / "benchmark.json").write_text(json.dumps({"group_id": "g", "function_id": "f", "value_str": None, "full_id": "g/f", "throughput": {"Bytes": 64}}))
    (case / "estimates.json").write_text(json.dumps({"median": {"point_estimate": 32.0}}))
    r = files.benchmark_tree(spark, str(tmp_path / "bench")).first()
    assert (r.full_id, r.unit, r.quantity, r.median_ns) == ("g/f", "Bytes", 64, 32.0)
    (tmp_path / "l.info").write_text("TN:\nSF:a.rs\nDA:1,2\nDA:2,0\nend_of_record\nTN:\nSF:b.rs\nDA:1,1\nend_of_record\n")
    assert {(r.file, r.covered, r.total) for r in files.lcov(spark, str(tmp_path / "l.info")).collect()} == {("a.rs", 1, 2), ("b.rs", 1, 1)}
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"files": [{"filename": "a", "summary": {"lines": {"count": 4, "covered": 3}}}]}]}))
    assert tuple(files.coverage_json(spark, str(tmp_path / "c.json")).first()) == ("a", 3, 4)
    mutant = {"file": "a.rs", "function": {"function_name": "f"}, "span": {"start": {"line": 3}}, "genre": "FnValue"}
    (tmp_path / "m.json").write_text(json.dumps({"outcomes": [{"scenario": {"Mutant": mutant}, "summary": "CaughtMutant"}, {"scenario": {"Mutant": None}, "summary": "Success"}]}))
    assert tuple(files.mutant_outcomes(spark, str(tmp_path / "m.json")).first()) == ("a.rs", 3, "f", "FnValue", "killed")
    (tmp_path / "log").write_text("a\n\nb\n")
    assert [(r.line_no, r.value) for r in files.log_lines(spark, str(tmp_path / "log")).orderBy("line_no").collect()] == [(1, "a"), (2, ""), (3, "b")]


def test_snapshot_json(spark):
    raw = [bytes([0]), bytes([1]), bytes([9]), bytes([200]), bytes([9])]
    pages = spark.createDataFrame([("i", n, r) for n, r in enumerate(raw)], "image_id string, page long, raw binary")
    text = sinks.classifier_json(pages).first().json
    assert json.loads(text) == {"data": 1, "database_definition": 1, "extended_usage_bitmap": 0, "intermediate_index": 0, "leaf_index": 0, "page_count": 5, "table_definition": 0, "unknown": {"9": 2, "200": 1}}
    assert text.index('"9"') < text.index('"200"')
    one = sinks.canonical_lines(spark.createDataFrame([(1, None)], "b int, a string")).first().value
    assert one == '{"a":null,"b":1}'


def test_stream_of_captures(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "x").write_bytes(b"a" * 8 + b"b" * 8)
    capture.start(spark, str(source), out, page_size=8).awaitTermination()
    (source / "y").write_bytes(b"c" * 8)
    capture.start(spark, str(source), out, page_size=8).awaitTermination()
    changes = spark.read.parquet(f"{out}/changes")
    assert {(r.batch, r.image_id, r.page, r.status) for r in changes.collect()} == {(0, "x", 0, "added"), (0, "x", 1, "added"), (1, "y", 0, "added")}
    assert spark.read.parquet(f"{out}/state/1").count() == 3


def test_stream_step(spark):
    state = spark.createDataFrame([("x", 0, "old"), ("x", 1, "gone"), ("z", 0, "kept")], capture.STATE)
    now = spark.createDataFrame([("x", 4, b"abcd")], "image_id string, length long, content binary")
    changes = capture.step(now, state, 4)
    assert {(r.page, r.status) for r in changes.collect()} == {(0, "changed"), (1, "removed")}
    assert {(r.image_id, r.page) for r in capture.after(state, changes).collect()} == {("x", 0), ("z", 0)}


def test_budgets(spark):
    images_ = spark.createDataFrame([("a", 3), ("b", 30)], "image_id string, n long")
    checked = budget.preflight(images_, budget.scan_cost(F.col("n"), 2048), {"page_visits": 10, "work": 7000})
    assert {r.image_id: r.error_code for r in checked.collect()} == {"a": None, "b": "page_visits_limit_exceeded"}
    with pytest.raises(Exception, match="page_visits_limit_exceeded"):
        budget.enforced(checked).collect()
    from pyspark.sql import Observation

    seen = Observation("n")
    checked.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 2}


def test_unsupported_traversal():
    assert decode.unsupported_traversal("raw_reference") == "unsupported_raw_reference"
    with pytest.raises(ValueError, match="other"):
        decode.unsupported_traversal("other")


def test_packed_bytes(spark):
    raw = spark.range(1).select(generators.packed_bytes(5, lambda i: i * 50)).first()[0]
    assert bytes(raw) == struct.pack("5B", 0, 50, 100, 150, 200)
