"""Updates in place, canonical lines, probe reports, document schemas, and rules of the second experiment."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import checkpoints, decode, evidence, snapshot
from pagewright.sources import evidence as files
from pagewright.sources import schemas, sinks


def test_update(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    (tmp_path / "t").chmod(0o750)
    seen = []
    sinks.update(spark, path, lambda df: df.where("id > 1"), validate=lambda df: df.count() == 3, hook=seen.append)
    assert tuple(seen) == sinks.UPDATE_STAGES
    assert spark.read.parquet(path).count() == 3
    assert (tmp_path / "t").stat().st_mode & 0o777 == 0o750
    for stage in sinks.UPDATE_STAGES[:-1]:
        seen = []

        def fail(at, stage=stage, seen=seen):
            seen.append(at)
            if at == stage:
                raise RuntimeError(at)

        with pytest.raises(RuntimeError, match=stage):
            sinks.update(spark, path, lambda df: df.limit(0), validate=lambda df: True, hook=fail)
        assert seen[-1] == "cleanup"
        assert spark.read.parquet(path).count() == 3
        assert [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError, match="validation"):
        sinks.update(spark, path, lambda df: df, validate=lambda df: False)
    with pytest.raises(ValueError, match="copy_limit"):
        sinks.update(spark, path, lambda df: df, validate=lambda df: True, max_bytes=10)
    with pytest.raises(FileNotFoundError):
        sinks.update(spark, str(tmp_path / "none"), lambda df: df, validate=lambda df: True)
    (tmp_path / "t").rename(tmp_path / "t.previous")
    sinks.update(spark, path, lambda df: df, validate=lambda df: df.count() == 3)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_canonical_lines_at_depth(spark):
    row = ({"z": 1, "a": None}, [("q\n", 1.5)][0], [1e300, None, 0.1], True, bytearray(b"a"))
    df = spark.createDataFrame([row], "m map<string,int>, s struct<y string, x double>, f array<double>, b boolean, r binary")
    assert sinks.canonical_lines(df).first().value == '{"b":true,"f":[1e+300,null,0.1],"m":{"a":null,"z":1},"r":"YQ==","s":{"x":1.5,"y":"q\\n"}}'
    with pytest.raises(Exception, match="not_finite"):
        sinks.canonical_lines(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    with pytest.raises(ValueError, match="collections"):
        sinks.canonical_lines(spark.createDataFrame([({"a": 1.0},)], "x map<string,double>"))


def test_probe_reports(spark):
    rows = spark.createDataFrame([("a", 4096, "standard", 2, 4098, "00ff", None), ("b", 1, None, None, None, None, "short_read")], "image_id string, length long, kind string, pages_visited long, work_units long, fnv1a64 string, error_code string")
    got = {r.image_id: json.loads(r.json) for r in sinks.probe_json(rows).collect()}
    assert got["a"]["raw_scan"] == {"checksum_algorithm": "fnv1a64", "checksum_hex": "00ff", "pages_read": 2, "bytes_read": 4096, "hash_work_units": 4096, "total_work_units": 4098}
    assert got["a"]["candidate_geometry"] == {"page_size_bytes": 2048, "page_count": 2, "source_length_bytes": 4096}
    assert got["a"]["caveats"] == list(sinks.CAVEATS)
    assert got["b"] == {"schema_version": 1, "ok": False, "error": "short_read", "compatibility_established": False}


def test_schemas(spark):
    schema = {"type": ["object", "null"], "properties": {"a": {"anyOf": [{"const": 1}, {"type": "string", "minLength": 2}]}, "l": {"maxItems": 1, "minItems": 1}, "n": {"minimum": 0, "maximum": 2}}, "additionalProperties": {"type": "boolean"}}
    texts = {
        "null": None, '{"a":1}': None, '{"a":"xy","z":true}': None, '{"a":"x"}': "$.a: anyOf", '{"z":1}': "$.z: type", '{"l":[]}': "$.l: minItems", '{"l":[1,2]}': "$.l: maxItems", '{"l":3}': None,
        '{"n":-1}': "$.n: minimum", '{"n":2.5}': "$.n: maximum", '{"n":true}': None, "[]": "$: type", "{": "malformed", '{"a":1,"a":1}': "duplicate_key",
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.e for r in df.select("t", schemas.schema_errors(schema)(F.col("t")).alias("e")).collect()}
    assert got == texts | {None: "missing"}
    with pytest.raises(ValueError, match="multipleOf"):
        schemas.schema_errors({"properties": {"a": {"multipleOf": 2}}})


def test_readers_of_odd_files(spark, tmp_path):
    (tmp_path / "big.json").write_text('{"a": 1e999}')
    assert files.strict_json(spark, str(tmp_path), "a double").first().error_code == "malformed"
    root = tmp_path / "x+y (1).d"
    (root / "in").mkdir(parents=True)
    (root / "in" / "f").write_text("abc")
    for given in (str(root), f"file:{root}", f"file://{root}/"):
        assert [(r.path, r.depth) for r in files.tree_files(spark, given).collect()] == [("in/f", 2)]
    (tmp_path / "m.json").write_text(json.dumps({"outcomes": [{"scenario": "Baseline", "summary": "Success"}, {"scenario": {"Mutant": {"file": "a", "genre": "g"}}, "summary": "Unviable"}]}))
    assert [(r.file, r.status) for r in files.mutant_outcomes(spark, str(tmp_path / "m.json")).collect()] == [("a", "unviable")]


def test_growth_targets_of_shrinking_tables(spark):
    sizes = [5, 3, 12, 7, 12, 40]
    states = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "replica int, ordinal int, page_count long")
    got = {r.threshold: (r.ordinal, r.overshoot) for r in evidence.growth_targets(states, [4, 6, 12, 13, 41, 6], "replica").collect()}
    want = {t: next(((i, n - t) for i, n in enumerate(sizes) if n >= t), None) for t in (4, 6, 12, 13, 41)}
    assert got == {t: v for t, v in want.items() if v}


def test_subtrees_of_a_diff(spark):
    side = lambda *rows: spark.createDataFrame(rows, "path string, type string, value string")
    left = side(("/a/1/x", "long", "1"), ("/a/1/y", "long", "2"), ("/a/2/x", "long", "3"), ("/l", "array", "2"))
    right = side(("/a/1/x", "long", "9"), ("/a/2/x", "text", "3"), ("/l", "array", "3"), ("/a/11/x", "long", "0"))
    allowed = spark.createDataFrame([("/a/1",), ("/a/1/x",), ("/b",)], "path string")
    got = {(r.path, r.error_code) for r in snapshot.deep_diff(left, right, allowed).collect()}
    unseen = "allowed_difference_not_observed"
    assert got == {("/a/1/x", unseen), ("/b", unseen), ("/a/2/x", "type_difference"), ("/l", "length_difference"), ("/a/11/x", "key_difference")}
    assert snapshot.deep_diff(left, right, spark.createDataFrame([("",)], "path string")).isEmpty()


def test_strict_formulas(spark):
    """A bit left out, or one too many, fails the strict rule; a transition without growth wants no new bit."""
    def extended(bits):
        raw = bytearray(decode.PAGE_SIZE)
        raw[0] = 5
        for b in bits:
            raw[4 + b // 8] |= 1 << (b % 8)
        return bytes(raw)

    n = {"g0": 40, "g1": 50, "g2": 50}
    bits = {1: {"g0": range(40), "g1": range(50), "g2": range(50)}, 2: {"g0": range(40), "g1": range(49), "g2": range(49)}, 3: {"g0": range(40), "g1": range(50), "g2": range(51)}}
    edges = [(r, o, k, 0, 3, extended(v[k]), None) for r, v in bits.items() for o, k in enumerate(n)]
    edges = spark.createDataFrame(edges, "replica int, ordinal int, checkpoint string, slot int, ref long, raw binary, error_code string")
    counts = spark.createDataFrame([(r, k, v) for r in bits for k, v in n.items()], "replica int, checkpoint string, page_count long")
    got = checkpoints.strict_formulas(edges, counts, [("g0", "g1"), ("g1", "g2")])
    assert [(r.replica, r.formula) for r in got.collect()] == [(1, "slot_relative_expected_0_16352")]


def test_joint_models_and_their_ceiling(spark):
    rows = [(r, 1, o, "a", role) for r in (1, 2) for o, role in ((1, "used"), (2, "used"), (5, "free"))] + [(1, 1, 9, "a", "free")]
    pointers = spark.createDataFrame(rows, "replica int, page long, off int, layout string, role string")
    formulas = spark.createDataFrame([(1, "f"), (1, "g"), (2, "g")], "replica int, formula string")
    assert tuple(checkpoints.joint_models(pointers, formulas, 2, 12).first()) == (12, 2, None)
    assert tuple(checkpoints.joint_models(pointers, formulas, 2, 11).first()) == (12, None, "resource_bound")
    assert tuple(checkpoints.joint_models(pointers.limit(0), formulas, 2, 11).first()) == (0, 0, None)
