"""Readers of evidence files: strict JSON, manifests, benchmark trees, coverage, mutants, page stores.

Schemas are declared, never inferred; a file that does not fit fails the query.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .images import PAGE_SIZE

MANIFEST = "files array<struct<id string, path string, size_bytes bigint, sha256 string>>"
ESTIMATES = "median struct<point_estimate double>"
BENCHMARK = "group_id string, function_id string, value_str string, full_id string, throughput struct<Bytes bigint, Elements bigint>"
#: A scenario is an object for a mutant and a word for the baseline, so it is read as text first.
OUTCOMES = "outcomes array<struct<scenario string, summary string>>"
MUTANT = "Mutant struct<file string, function struct<function_name string>, span struct<start struct<line bigint>>, genre string>"


def _json_error(text: str | None, max_bytes: int, max_depth: int, max_nodes: int) -> str | None:
    if text is None:
        return "missing"
    if len(text.encode()) > max_bytes:
        return "too_large"

    class Repeated(ValueError):
        pass

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise Repeated
        return dict(items)

    def constant(name):
        raise ValueError(name)

    def finite(digits):
        value = float(digits)
        if math.isinf(value):
            raise ValueError(digits)
        return value

    try:
        top = json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=finite)
    except Repeated:
        return "duplicate_key"
    except (ValueError, RecursionError):
        return "malformed"
    nodes, todo = 0, [(top, 1)]
    while todo:
        one, depth = todo.pop()
        nodes += 1
        if nodes > max_nodes:
            return "too_many_nodes"
        if depth > max_depth:
            return "too_deep"
        if isinstance(one, dict | list):
            todo += [(x, depth + 1) for x in (one.values() if isinstance(one, dict) else one)]
    return None


def json_errors(max_bytes: int = 1 << 20, max_depth: int = 64, max_nodes: int = 100_000):
    """A function of a text column: why it is refused as strict JSON, or null.

    Repeated keys, numbers that are not finite and bounds of size, nodes and depth are beyond the
    built-in reader, so this one is a pandas function.
    """

    @F.pandas_udf(T.StringType())
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _json_error(t, max_bytes, max_depth, max_nodes))

    return check


def strict_json(spark: SparkSession, path: str, schema: str, *, max_bytes: int = 1 << 20) -> DataFrame:
    """(path, doc, error_code) of JSON files: doc by the declared schema, null where the text is refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texts = files.select("path", F.decode("content", "UTF-8").alias("text")).withColumn("error_code", json_errors(max_bytes)(F.col("text")))
    doc = F.when(F.col("error_code").isNull(), F.from_json("text", schema, {"mode": "FAILFAST"}))
    return texts.select("path", doc.alias("doc"), "error_code")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, size, sha256) of a corpus manifest."""
    docs = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return docs.select(F.explode("files").alias("f")).select("f.id", "f.path", F.col("f.size_bytes").alias("size"), "f.sha256")


def tree_files(spark: SparkSession, root: str, *, max_entries: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(path below root, size, sha256, depth, error_code) of every file: deeper than allowed, or more than allowed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^/+", "/", root.rstrip("/").removeprefix("file:")) + "/"
    below = F.substr(F.col("path"), F.position(F.lit(base), F.col("path")) + len(base))
    out = files.select(below.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    out = out.withColumn("depth", F.size(F.split("path", "/")))
    code = F.when(F.col("depth") > max_depth, "too_deep") if max_depth else F.lit(None).cast("string")
    if max_entries is not None:
        n = out.agg(F.count(F.lit(1)).alias("n_entries"))
        out = out.join(n)
        code = F.coalesce(code, F.when(F.col("n_entries") > max_entries, "too_many_entries"))
        return out.withColumn("error_code", code).drop("n_entries")
    return out.withColumn("error_code", code)


def verified_corpus(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Corpus entries with error_code against the files found."""
    both = listed.join(files.select("path", F.col("size").alias("real_size"), F.col("sha256").alias("real_sha256")), "path", "left")
    code = F.when(F.col("real_size").isNull(), "missing_file").when(F.col("size") != F.col("real_size"), "size_differs").when(F.col("sha256") != F.col("real_sha256"), "digest_differs")
    return both.withColumn("error_code", code)


def without_quarantined(files: DataFrame, word: str = "quarantine") -> DataFrame:
    return files.where(~F.col("path").contains(word))


def page_store(spark: SparkSession, root: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """(sha256, raw, error_code) of a content-addressed page store: the file's name is its digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"/([0-9a-f]{64})(?:\.bin)?\z", 1)
    code = F.when(name == "", "bad_name").when(F.col("length") != page_size, "bad_size").when(F.sha2("content", 256) != name, "digest_differs")
    return files.select(name.alias("sha256"), F.col("content").alias("raw"), code.alias("error_code"))


def benchmark_tree(spark: SparkSession, root: str) -> DataFrame:
    """(full_id, group_id, unit, quantity, median_ns) of a benchmark result tree: one new/ folder a case."""
    read = lambda schema, name: spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("multiLine", "true").option("mode", "FAILFAST").json(root)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/new/[^/]*$", 1)
    cases = read(BENCHMARK, "benchmark.json").select("*", folder.alias("at")).where("at <> ''")
    times = read(ESTIMATES, "estimates.json").select(F.col("median.point_estimate").alias("median_ns"), folder.alias("at")).where("at <> ''")
    unit = F.when(F.col("throughput.Bytes").isNotNull(), "Bytes").when(F.col("throughput.Elements").isNotNull(), "Elements")
    return cases.join(times, "at", "left").select("full_id", "group_id", unit.alias("unit"), F.coalesce("throughput.Bytes", "throughput.Elements").alias("quantity"), "median_ns")


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, covered, total) lines of LCOV reports: a record is one multi-line value up to end_of_record."""
    records = spark.read.option("lineSep", "end_of_record\n").text(path).select(F.col("value").alias("r")).where("r rlike '(?m)^SF:'")
    lines = F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))
    hit = F.filter(lines, lambda x: ~x.endswith(",0"))
    return records.select(F.regexp_extract("r", r"(?m)^SF:([^\n\r]*)", 1).alias("file"), F.size(hit).cast("long").alias("covered"), F.size(lines).cast("long").alias("total"))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, covered, total) lines of an LLVM coverage export."""
    schema = "data array<struct<files array<struct<filename string, summary struct<lines struct<count bigint, covered bigint>>>>>>"
    docs = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    files = docs.select(F.explode("data").alias("d")).select(F.explode("d.files").alias("f"))
    return files.select(F.col("f.filename").alias("file"), F.col("f.summary.lines.covered").alias("covered"), F.col("f.summary.lines.count").alias("total"))


def mutant_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, function, genre, status) of a mutation run; the baseline has no mutant and goes."""
    docs = spark.read.schema(OUTCOMES).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    m = F.col("m.Mutant")
    status = F.when(F.col("o.summary") == "CaughtMutant", "killed").when(F.col("o.summary") == "MissedMutant", "survived").otherwise(F.lower("o.summary"))
    rows = docs.select(F.explode("outcomes").alias("o")).where("o.scenario like '{%'")
    rows = rows.select("o", F.from_json("o.scenario", MUTANT, {"mode": "FAILFAST"}).alias("m")).where(m.isNotNull())
    return rows.select(m["file"].alias("file"), m["span"]["start"]["line"].alias("line"), m["function"]["function_name"].alias("function"), m["genre"].alias("genre"), status.alias("status"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, lines numbered from 1 within each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\n", -1)).alias("at", "value")).select("path", (F.col("at") + 1).alias("line_no"), "value")
