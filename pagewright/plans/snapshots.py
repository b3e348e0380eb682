"""Queries over typed table snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_double, case_id, has_shape, payload, pointer_token, safe_path, throughput
from ..operators import snapshot as ops

PART_KINDS = {"p_name": "text", "p_size": "long", "p_type": "text"}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _rows(parts: DataFrame, key: Column, name: str = "part") -> DataFrame:
    return ops.from_table(parts, "s", name, key, PART_KINDS)


def canonical_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key and canonical JSON, numbers as they are spelled there, equal ones kept: a digest of the JSON at each position."""
    parts = _parts(spark, sf_dir).withColumns({"p_double": F.col("p_size") * 1e14, "p_single": (F.col("p_size") / 4).cast("float")})
    rows = ops.from_table(parts, "s", "part", F.col("p_partkey") % 100, PART_KINDS | {"p_double": "double", "p_single": "single"})
    placed = ops.ordered_rows(rows, ops.values_json(F.col("values")))
    return placed.select("canonical_key", F.col("position").cast("long").alias("position"), F.sha2("canon", 256).alias("canon_sha256"))


def row_order_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of their part key that stand before their predecessor."""
    rows = _parts(spark, sf_dir).select(F.lit("s").alias("snapshot_id"), F.lit("part").alias("table_name"), F.col("p_name").alias("canonical_key"), F.col("p_type").alias("canon"), F.col("p_partkey").alias("position"))
    return ops.row_order(rows).where("error_code is not null").select("position", "error_code")


def named_order_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names within a region, in key order: out of order or repeated."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return ops.named_order(nations, "region")


def snapshot_deep_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of parts: some rows missing, sizes moved, one type changed, some of that allowed."""
    parts, key = _parts(spark, sf_dir), F.col("p_partkey")
    left = ops.flattened(_rows(parts, key))
    moved = parts.where("p_partkey % 17 <> 3").withColumn("p_size", F.when(F.col("p_partkey") % 10 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))
    right = ops.flattened(_rows(moved, key)).withColumn("type", F.when(F.col("path").endswith("9/p_name"), F.lit("memo")).otherwise(F.col("type")))
    allowed = spark.createDataFrame([("/part/11/p_size",), ("/part/12/p_size",), ("/part/999/p_size",)], "path string")
    return ops.deep_diff(left, right, allowed)


def typed_value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order columns as typed values of kinds that do not fit all of them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = lambda k, c: F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value"))
    values = [
        value("byte", F.col("o_orderkey") % 300),
        value("integer", F.col("o_orderkey") * 5 - 300),
        value("text", F.col("o_orderstatus")),
        value("boolean", F.when(F.col("o_orderkey") % 4 == 0, "yes").otherwise("true")),
        value("decimal", F.concat(F.lit("0"), (F.col("o_orderkey") % 3).cast("string"))),
        value("guid", F.lit("0f8fad5b-d9cb-469f-a165-70867728950e")),
        value("binary", F.hex(F.col("o_orderkey") % 200)),
        value("null", F.when(F.col("o_orderkey") % 2 == 0, F.lit("x"))),
        value("datetime", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")),
        value("odd", F.lit("1")),
    ]
    rows = orders.select("o_orderkey", F.explode(F.array(*values)).alias("t")).select("o_orderkey", "t.kind", "t.value")
    code = ops.value_error(F.col("kind"), F.col("value"))
    return rows.select("kind", code.alias("error_code")).groupBy("kind", "error_code").agg(F.count(F.lit(1)).alias("n"))


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, times and ids made from orders, and whether they have their shapes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    digest = F.when(F.col("id") % 3 == 0, F.upper(F.sha2(F.col("id").cast("string").cast("binary"), 256))).otherwise(F.sha2(F.col("id").cast("string").cast("binary"), 256))
    time = F.concat(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("id") % 2 == 0, ".5").when(F.col("id") % 5 == 0, "Z").otherwise(""))
    scenario = F.concat(F.lit("DAO-READ-"), F.when(F.col("id") % 4 == 0, "ab1").otherwise("T-"), F.col("id").cast("string"))
    return o.select("id", has_shape(digest, "sha256").alias("is_digest"), has_shape(time, "datetime").alias("is_time"), has_shape(scenario, "scenario_id").alias("is_scenario"))


def float_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of doubles of which SQL can tell the spelling: whole numbers and quarters."""
    parts = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"))
    return parts.select("id", canonical_double(F.col("id").cast("double")).alias("whole"), canonical_double(F.col("id") / 4).alias("quarter"), canonical_double(F.col("id").cast("double") * -1e3).alias("thousands"))


def evidence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case ids, pointer tokens, throughputs and path checks of parts."""
    p = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), "p_type", "p_name", "p_size")
    path = F.concat(F.when(F.col("id") % 5 == 0, F.lit("../")).when(F.col("id") % 7 == 0, F.lit("/")).otherwise(""), F.col("p_size").cast("string"), F.lit("/"), F.col("id").cast("string"))
    unit = F.when(F.col("id") % 3 == 0, "Bytes").when(F.col("id") % 3 == 1, "Elements").otherwise("Lines")
    return p.select(
        "id",
        case_id(F.lit("g"), F.concat(F.lit("g/"), F.col("id").cast("string"))).alias("case_id"),
        pointer_token(F.concat(F.lit("a~b/"), F.col("id").cast("string"))).alias("token"),
        throughput(F.col("p_size"), (F.col("id") % 4).cast("double"), unit).alias("per_second"),
        safe_path(path).alias("safe"),
    )


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of 240 characters by role and id."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.sha2(payload(F.lit("L"), F.col("c_custkey")).cast("binary"), 256).alias("payload_sha256"))


def scan_against_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered scan of customers against expected payloads: missing, unexpected and other rows."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    actual = c.where("id % 9 <> 4").select("id", payload(F.lit("L"), F.col("id")).alias("payload"))
    expected = c.where("id % 11 <> 5").select("id", payload(F.when(F.col("id") % 50 == 0, F.lit("H")).otherwise("L"), F.col("id")).alias("payload"))
    return ops.scan_matches(actual, expected)


def duplicate_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as fixtures by digest; equal ones are refused."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return ops.unique_digests(docs).select("doc_id", "sha256", "error_code")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_row_order, row_order_errors, named_order_errors, snapshot_deep_diff, typed_value_errors, text_shapes, float_spelling, evidence_names, payload_rows, scan_against_expected, duplicate_fixtures,
    )
}

#: 1e14 times a size of 1 to 50: fixed below 1e16; a size's quarter as a single.
_JSON = """'{"p_double":{"kind":"double","value":' || (p_size * 100000000000000) || '.0},"p_name":{"kind":"text","value":"' || p_name || '"},"p_single":{"kind":"single","value":' || (p_size // 4) || ['.0', '.25', '.5', '.75'][p_size % 4 + 1] || '},"p_size":{"kind":"long","value":' || p_size || '},"p_type":{"kind":"text","value":"' || p_type || '"}}'"""
_PAYLOAD = "left(repeat('A1|' || {role} || '|' || {id} || '|', 240), 240)"

SQL = {
    "canonical_row_order": f"""WITH r AS (SELECT (p_partkey % 100)::VARCHAR AS canonical_key, {_JSON} AS j FROM part)
      SELECT canonical_key, row_number() OVER (PARTITION BY canonical_key ORDER BY j) + (SELECT count(*) FROM r q WHERE q.canonical_key < r.canonical_key) AS position, sha256(j) AS canon_sha256 FROM r""",
    "row_order_errors": "WITH l AS (SELECT p_partkey AS position, p_name, p_type, lag(p_name) OVER w AS a, lag(p_type) OVER w AS b FROM part WINDOW w AS (ORDER BY p_partkey)) SELECT position, 'non_canonical_order' AS error_code FROM l WHERE a > p_name OR a = p_name AND b > p_type",
    "named_order_errors": """WITH l AS (SELECT n_regionkey AS region, n_name AS name, n_nationkey AS position, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)
      SELECT region, name, position, CASE WHEN b > name THEN 'non_canonical_order' WHEN b = name THEN 'duplicate' END AS error_code FROM l""",
    "snapshot_deep_diff": """WITH p AS (SELECT *, p_partkey % 17 <> 3 AS there, p_partkey % 10 = 1 AS moved FROM part),
      c AS (SELECT '/part/' || p_partkey || '/' || c AS path, c, there, moved FROM p, (VALUES ('p_name'), ('p_size'), ('p_type')) v(c)),
      d AS (SELECT path, path IN ('/part/11/p_size', '/part/12/p_size', '/part/999/p_size') AS allowed, CASE WHEN NOT there THEN 'key_difference' WHEN path LIKE '%9/p_name' THEN 'type_difference' WHEN c = 'p_size' AND moved THEN 'value_difference' END AS code FROM c)
      SELECT path, CASE WHEN allowed THEN 'allowed_difference_not_observed' ELSE code END AS error_code FROM d WHERE (allowed AND code IS NULL) OR (NOT allowed AND code IS NOT NULL)
      UNION ALL SELECT '/part/999/p_size', 'allowed_difference_not_observed' WHERE 999 NOT IN (SELECT p_partkey FROM part)""",
    "typed_value_errors": """WITH k AS (SELECT o_orderkey AS k FROM orders), t AS (
        SELECT 'byte' AS kind, CASE WHEN k % 300 > 255 THEN 'out_of_range' END AS error_code FROM k UNION ALL SELECT 'integer', CASE WHEN k * 5 - 300 > 32767 THEN 'out_of_range' END FROM k UNION ALL SELECT 'text', NULL FROM k
        UNION ALL SELECT 'boolean', CASE WHEN k % 4 = 0 THEN 'not_boolean' END FROM k UNION ALL SELECT 'decimal', 'not_decimal' FROM k UNION ALL SELECT 'guid', NULL FROM k
        UNION ALL SELECT 'binary', CASE WHEN NOT regexp_matches(CASE WHEN k % 200 < 16 THEN upper(to_hex(k % 200)) ELSE upper(to_hex(k % 200)) END, '^([0-9a-f]{2})*$') THEN 'not_hex' END FROM k
        UNION ALL SELECT 'null', CASE WHEN k % 2 = 0 THEN 'null_has_value' END FROM k UNION ALL SELECT 'datetime', NULL FROM k UNION ALL SELECT 'odd', 'unknown_kind' FROM k)
      SELECT kind, error_code, count(*) AS n FROM t GROUP BY 1, 2""",
    "text_shapes": """SELECT o_orderkey AS id, o_orderkey % 3 <> 0 OR NOT regexp_matches(sha256(o_orderkey::VARCHAR), '[a-f]') AS is_digest, o_orderkey % 2 = 0 OR o_orderkey % 5 <> 0 AS is_time, o_orderkey % 4 <> 0 AS is_scenario FROM orders""",
    "float_spelling": "SELECT p_partkey AS id, p_partkey || '.0' AS whole, (p_partkey // 4) || CASE p_partkey % 4 WHEN 0 THEN '.0' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS quarter, '-' || (p_partkey * 1000) || '.0' AS thousands FROM part",
    "evidence_names": """SELECT p_partkey AS id, 'g--' || upper(left(sha256('g/' || p_partkey), 16)) AS case_id, 'a~0b~1' || p_partkey AS token,
      CASE WHEN p_partkey % 3 < 2 AND p_partkey % 4 > 0 THEN p_size * 1e9::DOUBLE / (p_partkey % 4) END AS per_second, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS safe FROM part""",
    "payload_rows": f"SELECT c_custkey AS id, sha256({_PAYLOAD.format(role=chr(39) + 'L' + chr(39), id='c_custkey')}) AS payload_sha256 FROM customer",
    "scan_against_expected": """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 4 THEN 'missing_row' WHEN c_custkey % 11 = 5 THEN 'unexpected_row' ELSE 'payload_differs' END AS error_code FROM customer
      WHERE (c_custkey % 9 = 4) <> (c_custkey % 11 = 5) OR (c_custkey % 9 <> 4 AND c_custkey % 11 <> 5 AND c_custkey % 50 = 0)""",
    "duplicate_fixtures": "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT *, CASE WHEN count(*) OVER (PARTITION BY sha256) > 1 THEN 'duplicate' END AS error_code FROM d",
}
