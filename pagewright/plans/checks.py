"""Queries of checks and small projections that other queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bytes import read_float, write_float, write_int
from ..operators import census, checkpoints, decode, evidence, snapshot
from ..sources.sinks import patched
from .census import KIND, D, P, byte_of, images, text_pages


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_image_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 and size of whole images."""
    return census.image_digests(images(spark, sf_dir)).select("image_id", "length", "sha256")


def classified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its kind and, where unknown, its first byte."""
    return census.classified(text_pages(spark, sf_dir)).select("image_id", "page", "kind", "tag")


def touched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 64 bytes that an order's changed offsets touch."""
    offsets = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4096).alias("off"))
    return census.touched_pages(offsets, 64, "l_orderkey")


def candidate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many half-open intervals each image has: counted, never made."""
    return images(spark, sf_dir).select("image_id", checkpoints.interval_count(F.col("length")).alias("n_intervals"))


def history_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as replicas, nation keys mod 7 as checkpoints: missing, unknown, short of pages, with a bad digest."""
    k = F.col("n_nationkey") % 7
    counts = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("replica"), F.concat(F.lit("C"), k.cast("string")).alias("checkpoint"), k.alias("ordinal"), F.when(k == 3, 3).otherwise(2).alias("page_count")).distinct()
    digest = F.sha2(F.col("checkpoint").cast("binary"), 256)
    pages = counts.select("replica", "checkpoint", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), F.when(F.col("ordinal") == 2, F.upper(digest)).otherwise(digest).alias("sha256"))
    return checkpoints.history_errors(pages, counts, [f"C{i}" for i in range(5)])


def in_use_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in use by records that parts make: a base and eight bits, set or clear."""
    record = F.concat(F.lit(b"\0"), write_int(F.col("p_partkey"), 4), write_int(F.col("p_size"), 1))
    rows = _read(spark, sf_dir, "part").select("p_partkey", record.alias("record"))
    every = [rows.select("p_partkey", F.lit(p).alias("polarity"), F.explode(checkpoints.in_use_pages(F.col("record"), p).cast("array<long>")).alias("page")) for p in checkpoints.POLARITIES]
    return every[0].unionByName(every[1])


def polarity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of small orders against those of large ones, by line and flag."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("replica"), F.col("l_returnflag").alias("checkpoint"), F.col("l_suppkey").alias("page"), "l_quantity")
    return checkpoints.polarity_conflicts(rows.where("l_quantity < 5"), rows.where("l_quantity >= 40"))


def matched_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases with labels as their metrics."""
    cases, metrics = _read(spark, sf_dir, "documents").select("doc_id", "n_chars"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    return evidence.matched_cases(cases, metrics, "doc_id")[0].select("doc_id", "n_chars", "quality")


def joined_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mutants, returned lines as their producer's records: identities that only one side has."""
    mutants = _read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    producer = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return evidence.joined_mutants(mutants, producer)[1]


def exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown and missing keys of each customer's two."""
    found = F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "id").otherwise("x"))
    keys = evidence.exact_keys(found, ["BUILDING", "id"])
    return _read(spark, sf_dir, "customer").select("c_custkey", *[F.array_join(v, ",").alias(k) for k, v in keys.items()])


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First byte and end of the page that each part's key names."""
    return _read(spark, sf_dir, "part").select("p_partkey", *[v.alias(f"byte_{k}") for k, v in decode.page_range(F.col("p_partkey"), 2048).items()])


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of times that say they are UTC, in two ways; a third way does not."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    says = F.element_at(F.array(F.lit("Z"), F.lit("+00:00"), F.lit("+02:00")), (F.col("event_id") % 3 + 1).cast("int"))
    written = F.concat(F.lit("2024-01-"), two(F.col("event_id") % 28 + 1), F.lit("T"), two(F.col("event_id") % 24), F.lit(":30:00"), says)
    return _read(spark, sf_dir, "events").select("event_id", F.unix_seconds(text.utc_time(written)).alias("seconds"))


def float_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as little-endian doubles and singles and read back, and the single's canonical text."""
    quarter = F.col("p_size") / 4
    back = read_float(write_float(quarter, 4), 0, 4)
    return _read(spark, sf_dir, "part").select("p_partkey", read_float(write_float(F.col("p_retailprice"), 8), 0, 8).alias("price"), back.alias("quarter"), text.canonical_single(quarter).alias("spelled"))


def patched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names with two bytes written over, null where they do not fit."""
    new = patched(F.encode("n_name", "UTF-8"), F.col("n_nationkey") % 10, F.lit(b"##"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", F.decode(new, "UTF-8").alias("patched"))


def sorted_map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a map in the order of its keys."""
    made = F.create_map(F.col("p_type"), F.lit(1), F.lit("name"), F.lit(2), F.lit("SIZE"), F.lit(3))
    entries = F.map_entries(snapshot.sorted_map(made))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


QUERIES = {
    f.__name__: f
    for f in (
        whole_image_digests, classified_pages, touched_pages, candidate_intervals, history_errors, in_use_pages, polarity_conflicts, matched_cases, joined_mutants, exact_keys, page_ranges, utc_times,
        float_bytes, patched_names, sorted_map_keys,
    )
}

SQL = {
    "whole_image_digests": f"WITH {D} SELECT image_id, length, sha256(b) AS sha256 FROM d",
    "classified_pages": f"WITH {P}, k AS (SELECT image_id, page, {KIND} AS kind, v FROM (SELECT image_id, page, {byte_of('x', 0)} AS v FROM p)) SELECT image_id, page, kind, CASE WHEN kind = 'unknown' THEN v END AS tag FROM k",
    "touched_pages": "SELECT DISTINCT l_orderkey, (l_partkey % 4096) // 64 AS page FROM lineitem",
    "candidate_intervals": f"WITH {D} SELECT image_id, length * (length + 1) // 2 AS n_intervals FROM d",
    "history_errors": """WITH c AS (SELECT DISTINCT n_regionkey AS replica, n_nationkey % 7 AS k FROM nation), w AS (SELECT DISTINCT replica, i AS k FROM c, range(0, 5) r(i))
      SELECT replica, 'C' || k AS checkpoint, 'missing_checkpoint' AS error_code FROM w WHERE (replica, k) NOT IN (FROM c)
      UNION ALL SELECT replica, 'C' || k, CASE WHEN k > 4 THEN 'unknown_checkpoint' WHEN k = 3 THEN 'pages_not_contiguous' ELSE 'bad_digest' END FROM c WHERE k > 4 OR k IN (2, 3)""",
    "in_use_pages": """WITH b AS (SELECT p_partkey, p_partkey + i AS page, (p_size >> i::INT) & 1 AS bit FROM part, range(0, 8) r(i))
      SELECT p_partkey, CASE bit WHEN 1 THEN 'set_means_in_use' ELSE 'set_means_not_in_use' END AS polarity, page FROM b""",
    "polarity_conflicts": """WITH l AS (SELECT DISTINCT l_linenumber AS replica, l_returnflag AS checkpoint, l_suppkey AS page, l_quantity < 5 AS a, l_quantity >= 40 AS b FROM lineitem),
      x AS (SELECT replica, checkpoint, page FROM l WHERE a), y AS (SELECT replica, checkpoint, page FROM l WHERE b)
      SELECT *, 'predicted_only' AS side FROM (FROM x EXCEPT FROM y) UNION ALL SELECT *, 'inline_only' FROM (FROM y EXCEPT FROM x)""",
    "matched_cases": "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)",
    "joined_mutants": """WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
      SELECT id, 'left_only' AS side FROM a WHERE id NOT IN (FROM b) UNION ALL SELECT id, 'right_only' FROM b WHERE id NOT IN (FROM a)""",
    "exact_keys": """WITH c AS (SELECT c_custkey, [c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE 'x' END] AS k FROM customer)
      SELECT c_custkey, array_to_string(list_sort(list_filter(k, lambda x: x NOT IN ('BUILDING', 'id'))), ',') AS unknown, array_to_string(list_filter(['BUILDING', 'id'], lambda x: NOT list_contains(k, x)), ',') AS missing FROM c""",
    "page_ranges": "SELECT p_partkey, p_partkey * 2048 AS byte_start, p_partkey * 2048 + 2048 AS byte_end FROM part",
    "utc_times": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch(make_timestamp(2024, 1, event_id % 28 + 1, event_id % 24, 30, 0.0))::BIGINT END AS seconds FROM events",
    "float_bytes": "SELECT p_partkey, p_retailprice AS price, p_size / 4 AS quarter, (p_size // 4) || CASE p_size % 4 WHEN 0 THEN '.0' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS spelled FROM part",
    "patched_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 10 + 2 <= strlen(n_name) THEN substr(n_name, 1, (n_nationkey % 10)::BIGINT) || '##' || substr(n_name, (n_nationkey % 10 + 3)::BIGINT) END AS patched FROM nation",
    "sorted_map_keys": "SELECT p_partkey, array_to_string(list_sort([p_type || '=1', 'SIZE=3', 'name=2']), ',') AS entries FROM part",
}
