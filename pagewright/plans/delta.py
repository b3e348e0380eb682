"""Queries of replicated-delta analysis, on observations that arithmetic makes.

Six conditions (three versions, with and without encryption), six replicas, two
phases; a byte depends on its place, so that each predicate has offsets where it
holds and offsets where one thing keeps it from holding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta as ops
from ..sources.generators import observations

N = 64
VERSIONS, PLAIN, ENCRYPTED = (0, 1, 2), 0, 1


def _value(version: Column, encryption: Column, replica: Column, p: Column, i: Column) -> Column:
    base, k = (i * 7 + 13) % 256, i % 8
    return (
        F.when(k == 1, (base + version * 17) % 256)
        .when(k == 2, (base + F.when(version == 1, encryption).otherwise(0) * 5) % 256)
        .when(k == 3, base.bitwiseXOR((encryption * 90).cast("int")))
        .when(k == 4, (base + replica) % 256)
        .when(k == 5, (base + p * 3) % 256)
        .when(k == 6, (base + F.when((replica == 6) & (version == 1) & (encryption == 0), 1).otherwise(0)) % 256)
        .when(k == 7, (base + F.when(version == 2, 9).otherwise(0)) % 256)
        .otherwise(base)
    )


OBS = f"""o AS (SELECT 2 * version + encryption AS condition, version, encryption, replica, p, CASE p WHEN 0 THEN 'creator' ELSE 'reopen' END AS phase, i AS off,
  CASE i % 8 WHEN 1 THEN ((i * 7 + 13) % 256 + version * 17) % 256 WHEN 2 THEN ((i * 7 + 13) % 256 + CASE WHEN version = 1 THEN encryption ELSE 0 END * 5) % 256
    WHEN 3 THEN xor((i * 7 + 13) % 256, encryption * 90) WHEN 4 THEN ((i * 7 + 13) % 256 + replica) % 256 WHEN 5 THEN ((i * 7 + 13) % 256 + p * 3) % 256
    WHEN 6 THEN ((i * 7 + 13) % 256 + CASE WHEN replica = 6 AND version = 1 AND encryption = 0 THEN 1 ELSE 0 END) % 256
    WHEN 7 THEN ((i * 7 + 13) % 256 + CASE WHEN version = 2 THEN 9 ELSE 0 END) % 256 ELSE (i * 7 + 13) % 256 END AS v
  FROM range(0, 3) a(version), range(0, 2) b(encryption), range(1, 7) c(replica), range(0, 2) d(p), range(0, {N}) e(i))"""


def _obs(spark: SparkSession) -> DataFrame:
    return observations(spark, N, _value)


def _plain(spark: SparkSession) -> DataFrame:
    return _obs(spark).select("condition", "replica", "phase", "prefix")


def _conditions(spark: SparkSession) -> DataFrame:
    """Six rows: safe to broadcast."""
    return _obs(spark).select("condition", "version", "encryption").distinct()


def paired_phase_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between a sample's two phases."""
    return ops.pair_counts(ops.paired_phase(_plain(spark)), F.col("left_condition").alias("condition"), F.col("left_replica").alias("replica"))


def within_condition_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between replicas of a condition and phase."""
    pairs = ops.within_condition(_plain(spark))
    return ops.pair_counts(pairs, F.col("left_condition").alias("condition"), F.col("left_phase").alias("phase"), "left_replica", "right_replica")


def _matched(spark: SparkSession) -> DataFrame:
    obs, conditions = _plain(spark), _conditions(spark)
    keep = ("kind", "left_replica", "left_phase", "left_condition", "right_condition", "offs")
    return ops.matched_factor(obs, conditions, "version", [0, 1, 2]).select(*keep).unionByName(ops.matched_factor(obs, conditions, "encryption", [0, 1]).select(*keep))


def matched_factor_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that differ in one factor only."""
    return ops.pair_counts(_matched(spark), "kind", F.col("left_replica").alias("replica"), F.col("left_phase").alias("phase"), "left_condition", "right_condition")


def factor_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each offset differs, by kind of pair."""
    return ops.occurrences(_matched(spark))


def mask_occurrence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets by the number of version pairs that differ there: union and intersection of masks."""
    return ops.mask_histogram(_matched(spark), N, "kind")


def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets that some within-condition pair has, and those that every version pair has."""
    union = ops.union_mask(ops.within_condition(_plain(spark)), N).withColumn("mask", F.lit("within_union"))
    both = ops.intersection_mask(_matched(spark).where("kind = 'matched_version'"), N).withColumn("mask", F.lit("version_intersection"))
    return union.unionByName(both)


def _cells(spark: SparkSession) -> DataFrame:
    return ops.cells(_plain(spark), 0, N)


def cohort_variable_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets where a condition's replicas and phases differ."""
    return ops.cohort_variable(_cells(spark))


def stable_delta_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets constant in conditions 0 and 3 and different between them."""
    return ops.stable_deltas(_cells(spark), F.col("condition") == 0, F.col("condition") == 3)


def stable_condition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one value of each condition and offset, or null."""
    return ops.stable_values(_cells(spark), "condition")


def factor_candidate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets where a factor predicate holds."""
    return ops.factor_offsets(_cells(spark), _conditions(spark), VERSIONS, PLAIN, ENCRYPTED)


def candidate_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidate sets come to."""
    return ops.candidate_outcome(factor_candidate_offsets(spark, sf_dir))


def _compact(spark: SparkSession) -> DataFrame:
    """Three roles, three replicas of each condition's stable bytes; one offset of the later roles moved."""
    stable = stable_condition_values(spark, "").where("v is not null").withColumn("version", F.floor(F.col("condition") / 2))
    roles = F.explode(F.array(*map(F.lit, ("source_database", "compacted_database", "verify_database")))).alias("role")
    rows = stable.select("condition", "version", "off", "v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("replica")).select("*", roles)
    return rows.withColumn("v", F.when((F.col("off") == 8) & (F.col("role") != "source_database"), (F.col("v") + 1) % 256).otherwise(F.col("v")))


def compact_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether compacted databases agree with the created ones."""
    offsets = factor_candidate_offsets(spark, sf_dir)
    created = stable_condition_values(spark, sf_dir).where("v is not null")
    return ops.compact_outcome(_compact(spark), created, offsets.where("version").select("off"), offsets.where("middle_encryption").select("off"), 1)


def cohort_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and page counts of a source's texts in pages of 64 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return ops.length_variance(docs, "source", 64)


def stable_extra_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that every image of one cohort has and none of the other."""
    sizes = spark.range(24).select((F.col("id") % 2).alias("cohort"), (F.when(F.col("id") % 2 == 0, 40 + F.col("id") % 5).otherwise(50 + F.col("id") % 7) * 64).alias("length"))
    return ops.extra_pages(sizes, F.col("cohort") == 0, F.col("cohort") == 1, 64)


def _event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as conditions, hours as offsets, buckets of the value as values, days as replicas."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("condition"), F.hour("ts").alias("off"), F.dayofmonth("ts").alias("replica"), F.floor(F.col("value") / 20).alias("v"))


def reference_cardinality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sets by size."""
    return ops.cardinalities(ops.reference_sets(_event_cells(spark, sf_dir).where("replica <= 10")))


def novel_values_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later values that the reference sets of the first days lack, by set."""
    table = _event_cells(spark, sf_dir)
    novel = ops.novel_values(table.where("replica > 10"), ops.reference_sets(table.where("replica <= 10")))
    found = ops.novel_occurrences(novel)
    return found.select("condition", "off", "n", F.get("occurrences", F.lit(0))["replica"].alias("first_replica"), F.get("occurrences", F.lit(0))["v"].alias("first_v"))


def membership_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether later values extend the reference sets."""
    table = _event_cells(spark, sf_dir)
    return ops.membership_outcome(ops.novel_values(table.where("replica > 10"), ops.reference_sets(table.where("replica <= 10"))))


def bounded_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intake that stops one past its bound and is refused."""
    return ops.bounded_intake(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), 72)


QUERIES = {
    f.__name__: f
    for f in (
        paired_phase_diffs, within_condition_diffs, matched_factor_diffs, factor_occurrences, mask_occurrence_histogram, mask_union, cohort_variable_offsets, stable_delta_offsets,
        stable_condition_values, factor_candidate_offsets, candidate_outcome, compact_outcome, cohort_lengths, stable_extra_pages, reference_cardinality_histogram, novel_values_vs_reference,
        membership_outcome, bounded_intake,
    )
}

_COUNTS = "count(*) FILTER (l.v <> r.v)::INT AS n_diff, (min(l.off) FILTER (l.v <> r.v))::INT AS first_diff, (max(l.off) FILTER (l.v <> r.v))::INT AS last_diff"
_MATCHED = f"""{OBS}, m AS (
  SELECT 'matched_version' AS kind, l.replica, l.phase, l.condition AS left_condition, r.condition AS right_condition, l.off, l.v AS lv, r.v AS rv
  FROM o l JOIN o r ON l.encryption = r.encryption AND l.replica = r.replica AND l.p = r.p AND l.off = r.off AND l.version < r.version
  UNION ALL SELECT 'matched_encryption', l.replica, l.phase, l.condition, r.condition, l.off, l.v, r.v
  FROM o l JOIN o r ON l.version = r.version AND l.replica = r.replica AND l.p = r.p AND l.off = r.off AND l.encryption < r.encryption)"""
_STABLE = f"{OBS}, s AS (SELECT condition, any_value(version) AS version, any_value(encryption) AS encryption, off, CASE WHEN min(v) = max(v) THEN min(v) END AS v FROM o GROUP BY condition, off)"
_FACTORS = f"""{_STABLE}, w AS (SELECT off, {", ".join(f"max(v) FILTER (version = {a} AND encryption = {b}) AS v{a}{b}" for a in range(3) for b in range(2))} FROM s GROUP BY off),
  t AS (SELECT *, v00 IS NOT NULL AND v01 IS NOT NULL AND v10 IS NOT NULL AND v11 IS NOT NULL AND v20 IS NOT NULL AND v21 IS NOT NULL AS known FROM w),
  f AS (SELECT off::INT AS off, coalesce(known AND v00 = v01 AND v10 = v11 AND v20 = v21 AND v10 <> v00 AND v10 <> v20, false) AS version, coalesce(v10 <> v11, false) AS middle_encryption,
    coalesce(known AND xor(v00, v01) <> 0 AND xor(v00, v01) = xor(v10, v11) AND xor(v10, v11) = xor(v20, v21), false) AS all_encryption FROM t)"""
_EVENTS = "c AS (SELECT event_type AS condition, hour(ts)::INT AS off, day(ts)::INT AS replica, floor(value / 20)::BIGINT AS v FROM events), k AS (SELECT DISTINCT condition, off, v FROM c WHERE replica <= 10), n AS (SELECT * FROM c WHERE replica > 10 AND (condition, off, v) NOT IN (FROM k))"

SQL = {
    "paired_phase_diffs": f"WITH {OBS} SELECT l.condition::INT AS condition, l.replica::INT AS replica, {_COUNTS} FROM o l JOIN o r ON l.condition = r.condition AND l.replica = r.replica AND l.off = r.off AND l.p = 0 AND r.p = 1 GROUP BY 1, 2",
    "within_condition_diffs": f"WITH {OBS} SELECT l.condition::INT AS condition, l.phase, l.replica::INT AS left_replica, r.replica::INT AS right_replica, {_COUNTS} FROM o l JOIN o r ON l.condition = r.condition AND l.p = r.p AND l.off = r.off AND l.replica < r.replica GROUP BY 1, 2, 3, 4",
    "matched_factor_diffs": f"WITH {_MATCHED} SELECT kind, replica::INT AS replica, phase, left_condition::INT AS left_condition, right_condition::INT AS right_condition, count(*) FILTER (lv <> rv)::INT AS n_diff, (min(off) FILTER (lv <> rv))::INT AS first_diff, (max(off) FILTER (lv <> rv))::INT AS last_diff FROM m GROUP BY 1, 2, 3, 4, 5",
    "factor_occurrences": f"WITH {_MATCHED} SELECT kind, off::INT AS off, count(*) AS n FROM m WHERE lv <> rv GROUP BY 1, 2",
    "mask_occurrence_histogram": f"""WITH {_MATCHED}, n AS (SELECT kind, count(DISTINCT (replica, phase, left_condition, right_condition)) AS n_pairs FROM m GROUP BY 1), q AS (SELECT kind, off, count(*) AS occurrences FROM m WHERE lv <> rv GROUP BY 1, 2)
      SELECT q.kind, occurrences, count(*) AS n_offsets, occurrences = any_value(n_pairs) AS in_all FROM q JOIN n ON q.kind = n.kind GROUP BY 1, 2""",
    "mask_union": f"""WITH {_MATCHED}, u AS (SELECT DISTINCT l.off FROM o l JOIN o r ON l.condition = r.condition AND l.p = r.p AND l.off = r.off AND l.replica < r.replica WHERE l.v <> r.v)
      SELECT off::INT AS off, 'within_union' AS mask FROM u UNION ALL SELECT off::INT, 'version_intersection' FROM m WHERE kind = 'matched_version' GROUP BY off HAVING count(*) = count(*) FILTER (lv <> rv)""",
    "cohort_variable_offsets": f"WITH {OBS} SELECT condition::INT AS condition, off::INT AS off FROM o GROUP BY 1, 2 HAVING count(DISTINCT v) > 1",
    "stable_delta_offsets": f"""WITH {OBS}, a AS (SELECT off, min(v) AS v FROM o WHERE condition = 0 GROUP BY 1 HAVING min(v) = max(v)), b AS (SELECT off, min(v) AS v FROM o WHERE condition = 3 GROUP BY 1 HAVING min(v) = max(v))
      SELECT a.off::INT AS off, a.v::INT AS left_v, b.v::INT AS right_v FROM a JOIN b ON a.off = b.off WHERE a.v <> b.v""",
    "stable_condition_values": f"WITH {_STABLE} SELECT condition::INT AS condition, off::INT AS off, v::INT AS v FROM s",
    "factor_candidate_offsets": f"WITH {_FACTORS} SELECT * FROM f WHERE version OR middle_encryption OR all_encryption",
    "candidate_outcome": f"""WITH {_FACTORS}, n AS (SELECT count(*) FILTER (version) AS n_version, count(*) FILTER (middle_encryption) AS n_middle_encryption, count(*) FILTER (all_encryption) AS n_all_encryption FROM f)
      SELECT *, CASE WHEN n_version > 0 AND n_middle_encryption > 0 THEN 'candidate_offsets_observed' WHEN n_version + n_middle_encryption + n_all_encryption > 0 THEN 'inconclusive' ELSE 'no_candidates_observed' END AS outcome FROM n""",
    "compact_outcome": f"""WITH {_FACTORS}, r AS (SELECT condition, version, off, role, CASE WHEN off = 8 AND role <> 'source_database' THEN (v + 1) % 256 ELSE v END AS v, v AS was
        FROM s, (VALUES ('source_database'), ('compacted_database'), ('verify_database')) x(role) WHERE v IS NOT NULL),
      d AS (SELECT off FROM r WHERE role <> 'source_database' GROUP BY off HAVING bool_and(v <> was)),
      h AS (SELECT (SELECT count(*) FROM d) AS n_divergent, (SELECT count(*) FROM f WHERE version) > 0 AND NOT EXISTS (FROM r JOIN f ON r.off = f.off AND f.version WHERE role = 'compacted_database' AND v <> was) AS version_holds,
        (SELECT count(*) FROM f WHERE middle_encryption) > 0 AND NOT EXISTS (FROM r JOIN f ON r.off = f.off AND f.middle_encryption WHERE role = 'compacted_database' AND r.version = 1 AND v <> was) AS encryption_holds)
      SELECT n_divergent, false AS unstable, version_holds, encryption_holds, CASE WHEN n_divergent > 0 THEN 'compact_diverges' WHEN version_holds AND encryption_holds THEN 'compact_matches_created' ELSE 'inconclusive' END AS outcome FROM h""",
    "cohort_lengths": """WITH d AS (SELECT source, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)
      SELECT source, min(n) AS min_length, max(n) AS max_length, min(n // 64) AS min_pages, max(n // 64) AS max_pages, min(n) <> max(n) AS varies FROM d GROUP BY source""",
    "stable_extra_pages": """WITH s AS (SELECT i % 2 AS cohort, CASE WHEN i % 2 = 0 THEN 40 + i % 5 ELSE 50 + i % 7 END AS n FROM range(0, 24) t(i)),
      e AS (SELECT min(n) FILTER (cohort = 0) AS a, max(n) FILTER (cohort = 0) AS b, min(n) FILTER (cohort = 1) AS c, max(n) FILTER (cohort = 1) AS d FROM s)
      SELECT 'left_only' AS side, unnest(range(d, a)) AS page FROM e UNION ALL SELECT 'right_only', unnest(range(b, c)) FROM e""",
    "reference_cardinality_histogram": f"WITH {_EVENTS}, z AS (SELECT condition, off, count(*) AS cardinality FROM k GROUP BY 1, 2) SELECT cardinality, count(*) AS n_sets FROM z GROUP BY 1",
    "novel_values_vs_reference": f"WITH {_EVENTS} SELECT condition, off, count(*) AS n, min(replica) AS first_replica, min((replica, v))[2] AS first_v FROM n GROUP BY 1, 2",
    "membership_outcome": f"WITH {_EVENTS} SELECT count(*) AS n_novel, CASE WHEN count(*) = 0 THEN 'reference_sets_contain_all_compact_observations' ELSE 'compact_observations_extend_reference_sets' END AS outcome FROM n",
    "bounded_intake": "SELECT least(count(*), 73) AS n, CASE WHEN count(*) > 72 THEN 'too_many_rows' END AS error_code FROM orders",
}
