"""Replicated-delta analysis of observed prefixes.

An observation is (condition, replica, phase, prefix); conditions are a table
(condition, version, encryption).  Pairs come from equi-joins on what they share
and a comparison of what they don't; bytes are compared within the pair's row,
so a pair is one row however long its prefix.  Per-offset results start from
``cells``: the only step that makes a row a byte, over a bounded range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import differing
from ..sources.images import byte


def cells(obs: DataFrame, start: int, end: int) -> DataFrame:
    """(condition, replica, phase, off, v) of the bytes of a range."""
    keys = [c for c in obs.columns if c != "prefix"]
    return obs.select(*keys, "prefix", F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("off")).select(*keys, "off", byte(F.col("prefix"), F.col("off")).alias("v"))


def _side(obs: DataFrame, side: str) -> DataFrame:
    return obs.select(*[F.col(c).alias(f"{side}_{c}") for c in obs.columns])


def _compared(pairs: DataFrame, kind: str) -> DataFrame:
    at = differing(F.col("left_prefix"), F.col("right_prefix"))
    return pairs.withColumns({"kind": F.lit(kind), "offs": at}).drop("left_prefix", "right_prefix")


def paired_phase(obs: DataFrame, first: str = "creator", second: str = "reopen") -> DataFrame:
    """Each sample's two phases."""
    a, b = _side(obs.where(F.col("phase") == first), "left"), _side(obs.where(F.col("phase") == second), "right")
    return _compared(a.join(b, (F.col("left_condition") == F.col("right_condition")) & (F.col("left_replica") == F.col("right_replica"))), "paired_phase")


def within_condition(obs: DataFrame) -> DataFrame:
    """Pairs of replicas of one condition and phase."""
    same = (F.col("left_condition") == F.col("right_condition")) & (F.col("left_phase") == F.col("right_phase"))
    return _compared(_side(obs, "left").join(_side(obs, "right"), same & (F.col("left_replica") < F.col("right_replica"))), "within_condition")


def matched_factor(obs: DataFrame, conditions: DataFrame, factor: str, order: list) -> DataFrame:
    """Pairs that differ in one factor only, the earlier of ``order`` on the left."""
    other = "encryption" if factor == "version" else "version"
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(factor))
    known = obs.join(F.broadcast(conditions), "condition").withColumn("rank", rank)
    a, b = _side(known, "left"), _side(known, "right")
    same = [F.col(f"left_{c}") == F.col(f"right_{c}") for c in (other, "replica", "phase")]
    pairs = a.join(b, same[0] & same[1] & same[2] & (F.col("left_rank") < F.col("right_rank"))).drop("left_rank", "right_rank")
    return _compared(pairs, f"matched_{factor}")


def pair_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    """A pair's number of differences, first and last."""
    return pairs.select(*keys, F.size("offs").alias("n_diff"), F.array_min("offs").alias("first_diff"), F.array_max("offs").alias("last_diff"))


def occurrences(pairs: DataFrame) -> DataFrame:
    """How many pairs of a kind differ at each offset."""
    return pairs.select("kind", F.explode("offs").alias("off")).groupBy("kind", "off").agg(F.count(F.lit(1)).alias("n"))


def mask_histogram(pairs: DataFrame, length: int, *keys: str) -> DataFrame:
    """Offsets by the number of pairs that differ there, with their share: union is 1 or more, intersection all."""
    within = pairs.select(*keys, F.explode(F.filter("offs", lambda o: o < length)).alias("off"))
    per = within.groupBy(*keys, "off").agg(F.count(F.lit(1)).alias("occurrences"))
    total = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    counted = per.groupBy(*keys, "occurrences").agg(F.count(F.lit(1)).alias("n_offsets"))
    joined = counted.join(F.broadcast(total), list(keys)) if keys else counted.join(F.broadcast(total))
    return joined.select(*keys, "occurrences", "n_offsets", (F.col("occurrences") == F.col("n_pairs")).alias("in_all"))


def union_mask(pairs: DataFrame, length: int) -> DataFrame:
    return pairs.select(F.explode(F.filter("offs", lambda o: o < length)).alias("off")).distinct()


def intersection_mask(pairs: DataFrame, length: int) -> DataFrame:
    per = pairs.select(F.explode(F.filter("offs", lambda o: o < length)).alias("off")).groupBy("off").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("all"))), F.col("n") == F.col("all")).select("off")


def cohort_variable(table: DataFrame, cohort: str = "condition") -> DataFrame:
    """(cohort, off): offsets where replicas of a cohort differ."""
    return table.groupBy(cohort, "off").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select(cohort, "off")


def stable_deltas(table: DataFrame, left: Column, right: Column) -> DataFrame:
    """(off, left_v, right_v): constant in either cohort and different between them."""
    agg = lambda t, side: t.groupBy("off").agg(F.min("v").alias(f"{side}_v"), F.max("v").alias("top")).where(F.col("top") == F.col(f"{side}_v")).drop("top")
    return agg(table.where(left), "left").join(agg(table.where(right), "right"), "off").where("left_v <> right_v")


def extra_pages(sizes: DataFrame, left: Column, right: Column, page_size: int) -> DataFrame:
    """(side, page): pages that every image of one cohort has and no image of the other."""
    pages = sizes.withColumn("n", F.floor(F.col("length") / page_size))
    a = pages.where(left).agg(F.min("n").alias("left_min"), F.max("n").alias("left_max"))
    b = pages.where(right).agg(F.min("n").alias("right_min"), F.max("n").alias("right_max"))
    ends = a.join(b)
    span = lambda side, low, high: ends.where(F.col(high) > F.col(low)).select(F.lit(side).alias("side"), F.explode(F.sequence(F.col(low), F.col(high) - 1)).alias("page"))
    return span("left_only", "right_max", "left_min").unionByName(span("right_only", "left_max", "right_min"))


def length_variance(sizes: DataFrame, cohort: str, page_size: int) -> DataFrame:
    return sizes.groupBy(cohort).agg(
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.min(F.floor(F.col("length") / page_size)).alias("min_pages"),
        F.max(F.floor(F.col("length") / page_size)).alias("max_pages"),
        (F.min("length") != F.max("length")).alias("varies"),
    )


def stable_values(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, off, v): the one value that all replicas and phases have, or null."""
    return table.groupBy(*keys, "off").agg(F.when(F.min("v") == F.max("v"), F.min("v")).alias("v"))


def factor_offsets(table: DataFrame, conditions: DataFrame, versions: tuple[str, str, str], plain: str, encrypted: str) -> DataFrame:
    """(off, version, middle_encryption, all_encryption) for offsets where one of the three predicates holds.

    version: stable everywhere, encryption changes nothing, the middle version
    differs from both others.  middle_encryption: the middle version is stable
    with and without and differs.  all_encryption: stable everywhere, and the
    same exclusive-or that is not zero in every version.
    """
    stable = stable_values(table.join(F.broadcast(conditions), "condition"), "version", "encryption")
    names = {(v, e): f"v{i}{j}" for i, v in enumerate(versions) for j, e in enumerate((plain, encrypted))}
    pick = [F.max(F.when((F.col("version") == v) & (F.col("encryption") == e), F.col("v"))).alias(n) for (v, e), n in names.items()]
    wide = stable.groupBy("off").agg(*pick)
    c = {k: F.col(n) for k, n in names.items()}
    one, two, three = versions
    known = F.lit(True)
    for value in c.values():
        known = known & value.isNotNull()
    unmoved = F.lit(True)
    for v in versions:
        unmoved = unmoved & (c[v, plain] == c[v, encrypted])
    effect = {v: c[v, plain].bitwiseXOR(c[v, encrypted]) for v in versions}
    holds = {
        "version": known & unmoved & (c[two, plain] != c[one, plain]) & (c[two, plain] != c[three, plain]),
        "middle_encryption": c[two, plain].isNotNull() & c[two, encrypted].isNotNull() & (c[two, plain] != c[two, encrypted]),
        "all_encryption": known & (effect[one] != 0) & (effect[one] == effect[two]) & (effect[two] == effect[three]),
    }
    found = wide.select("off", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in holds.items()])
    return found.where("version or middle_encryption or all_encryption")


def candidate_outcome(offsets: DataFrame, required: tuple[str, ...] = ("version", "middle_encryption")) -> DataFrame:
    """candidate_offsets_observed if every required predicate has an offset, inconclusive if any has, else none."""
    sets = ("version", "middle_encryption", "all_encryption")
    counts = offsets.agg(*[F.count_if(F.col(s)).alias(f"n_{s}") for s in sets])
    need, some = F.lit(True), F.lit(False)
    for s in required:
        need = need & (F.col(f"n_{s}") > 0)
    for s in sets:
        some = some | (F.col(f"n_{s}") > 0)
    return counts.withColumn("outcome", F.when(need, "candidate_offsets_observed").when(some, "inconclusive").otherwise("no_candidates_observed"))


def compact_outcome(compact: DataFrame, created: DataFrame, version_offsets: DataFrame, encryption_offsets: DataFrame, middle: str) -> DataFrame:
    """Whether compacted databases agree with the created ones they match.

    compact: (condition, version, replica, role, off, v); created: the stable
    (condition, off, v).  One row: n_divergent offsets where every condition's
    one value differs from the created, unstable if replicas or the two later
    roles of a condition differ, whether the bound offsets hold, outcome.
    """
    later = compact.where(F.col("role").isin("compacted_database", "verify_database"))
    per = later.groupBy("condition", "off").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    # an offset without one created value agrees with nothing
    created = created.withColumnRenamed("v", "was")
    against = per.join(created, ["condition", "off"], "left")
    per_offset = against.groupBy("off").agg(F.bool_and((F.col("a") == F.col("b")) & ~F.col("a").eqNullSafe(F.col("was"))).alias("diverges"), F.bool_or(F.col("a") != F.col("b")).alias("unstable"))
    shape = per_offset.agg(F.count_if("diverges").alias("n_divergent"), F.coalesce(F.bool_or("unstable"), F.lit(False)).alias("mixed"))
    replicas = compact.groupBy("condition", "role", "off").agg((F.min("v") != F.max("v")).alias("d")).agg(F.coalesce(F.bool_or("d"), F.lit(False)).alias("varied"))
    compacted = compact.where("role = 'compacted_database'").join(created, ["condition", "off"], "left")

    def holds(rows: DataFrame, offsets: DataFrame, name: str) -> DataFrame:
        bound = offsets.agg(F.count(F.lit(1)).alias(f"n_{name}"))
        wrong = rows.join(F.broadcast(offsets), "off").agg(F.count_if(~F.col("v").eqNullSafe(F.col("was"))).alias("w"))
        return bound.join(wrong).select(f"n_{name}", ((F.col(f"n_{name}") > 0) & (F.col("w") == 0)).alias(f"{name}_holds"))

    row = shape.join(replicas).join(holds(compacted, version_offsets, "version")).join(holds(compacted.where(F.col("version") == middle), encryption_offsets, "encryption"))
    unstable = F.col("mixed") | F.col("varied")
    outcome = (
        F.when(unstable | (F.col("n_version") == 0) | (F.col("n_encryption") == 0), "inconclusive")
        .when(F.col("n_divergent") > 0, "compact_diverges")
        .when(F.col("version_holds") & F.col("encryption_holds"), "compact_matches_created")
        .otherwise("inconclusive")
    )
    return row.select("n_divergent", unstable.alias("unstable"), "version_holds", "encryption_holds", outcome.alias("outcome"))


def reference_sets(table: DataFrame) -> DataFrame:
    """(condition, off, v): the values seen, each once."""
    return table.select("condition", "off", "v").distinct()


def cardinalities(references: DataFrame) -> DataFrame:
    """Offsets by how many values their reference set has."""
    return references.groupBy("condition", "off").agg(F.count(F.lit(1)).alias("cardinality")).groupBy("cardinality").agg(F.count(F.lit(1)).alias("n_sets"))


def novel_values(table: DataFrame, references: DataFrame) -> DataFrame:
    """Observations whose value their reference set lacks: an anti-join, so a set is never gathered."""
    return table.join(references, ["condition", "off", "v"], "left_anti")


def novel_occurrences(novel: DataFrame) -> DataFrame:
    """(condition, off, n, occurrences in replica order); an offset has one entry a replica."""
    return novel.groupBy("condition", "off").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("replica", "v"))).alias("occurrences"))


def membership_outcome(novel: DataFrame) -> DataFrame:
    n = novel.agg(F.count(F.lit(1)).alias("n_novel"))
    return n.withColumn("outcome", F.when(F.col("n_novel") == 0, "reference_sets_contain_all_compact_observations").otherwise("compact_observations_extend_reference_sets"))


def bounded_intake(rows: DataFrame, most: int) -> DataFrame:
    """One row: how many came, up to one more than allowed, and whether that is refused."""
    return rows.limit(most + 1).agg(F.count(F.lit(1)).alias("n")).withColumn("error_code", F.when(F.col("n") > most, "too_many_rows"))
