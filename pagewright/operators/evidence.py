"""Relational checks of evidence: inventories, benchmarks, gates, ratios, intervals, logs, closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytes import framed, write_int
from ..sources.scratch import forget, stored

#: Metrics by which way is better.
LOWER_IS_BETTER = ("median_latency_ns", "peak_rss_bytes", "output_size_bytes")
HIGHER_IS_BETTER = ("throughput_per_second",)


def residues(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, side) that only one of two sets has: none on either side is set equality."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only = lambda x, y, side: x.join(y, list(keys), "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left_only").unionByName(only(b, a, "right_only"))


def not_subset(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """Rows of part that whole lacks: none is a subset."""
    return part.join(whole.select(*keys).distinct(), list(keys), "left_anti")


def exact_keys(found: Column, wanted: Sequence[str]) -> dict[str, Column]:
    """Unknown and missing keys of an array of keys."""
    want = F.array(*map(F.lit, wanted))
    return {"unknown": F.sort_array(F.array_except(found, want)), "missing": F.sort_array(F.array_except(want, found))}


def inventory_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, error_code) of a declared inventory (path, size, sha256) against files: absent, undeclared, other size, other digest."""
    a = declared.select("path", F.col("size").alias("ds"), F.col("sha256").alias("dh"), F.lit(True).alias("d"))
    b = actual.select("path", F.col("size").alias("fs"), F.col("sha256").alias("fh"), F.lit(True).alias("f"))
    both = a.join(b, "path", "full")
    code = F.when(F.col("f").isNull(), "missing_file").when(F.col("d").isNull(), "undeclared_file").when(F.col("ds") != F.col("fs"), "size_differs").when(F.col("dh") != F.col("fh"), "digest_differs")
    return both.select("path", code.alias("error_code")).where("error_code is not null")


def matched_cases(cases: DataFrame, metrics: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Benchmark cases with their resource metrics, and the residues of both (which must be empty)."""
    return cases.join(metrics, key), residues(cases, metrics, key)


def regressions(baseline: DataFrame, candidate: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(id, metric, baseline, candidate, degradation, regressed); a change of just the threshold is allowed.

    Both are (id, metric, value).  Measures on one side only are residues().
    """
    both = baseline.select("id", "metric", F.col("value").alias("baseline")).join(candidate.select("id", "metric", F.col("value").alias("candidate")), ["id", "metric"])
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    bound = F.when(lower, F.col("baseline") * (1 + threshold)).otherwise(F.col("baseline") * (1 - threshold))
    close = F.abs(F.col("candidate") - bound) <= F.greatest(F.abs("candidate"), F.abs(bound)) * 1e-12
    worse = F.when(lower, F.col("candidate") > bound).otherwise(F.col("candidate") < bound)
    change = F.when(lower, F.col("candidate") - F.col("baseline")).otherwise(F.col("baseline") - F.col("candidate")) / F.col("baseline")
    known = both.where(F.col("metric").isin(*LOWER_IS_BETTER, *HIGHER_IS_BETTER))
    return known.select("id", "metric", "baseline", "candidate", change.alias("degradation"), (worse & ~close).alias("regressed"))


def status_counts(rows: DataFrame, *keys: str, status: str = "status") -> DataFrame:
    """Counts by status with the overall one: FAIL, then BLOCKED, then PASS."""
    n = {s: F.count_if(F.col(status) == s) for s in ("PASS", "FAIL", "BLOCKED")}
    overall = F.when(n["FAIL"] > 0, "FAIL").when(n["BLOCKED"] > 0, "BLOCKED").otherwise("PASS")
    return rows.groupBy(*keys).agg(*[v.alias(f"n_{k.lower()}") for k, v in n.items()], overall.alias("overall"))


def derived_status(rows: DataFrame, *keys: str, status: str = "status") -> DataFrame:
    """The status of a group: error, then fail, then blocked or skipped as blocked, then pass."""
    has = lambda *s: F.bool_or(F.col(status).isin(*s))
    derived = F.when(has("error"), "error").when(has("fail"), "fail").when(has("blocked", "skipped"), "blocked").otherwise("pass")
    return rows.groupBy(*keys).agg(derived.alias("derived"))


def declared_counts(rows: DataFrame, declared: DataFrame, key: str = "status", total: str | None = None) -> DataFrame:
    """Statuses whose number is not the declared (key, n); total names the declared number of all rows."""
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    if total is not None:
        got = got.unionByName(got.agg(F.lit(total).alias(key), F.coalesce(F.sum("got"), F.lit(0).cast("long")).alias("got")))
    both = got.join(declared.select(key, F.col("n").alias("want")), key, "full")
    return both.where(F.coalesce("got", F.lit(0)) != F.coalesce("want", F.lit(0)))


def meets_ratio(part: Column, whole: Column, percent: int) -> Column:
    """part / whole >= percent / 100, by whole numbers alone; nothing of nothing does not."""
    return (whole > 0) & (part.cast("decimal(38,0)") * 100 >= whole.cast("decimal(38,0)") * percent)


def coverage_totals(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    return sums.withColumn("meets", meets_ratio(F.col("covered"), F.col("total"), percent))


def mutation_score(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    """Killed of killed and surviving mutants; other outcomes do not count."""
    n = rows.groupBy(*keys).agg(F.count_if(F.col("status") == "killed").alias("killed"), F.count_if(F.col("status") == "survived").alias("survived"))
    return n.withColumn("meets", meets_ratio(F.col("killed"), F.col("killed") + F.col("survived"), percent))


def exactly_one(rows: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """(key, n, error_code) of required records that are missing, repeated, or not asked for."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = per.join(required.select(key, F.lit(True).alias("asked")), key, "full")
    code = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), code.alias("error_code")).where("error_code is not null")


def test_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("runtime"), F.count_if("ignored").alias("ignored"), F.count_if(~F.col("ignored")).alias("meaningful"))


def joined_mutants(mutants: DataFrame, producer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mutants with their producer's record, and the identities only one side has."""
    return mutants.join(producer, "id"), residues(mutants, producer, "id")


def citation_gaps(citations: DataFrame, usages: DataFrame) -> DataFrame:
    """(source_id, path, error_code): a citing file that no usage declares, a usage that no file bears out.

    citations (source_id, path); usages (source_id, path), a path that ends in /
    standing for all below it.  Both sides meet on the source id, so the prefix
    test runs within one source's rows.
    """
    covers = (F.col("c.source_id") == F.col("u.source_id")) & ((F.col("c.path") == F.col("u.path")) | (F.col("u.path").endswith("/") & F.startswith(F.col("c.path"), F.col("u.path"))))
    c, u = citations.distinct().alias("c"), usages.distinct().alias("u")
    loose = c.join(u, covers, "left_anti").select("source_id", "path", F.lit("undeclared_citation").alias("error_code"))
    unused = u.join(c, covers, "left_anti").select("source_id", "path", F.lit("unused_declaration").alias("error_code"))
    return loose.unionByName(unused)


def accepted_without_pass(accepted: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """Accepted providers that match no candidate that passed."""
    return accepted.join(candidates.where("status = 'pass'"), list(keys), "left_anti")


def interval_errors(intervals: DataFrame, file_size: Column, *keys: str, most: int = 1 << 20) -> DataFrame:
    """intervals (keys, idx, start, end) with error_code: count, empty, bounds, order, overlap, adjacency."""
    order = Window.partitionBy(*keys).orderBy("idx")
    before_start, before_end = F.lag("start").over(order), F.lag("end").over(order)
    code = (
        F.when(F.col("idx") >= most, "too_many_intervals")
        .when(F.col("start") >= F.col("end"), "empty_interval")
        .when(F.col("end") > file_size, "interval_out_of_bounds")
        .when(F.col("start") < before_start, "interval_order")
        .when(F.col("start") < before_end, "interval_overlap")
        .when(F.col("start") == before_end, "adjacent_intervals")
    )
    return intervals.withColumn("error_code", code)


def changes_outside(changes: DataFrame, intervals: DataFrame, *keys: str) -> DataFrame:
    """Changed bytes (keys, off) that lie in no allowed interval (keys, start, end): sorted, disjoint, half-open.

    Not a range join: both are put in one order by offset, and the last interval
    that starts at or before a byte is carried to it.  A key's rows are one
    file's, in parts of ``PART`` bytes; an interval stands in every part it
    meets, so no part is larger than its bytes.
    """
    part = lambda c: F.floor(c / PART)
    spread = intervals.select(*keys, "start", "end", F.explode(F.sequence(part(F.col("start")), part(F.col("end") - 1))).alias("part"))
    marks = spread.select(*keys, "part", F.greatest("start", F.col("part") * PART).alias("off"), F.lit(0).alias("change"), F.col("end").alias("until"))
    rows = changes.select(*keys, part(F.col("off")).alias("part"), F.col("off").cast("long").alias("off"), F.lit(1).alias("change"), F.lit(None).cast("long").alias("until"))
    order = Window.partitionBy(*keys, "part").orderBy("off", "change").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marks.unionByName(rows).withColumn("until", F.last("until", ignorenulls=True).over(order))
    return carried.where((F.col("change") == 1) & (F.col("until").isNull() | (F.col("off") >= F.col("until")))).select(*keys, "off")


#: Bytes of a file that changes_outside() puts in one order.
PART = 1 << 20


def first_outside(outside: DataFrame, *keys: str) -> DataFrame:
    return outside.groupBy(*keys).agg(F.min("off").alias("first_off"), F.count(F.lit(1)).alias("n_outside"))


def operation_log_errors(entries: DataFrame, final: DataFrame, *keys: str) -> DataFrame:
    """(keys, error_code) of logs (keys, sequence, status) against (keys, final_status).

    Sequences run from 1 without gaps; the last status is the final one; a
    passing log has no other status.
    """
    per = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_distinct("sequence").alias("kinds"), F.max_by("status", "sequence").alias("last"), F.bool_and(F.col("status") == "pass").alias("passed"))
    joined = per.join(final, list(keys))
    code = (
        F.when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("kinds") != F.col("n")), "sequence_not_contiguous")
        .when(F.col("last") != F.col("final_status"), "final_status_differs")
        .when((F.col("final_status") == "pass") & ~F.col("passed"), "earlier_failure")
    )
    return joined.select(*keys, code.alias("error_code"))


def incomplete(rows: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of two small dimensions that rows lack, and rows outside them.

    The dimensions are lists of names (replicas, checkpoints), so their product is bounded by the caller.
    """
    return residues(left.select(a).distinct().crossJoin(right.select(b).distinct()), rows, a, b)


def varying_attributes(rows: DataFrame, attributes: Sequence[str], *keys: str) -> DataFrame:
    """(keys, attribute, n_values) of attributes that replicas should share and do not."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in attributes])).alias("p")
    per = rows.select(*keys, pairs).groupBy(*keys, F.col("p.attribute").alias("attribute")).agg((F.count_distinct("p.value") + F.max(F.col("p.value").isNull().cast("int"))).alias("n_values"))
    return per.where("n_values > 1")


def chain_errors(rows: DataFrame) -> DataFrame:
    """(replica, ordinal, error_code): a gap in the ordinals, or a named predecessor that is not the one before."""
    order = Window.partitionBy("replica").orderBy("ordinal")
    before, at = F.lag("checkpoint").over(order), F.row_number().over(order) - 1
    code = F.when(F.col("ordinal") != at, "ordinal_gap").when(~F.col("predecessor").eqNullSafe(before), "predecessor_differs")
    return rows.select("replica", "ordinal", code.alias("error_code"))


def declared_totals(rows: DataFrame, declared: DataFrame, value: str, *keys: str) -> DataFrame:
    """Keys whose sum of a value is not the declared total."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("got"))
    return sums.join(declared.select(*keys, F.col("total").alias("want")), list(keys), "full").where(~F.col("got").eqNullSafe(F.col("want")))


def prefix_agreement(databases: DataFrame, records: DataFrame, manifest: DataFrame, prefixes: DataFrame, n: int = 2048) -> DataFrame:
    """(id, error_code) of four accounts of one sample: content, recorded digest, manifest digest, retained prefix."""
    joined = databases.select("id", "content").join(records.select("id", F.col("sha256").alias("recorded")), "id", "full").join(manifest.select("id", F.col("sha256").alias("listed")), "id", "full").join(prefixes.select("id", "prefix"), "id", "full")
    real = F.sha2("content", 256)
    code = (
        F.when(F.col("content").isNull() | F.col("recorded").isNull() | F.col("listed").isNull() | F.col("prefix").isNull(), "missing_part")
        .when(F.col("recorded") != real, "record_differs")
        .when(F.col("listed") != real, "manifest_differs")
        .when(F.col("prefix") != F.substring("content", 1, n), "prefix_differs")
    )
    return joined.select("id", code.alias("error_code")).where("error_code is not null")


def framed_digest(blobs: DataFrame, *keys: str, domain: bytes = b"") -> DataFrame:
    """SHA-256 over (path, blob) in path order, each after its length: paths in 4 bytes, blobs in 8, big-endian.

    A suite is a bounded list of source files, whose bytes have to meet in order.
    """
    one = F.hex(framed((F.col("path").cast("binary"), 4), (F.col("blob"), 8)))
    parts = F.sort_array(F.collect_list(F.struct(F.col("path").cast("binary").alias("path"), one.alias("x"))))
    whole = F.concat(F.lit(domain), F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")))
    return blobs.groupBy(*keys).agg(F.sha2(whole, 256).alias("digest"))


def rows_digest(rows: DataFrame, *keys: str) -> DataFrame:
    """SHA-256 over (id, payload) in id order: id in 4 bytes and payload length in 2, little-endian, then the payload.

    A table of one checkpoint is bounded by the experiment, and its digest needs the order.
    """
    raw = F.col("payload").cast("binary")
    one = F.hex(F.concat(write_int(F.col("id"), 4), write_int(F.octet_length(raw), 2), raw))
    parts = F.sort_array(F.collect_list(F.struct("id", one.alias("x"))))
    return rows.groupBy(*keys).agg(F.sha2(F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")), 256).alias("digest"), F.count(F.lit(1)).alias("n_rows"))


def forward_filled(lines: DataFrame, header: Column, *keys: str, order: str = "line_no") -> DataFrame:
    """lines with the last header at or before each; null before the first."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("header", F.last(header, ignorenulls=True).over(upto))


def sections(lines: DataFrame, is_heading: Column, *keys: str, order: str = "line_no") -> DataFrame:
    """lines with section: how many headings stand at or before each."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.sum(is_heading.cast("int")).over(upto))


def zipped_blocks(targets: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """The n-th target beside the n-th block (both keys, line_no, ...); a side without partner is block_count_differs."""
    nth = lambda df, name: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))).withColumnRenamed("line_no", name)
    both = nth(targets, "target_line").join(nth(blocks, "block_line"), [*keys, "nth"], "full")
    return both.withColumn("error_code", F.when(F.col("target_line").isNull() | F.col("block_line").isNull(), "block_count_differs"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of everything below a root in (node, parent), roots with it.

    Steps double: round k joins what is less than 2**k steps below a root with
    the steps of just 2**k, then doubles those by a join with themselves, so a
    tree of depth d takes log2(d) rounds.  It ends when no step is left, or, as
    in cycles, when a round finds nothing new.  Tables are written to the shared
    folder, and those that nothing reads any more are deleted.
    """
    seen = stored(roots.select("root", F.col("root").alias("node")).distinct(), "closure")
    steps = stored(edges.select("parent", "node").distinct(), "closure-steps")
    n_seen = seen.count()
    while not steps.isEmpty():
        below = seen.withColumnRenamed("node", "parent").join(steps, "parent").select("root", "node")
        more = stored(seen.unionByName(below).distinct(), "closure")
        n_more = more.count()
        forget(seen)
        seen = more
        if n_more == n_seen:
            break
        n_seen = n_more
        twice = steps.select("parent", F.col("node").alias("middle")).join(steps.select(F.col("parent").alias("middle"), "node"), "middle").select("parent", "node").distinct()
        doubled = stored(twice, "closure-steps")
        forget(steps)
        steps = doubled
    forget(steps)
    return seen


def closure_sum(nodes: DataFrame, roots: DataFrame, value: str) -> DataFrame:
    """(root, total) of a value over all nodes below each root that have a row."""
    below = closure(nodes, roots)
    return below.join(nodes.select("node", value), "node").groupBy("root").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_nodes"))


def growth_schedule(spark: SparkSession, thresholds: Sequence[int], start_pages: int, pages_per_batch: int) -> DataFrame:
    """(step, threshold, batches, page_count): whole batches until each threshold in turn is reached."""
    values = ", ".join(f"({i}, {t}L)" for i, t in enumerate(thresholds, 1))
    return spark.sql(
        f"""
        WITH RECURSIVE t(step, threshold) AS (VALUES {values}),
        s(step, threshold, batches, page_count) AS (
          SELECT 0, 0L, 0L, CAST({start_pages} AS BIGINT)
          UNION ALL
          SELECT t.step, t.threshold, greatest(0L, (t.threshold - s.page_count + {pages_per_batch} - 1) div {pages_per_batch}),
                 s.page_count + greatest(0L, (t.threshold - s.page_count + {pages_per_batch} - 1) div {pages_per_batch}) * {pages_per_batch}
          FROM s JOIN t ON t.step = s.step + 1
        ) SELECT step, threshold, batches, page_count FROM s WHERE step > 0
        """
    )


def growth_targets(states: DataFrame, thresholds: Sequence[int], *keys: str) -> DataFrame:
    """(keys, threshold, ordinal, page_count, overshoot): the first state with as many pages as a threshold.

    A state is the first with just the thresholds above all earlier states and not
    above it, so one window by key does it and no state meets a threshold twice.
    """
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    marked = states.withColumn("most", F.max("page_count").over(before))
    every = F.array(*[F.lit(t).cast("long") for t in sorted(set(thresholds))])
    own = F.filter(every, lambda t: (t <= F.col("page_count")) & (F.col("most").isNull() | (t > F.col("most"))))
    first = marked.select(*keys, "ordinal", "page_count", F.explode(own).alias("threshold"))
    return first.select(*keys, "threshold", "ordinal", "page_count", (F.col("page_count") - F.col("threshold")).alias("overshoot"))
