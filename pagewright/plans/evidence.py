"""Queries of evidence checks, on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import budget
from ..operators import evidence as ops


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the manifest, labels as what ran: what only one of them has."""
    return ops.residues(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "doc_id")


def inventory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared inventory of pages against the pages: absent, undeclared, size, digest."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.octet_length("html").cast("long").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), "page_id")
    declared = pages.where("page_id % 13 <> 1").select("path", F.when(F.col("page_id") % 17 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("page_id") % 19 == 3, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return ops.inventory_diff(declared, pages.where("page_id % 11 <> 5"))


def benchmark_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of order prices by priority, one year against the next, as latencies and as throughputs."""
    orders = _read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("id"), F.floor("o_totalprice").alias("v"))
    per = orders.groupBy("y", "id").agg(F.sum("v").cast("double").alias("value"))
    metrics = F.explode(F.array(F.lit("median_latency_ns"), F.lit("throughput_per_second"))).alias("metric")
    years = orders.agg(F.min("y").alias("first"))
    known = per.join(F.broadcast(years)).select("*", metrics)
    side = lambda n: known.where(F.col("y") == F.col("first") + n).select("id", "metric", "value")
    found = ops.regressions(side(0), side(1))
    return found.select("id", "metric", "baseline", "candidate", F.round("degradation", 9).alias("degradation"), "regressed")


def gate_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line states as gate results by order: FAIL before BLOCKED before PASS."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_linestatus") == "O", "BLOCKED").otherwise("PASS").alias("status"))
    return ops.status_counts(items, "l_orderkey")


def derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states by customer: error, fail, blocked, pass."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, "error").when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "skipped").otherwise("pass").alias("status"))
    return ops.derived_status(orders, "o_custkey")


def declared_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses whose number is not the declared, and the number of all."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    declared = spark.createDataFrame([("F", 1), ("X", 0), ("Y", 2), ("selected", 3)], "status string, n long")
    return ops.declared_counts(orders, declared, total="selected").select("status", F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("want", F.lit(0)).alias("want"))


def ratio_threshold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by quality: toxic ones of all, against a share, in whole numbers."""
    rows = _read(spark, sf_dir, "labels").select("quality", F.col("toxic").cast("long").alias("covered"), F.lit(1).cast("long").alias("total"))
    return ops.coverage_totals(rows, 13, "quality")


def mutation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as mutants: killed of killed and surviving."""
    rows = _read(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 9 < 7, "killed").when(F.col("o_orderkey") % 9 == 7, "survived").otherwise("timeout").alias("status"))
    return ops.mutation_score(rows, 88, "o_orderpriority")


def platform_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers as platform records: missing, repeated, not asked for."""
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("platform"))
    return ops.exactly_one(rows, _read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("platform")), "platform")


def runtime_test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that run, are ignored, and mean something."""
    return ops.test_counts(_read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6 == 0).alias("ignored")))


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer segments cited in files by nation, against declared files and folders."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), F.concat(F.lower("c_mktsegment"), F.lit("/"), (F.col("c_custkey") % 7).cast("string")).alias("path"))
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"))
    usages = n.select("source_id", F.lit("building/").alias("path")).unionByName(n.select("source_id", F.lit("machinery/3").alias("path"))).unionByName(n.where("source_id % 5 = 0").select("source_id", F.lit("absent/").alias("path")))
    return ops.citation_gaps(c, usages)


def accepted_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that no part has passed with."""
    accepted = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"))
    candidates = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("provider"), F.when((F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 10 == 0), "pass").otherwise("fail").alias("status"))
    return ops.accepted_without_pass(accepted, candidates, "provider")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 50).alias("file"), (F.col("o_orderkey") % 50).cast("int").alias("idx"), ((F.col("o_orderkey") % 50) * 20 + F.col("o_orderkey") % 7).alias("start")
    ).withColumn("end", F.col("start") + (F.col("idx") * 37) % 23)


_INTERVALS = "i AS (SELECT o_orderkey // 50 AS file, (o_orderkey % 50)::INT AS idx, (o_orderkey % 50) * 20 + o_orderkey % 7 AS s, (o_orderkey % 50) * 20 + o_orderkey % 7 + ((o_orderkey % 50) * 37) % 23 AS e FROM orders)"


def interval_list_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval lists of files: empty, bounds, order, overlap, adjacency."""
    return ops.interval_errors(_intervals(spark, sf_dir), F.lit(900), "file")


def changes_outside_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed bytes of a document and the next within no allowed interval: first and number."""
    from ..functions.bytes import differing

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("l"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("l").alias("r")), "doc_id")
    changes = pairs.select("doc_id", F.explode(differing(F.col("l"), F.col("r"))).alias("off"))
    allowed = pairs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))).alias("k")).select("doc_id", (F.col("k") * 50).alias("start"), (F.col("k") * 50 + 30).alias("end"))
    return ops.first_outside(ops.changes_outside(changes, allowed, "doc_id"), "doc_id")


def budget_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order's lines as charges against a limit."""
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("amount"))
    return budget.running_totals(items, "l_orderkey", order="l_linenumber", limit=100)


def operation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of an order as a log's sequence: gaps, final status, earlier failures."""
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.when(F.col("l_quantity") > 48, 1).otherwise(0)).alias("bad"))
    entries = items.select("l_orderkey", F.col("l_linenumber").alias("sequence"), F.when(F.col("bad") == 1, "fail").otherwise("pass").alias("status"))
    final = items.select("l_orderkey").distinct().withColumn("final_status", F.lit("pass"))
    return ops.operation_log_errors(entries, final, "l_orderkey")


def store_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that documents name against digests of a store made of those with ids below 900."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return ops.residues(docs.where("doc_id >= 50"), docs.where("doc_id < 900"), "sha256")


def varying_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a brand's parts that should be one and are not."""
    return ops.varying_attributes(_read(spark, sf_dir, "part"), ["p_type", "p_size"], "p_brand")


def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose quantities do not add up to a declaration that is off by one for some."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    declared = items.groupBy("l_orderkey").agg(F.sum("q").alias("t")).select("l_orderkey", (F.col("t") + F.when(F.col("l_orderkey") % 100 == 1, 1).otherwise(0)).alias("total"))
    return ops.declared_totals(items, declared, "q", "l_orderkey")


def four_way_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page contents, two lists of their digests and retained prefixes, some of them wrong."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    digest = F.sha2("content", 256)
    records = p.where("id % 10 <> 1").select("id", F.when(F.col("id") % 10 == 2, F.lit("x")).otherwise(digest).alias("sha256"))
    listed = p.select("id", F.when(F.col("id") % 10 == 3, F.lit("x")).otherwise(digest).alias("sha256"))
    prefixes = p.select("id", F.when(F.col("id") % 10 == 4, F.lit(b"x")).otherwise(F.substring("content", 1, 2048)).alias("prefix"))
    return ops.prefix_agreement(p, records, listed, prefixes)


def suite_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as files: names and keys, framed by their lengths, in one digest."""
    n = _read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("path"), F.col("n_nationkey").cast("string").cast("binary").alias("blob"))
    return ops.framed_digest(n, "n_regionkey", domain=b"suite")


def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and payloads of suppliers by nation, framed little-endian, in one digest."""
    rows = _read(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("payload"))
    return ops.rows_digest(rows, "s_nationkey")


def header_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn above each turn of a conversation."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    header = F.when(F.col("role") == "user", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return ops.forward_filled(turns, header, "conv_id", order="turn")


def ledger_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in sections that a user turn begins."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return ops.sections(turns, F.col("role") == "user", "conv_id", order="turn").select("conv_id", "turn", "section")


def zipped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th user turn beside the n-th answer."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).withColumnRenamed("turn", "line_no")
    users, answers = turns.where("role = 'user'").drop("role"), turns.where("role = 'assistant'").drop("role")
    return ops.zipped_blocks(users, answers, "conv_id").select("conv_id", F.col("nth").cast("long").alias("nth"), "target_line", "block_line", "error_code")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    line = lambda n: F.concat(F.lit("#"), (F.col("id") * n % 5000).cast("string"), F.lit("\tINITED rss: "), (F.col("id") * n % 700).cast("string"), F.lit("Mb\n"))
    marker = F.element_at(F.array(*map(F.lit, ("done", "ERROR: AddressSanitizer: heap", "rss limit exceeded", "thread 'main' panicked at x", "thread 'main'"))), (F.col("id") % 5 + 1).cast("int"))
    return o.select("id", F.concat(F.lit("\x1b[32mrun\x1b[0m\n"), line(1), line(3), marker).alias("log"), (F.col("id") % 3).cast("int").alias("exit_code"), (F.col("id") % 14 == 0).alias("timed_out"))


def log_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress, memory and result of runs from their logs."""
    logs = _logs(spark, sf_dir)
    return logs.select("id", text.largest_number(F.col("log"), text.PROGRESS).alias("runs"), text.largest_number(F.col("log"), text.RSS).alias("rss_mb"), text.log_result(F.col("log"), F.col("exit_code"), F.col("timed_out")).alias("result"))


def closure_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of process trees: nodes from arithmetic, each below the node of half its number."""
    nodes = spark.range(1, 400).select(F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("parent"), (F.col("id") * 17 % 101).alias("rss"))
    roots = spark.range(1, 9).select(F.col("id").alias("root"))
    return ops.closure_sum(nodes, roots, "rss")


def changed_indices_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages by day against a declaration that lacks some: what only one has."""
    from .checkpoints import _events_index
    from ..operators.checkpoints import changed_pages

    changed = changed_pages(_events_index(spark, sf_dir)).select("ordinal", "page")
    return ops.residues(changed, changed.where("page % 50 <> 7"), "ordinal", "page")


def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that the documents of one language do not contain."""
    docs = _read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return ops.not_subset(_read(spark, sf_dir, "labels").select("doc_id"), docs, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        manifest_reconcile, inventory_check, benchmark_regressions, gate_status_summary, derived_status, declared_status_counts, ratio_threshold_exact, mutation_score, platform_records,
        runtime_test_counts, citation_check, accepted_providers, interval_list_validation, changes_outside_intervals, budget_running_totals, operation_logs, store_closure, varying_attributes,
        declared_totals, four_way_agreement, suite_digest, table_digest, header_forward_fill, ledger_sections, zipped_blocks, log_results, closure_sum, changed_indices_recomputed, subset_check,
    )
}

_TURNS = "t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2)"

SQL = {
    "manifest_reconcile": "SELECT doc_id, 'left_only' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
    "inventory_check": """WITH c AS (SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 11 = 5 AND page_id % 13 = 1 THEN NULL WHEN page_id % 11 = 5 THEN 'missing_file' WHEN page_id % 13 = 1 THEN 'undeclared_file'
      WHEN page_id % 17 = 2 THEN 'size_differs' WHEN page_id % 19 = 3 THEN 'digest_differs' END AS error_code FROM pages) SELECT * FROM c WHERE error_code IS NOT NULL""",
    "benchmark_regressions": """WITH o AS (SELECT year(o_orderdate) AS y, o_orderpriority AS id, sum(floor(o_totalprice))::DOUBLE AS v FROM orders GROUP BY 1, 2), f AS (SELECT min(y) AS y FROM o),
      b AS (SELECT a.id, a.v AS baseline, c.v AS candidate FROM o a JOIN f ON a.y = f.y JOIN o c ON c.id = a.id AND c.y = f.y + 1), m AS (SELECT *, unnest(['median_latency_ns', 'throughput_per_second']) AS metric FROM b),
      d AS (SELECT *, CASE metric WHEN 'median_latency_ns' THEN candidate - baseline ELSE baseline - candidate END / baseline AS x FROM m)
      SELECT id, metric, baseline, candidate, round(x, 9) AS degradation, x > 0.15 AND abs(x - 0.15) > 1e-11 AS regressed FROM d""",
    "gate_status_summary": """WITH s AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_linestatus = 'O' THEN 'BLOCKED' ELSE 'PASS' END AS s FROM lineitem)
      SELECT l_orderkey, count(*) FILTER (s = 'PASS') AS n_pass, count(*) FILTER (s = 'FAIL') AS n_fail, count(*) FILTER (s = 'BLOCKED') AS n_blocked, CASE max(CASE s WHEN 'FAIL' THEN 2 WHEN 'BLOCKED' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'BLOCKED' ELSE 'PASS' END AS overall FROM s GROUP BY 1""",
    "derived_status": """WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 3 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS s FROM orders)
      SELECT o_custkey, CASE max(s) WHEN 3 THEN 'error' WHEN 2 THEN 'fail' WHEN 1 THEN 'blocked' ELSE 'pass' END AS derived FROM s GROUP BY 1""",
    "declared_status_counts": """WITH g AS (SELECT o_orderstatus AS status, count(*) AS got FROM orders GROUP BY 1 UNION ALL SELECT 'selected', count(*) FROM orders), d AS (SELECT * FROM (VALUES ('F', 1), ('X', 0), ('Y', 2), ('selected', 3)) v(status, want))
      SELECT coalesce(g.status, d.status) AS status, coalesce(got, 0) AS got, coalesce(want, 0)::BIGINT AS want FROM g FULL JOIN d ON g.status = d.status WHERE coalesce(got, 0) <> coalesce(want, 0)""",
    "ratio_threshold_exact": "SELECT quality, sum(toxic)::BIGINT AS covered, count(*) AS total, sum(toxic) * 100 >= count(*) * 13 AS meets FROM labels GROUP BY quality",
    "mutation_score": "WITH s AS (SELECT o_orderpriority, count(*) FILTER (o_orderkey % 9 < 7) AS killed, count(*) FILTER (o_orderkey % 9 = 7) AS survived FROM orders GROUP BY 1) SELECT *, killed + survived > 0 AND killed * 100 >= (killed + survived) * 88 AS meets FROM s",
    "platform_records": """WITH r AS (SELECT s_nationkey AS platform, count(*) AS n FROM supplier GROUP BY 1), q AS (SELECT n_nationkey AS platform FROM nation WHERE n_nationkey < 20),
      b AS (SELECT coalesce(r.platform, q.platform) AS platform, coalesce(n, 0) AS n, CASE WHEN q.platform IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS error_code FROM r FULL JOIN q ON r.platform = q.platform) SELECT * FROM b WHERE error_code IS NOT NULL""",
    "runtime_test_counts": "SELECT count(*) AS runtime, count(*) FILTER (o_orderkey % 6 = 0) AS ignored, count(*) FILTER (o_orderkey % 6 <> 0) AS meaningful FROM orders",
    "citation_check": """WITH c AS (SELECT DISTINCT c_nationkey AS source_id, lower(c_mktsegment) || '/' || (c_custkey % 7) AS path FROM customer),
      u AS (SELECT n_nationkey AS source_id, 'building/' AS path FROM nation UNION SELECT n_nationkey, 'machinery/3' FROM nation UNION SELECT n_nationkey, 'absent/' FROM nation WHERE n_nationkey % 5 = 0)
      SELECT source_id, path, 'undeclared_citation' AS error_code FROM c WHERE NOT EXISTS (FROM u WHERE u.source_id = c.source_id AND (u.path = c.path OR (suffix(u.path, '/') AND starts_with(c.path, u.path))))
      UNION ALL SELECT source_id, path, 'unused_declaration' FROM u WHERE NOT EXISTS (FROM c WHERE u.source_id = c.source_id AND (u.path = c.path OR (suffix(u.path, '/') AND starts_with(c.path, u.path))))""",
    "accepted_providers": "SELECT s_suppkey AS provider FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' AND l_orderkey % 10 = 0)",
    "interval_list_validation": f"""WITH {_INTERVALS}, l AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM i WINDOW w AS (PARTITION BY file ORDER BY idx))
      SELECT file, idx, s AS start, e AS "end", CASE WHEN s >= e THEN 'empty_interval' WHEN e > 900 THEN 'interval_out_of_bounds' WHEN s < ps THEN 'interval_order' WHEN s < pe THEN 'interval_overlap' WHEN s = pe THEN 'adjacent_intervals' END AS error_code FROM l""",
    "changes_outside_intervals": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), q AS (SELECT a.doc_id, a.h AS l, b.h AS r, unnest(range(0, least(length(a.h), length(b.h)) // 2)) AS off FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
      c AS (SELECT doc_id, off FROM q WHERE substr(l, 2 * off + 1, 2) <> substr(r, 2 * off + 1, 2) AND (off % 50 >= 30 OR off >= 2050)) SELECT doc_id, min(off) AS first_off, count(*) AS n_outside FROM c GROUP BY doc_id""",
    "budget_running_totals": """WITH c AS (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS amount FROM lineitem GROUP BY 1, 2), s AS (SELECT *, (sum(amount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::BIGINT AS spent FROM c)
      SELECT *, CASE WHEN spent > 100 THEN 'limit_exceeded' END AS error_code FROM s""",
    "operation_logs": """WITH i AS (SELECT l_orderkey, l_linenumber AS s, max((l_quantity > 48)::INT) AS bad FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, count(*) AS n, min(s) AS low, max(s) AS high, arg_max(bad, s) AS last, max(bad) AS worst FROM i GROUP BY 1)
      SELECT l_orderkey, CASE WHEN low <> 1 OR high <> n THEN 'sequence_not_contiguous' WHEN last = 1 THEN 'final_status_differs' WHEN worst = 1 THEN 'earlier_failure' END AS error_code FROM g""",
    "store_closure": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents)
      SELECT sha256, 'left_only' AS side FROM (SELECT sha256 FROM d WHERE doc_id >= 50 EXCEPT SELECT sha256 FROM d WHERE doc_id < 900) UNION ALL SELECT sha256, 'right_only' FROM (SELECT sha256 FROM d WHERE doc_id < 900 EXCEPT SELECT sha256 FROM d WHERE doc_id >= 50)""",
    "varying_attributes": """WITH p AS (SELECT p_brand, unnest([p_type, p_size::VARCHAR]) AS v, unnest(['p_type', 'p_size']) AS attribute FROM part) SELECT p_brand, attribute, count(DISTINCT v) AS n_values FROM p GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""",
    "declared_totals": "SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS got, sum(l_quantity::BIGINT)::BIGINT + 1 AS want FROM lineitem WHERE l_orderkey % 100 = 1 GROUP BY 1",
    "four_way_agreement": """SELECT page_id AS id, CASE page_id % 10 WHEN 1 THEN 'missing_part' WHEN 2 THEN 'record_differs' WHEN 3 THEN 'manifest_differs' ELSE 'prefix_differs' END AS error_code FROM pages WHERE page_id % 10 BETWEEN 1 AND 4""",
    "suite_digest": """WITH f AS (SELECT n_regionkey, n_name, n_nationkey::VARCHAR AS b FROM nation)
      SELECT n_regionkey, sha256(unhex(hex('suite') || string_agg(printf('%08x', strlen(n_name)) || hex(n_name) || printf('%016x', strlen(b)) || hex(b), '' ORDER BY n_name))) AS digest FROM f GROUP BY 1""",
    "table_digest": """WITH f AS (SELECT s_nationkey, s_suppkey AS id, s_name AS p, printf('%08x', s_suppkey) AS i, printf('%04x', strlen(s_name)) AS n FROM supplier),
      g AS (SELECT *, substr(i, 7, 2) || substr(i, 5, 2) || substr(i, 3, 2) || substr(i, 1, 2) || substr(n, 3, 2) || substr(n, 1, 2) || hex(p) AS x FROM f) SELECT s_nationkey, sha256(unhex(string_agg(x, '' ORDER BY id))) AS digest, count(*) AS n_rows FROM g GROUP BY 1""",
    "header_forward_fill": f"WITH {_TURNS} SELECT *, last_value(CASE WHEN role = 'user' THEN 'turn ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM t",
    "ledger_sections": f"WITH {_TURNS} SELECT conv_id, turn, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section FROM t",
    "zipped_blocks": f"""WITH {_TURNS}, u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM t WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM t WHERE role = 'assistant')
      SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.nth, a.nth) AS nth, u.turn AS target_line, a.turn AS block_line, CASE WHEN u.turn IS NULL OR a.turn IS NULL THEN 'block_count_differs' END AS error_code FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.nth = a.nth""",
    "log_results": """WITH o AS (SELECT o_orderkey AS id FROM orders) SELECT id, greatest(id % 5000, id * 3 % 5000) AS runs, greatest(id % 700, id * 3 % 700) AS rss_mb,
      CASE WHEN id % 14 = 0 THEN 'hang' WHEN id % 5 = 1 THEN 'sanitizer_finding' WHEN id % 5 = 2 THEN 'limit_exceeded' WHEN id % 5 = 3 THEN 'panic' WHEN id % 3 = 0 THEN 'clean' ELSE 'crash' END AS result FROM o""",
    "closure_sum": """WITH RECURSIVE n AS (SELECT i AS node, i // 2 AS parent, i * 17 % 101 AS rss FROM range(1, 400) t(i)), b AS (SELECT i AS root, i AS node FROM range(1, 9) t(i) UNION SELECT b.root, n.node FROM b JOIN n ON n.parent = b.node)
      SELECT root, sum(rss)::BIGINT AS total, count(*) AS n_nodes FROM b JOIN n ON n.node = b.node GROUP BY root""",
    "subset_check": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "changed_indices_recomputed": """WITH e AS (SELECT ts::DATE AS day, user_id AS page, count(*) AS n FROM events GROUP BY 1, 2), z AS (SELECT datediff('day', (SELECT min(day) FROM e), day)::INT AS ordinal, page, n FROM e), o AS (SELECT DISTINCT ordinal FROM z),
  f AS (SELECT coalesce(a.ordinal, b.ordinal + 1) AS ordinal, coalesce(a.page, b.page) AS page, a.n AS now, b.n AS was FROM z a FULL JOIN z b ON a.page = b.page AND a.ordinal = b.ordinal + 1)
  SELECT ordinal::INT AS ordinal, page, 'left_only' AS side FROM f WHERE now IS DISTINCT FROM was AND ordinal IN (FROM o) AND ordinal - 1 IN (FROM o) AND page % 50 = 7""",
}
