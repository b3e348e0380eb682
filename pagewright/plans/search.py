"""Queries of the record-layout search, on small histories that arithmetic makes.

Two replicas, six checkpoints, one page of 64 bytes: a pointer at 10 that moves
on growth, one at 20 that moves on churn, one at 30 that moves always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census, decode
from ..operators import checkpoints as ops
from ..sources.generators import packed_bytes
from .census import P, text_pages

NAMES = [f"c{i}" for i in range(6)]
GROWTH, CHURN = [("c0", "c1"), ("c1", "c2")], [("c3", "c4"), ("c4", "c5")]
COUNTS = (300, 310, 325, 325, 325, 325)
START, END, SIZE = 5, 60, 64


def _byte(replica, at, i):
    grown = F.least(at, F.lit(2)) + 100
    return (
        F.when(i == 10, grown).when(i.isin(11, 12), 0).when(i == 13, 7)
        .when(i == 20, 9).when(i == 21, 200 + F.when(at == 4, 1).otherwise(0)).when(i.isin(22, 23), 0)
        .when(i == 30, 40 + at).when(i.isin(31, 32), 0).when(i == 33, replica)
        .otherwise((i * 37 + 11) % 200 + 1)
    )


_CELLS = f"""v AS (SELECT r, k, i, CASE WHEN i = 10 THEN least(k, 2) + 100 WHEN i IN (11, 12, 22, 23, 31, 32) THEN 0 WHEN i = 13 THEN 7 WHEN i = 20 THEN 9 WHEN i = 21 THEN 200 + (k = 4)::INT
  WHEN i = 30 THEN 40 + k WHEN i = 33 THEN r ELSE (i * 37 + 11) % 200 + 1 END AS v FROM range(1, 3) a(r), range(0, 6) b(k), range(0, {SIZE}) c(i))"""


def _history(spark: SparkSession) -> DataFrame:
    grid = spark.range(12).select((F.floor(F.col("id") / 6) + 1).cast("int").alias("replica"), (F.col("id") % 6).cast("int").alias("ordinal"))
    name = F.concat(F.lit("c"), F.col("ordinal").cast("string"))
    return grid.select("replica", "ordinal", name.alias("checkpoint"), F.lit(1).cast("long").alias("page"), packed_bytes(SIZE, lambda i: _byte(F.col("replica"), F.col("ordinal"), i)).alias("raw"))


def _counts(spark: SparkSession) -> DataFrame:
    count = F.element_at(F.array(*[F.lit(c).cast("long") for c in COUNTS]), F.col("ordinal") + 1)
    return _history(spark).select("replica", "ordinal", "checkpoint", count.alias("page_count"))


def _intervals(spark: SparkSession) -> DataFrame:
    return _history(spark).select("replica", "page").distinct().select("replica", "page", F.lit(START).alias("start"), F.lit(END).alias("end"))


def pointer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are pointers at every checkpoint, used or free by what moves them."""
    return ops.pointer_windows(_history(spark), _counts(spark), _intervals(spark), GROWTH, CHURN)


def returning_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers that nothing but growth, or nothing but churn, moves, and that are back after the churn."""
    return ops.pointer_windows(_history(spark), _counts(spark), _intervals(spark), GROWTH, CHURN, outside=[("c2", "c3")], returns=("c3", "c4", "c5"))


def joint_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that both replicas keep: examined and surviving ones."""
    return ops.joint_models(pointer_windows(spark, sf_dir), surviving_formulas(spark, sf_dir), 2, 1000)


def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used times free offsets of each layout, times surviving formulas."""
    return ops.model_count(pointer_windows(spark, sf_dir), surviving_formulas(spark, sf_dir))


def history_changed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that some growth or churn transition moves."""
    return ops.changed_bytes(_history(spark), [*GROWTH, *CHURN])


def inline_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a bitmap may end: after a byte that is not zero and before zeros only (bytes from 40 on zeroed by checkpoint)."""
    cut = _history(spark).withColumn("raw", F.concat(F.substring("raw", 1, 40), packed_bytes(24, lambda i: F.when(i < F.col("ordinal") + 3, i + 1).otherwise(0))))
    return ops.inline_boundaries(cut, _intervals(spark), F.col("start") + 5)


def explained_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of an inline bitmap that the page counts explain; one replica has a byte left behind them."""
    grid = spark.range(8).select((F.floor(F.col("id") / 4) + 1).cast("int").alias("replica"), (F.col("id") % 4).cast("int").alias("ordinal"))
    at = F.least(F.col("ordinal"), F.lit(2))
    value = lambda i: F.when(i < 5, 1).when(i == 6, 100).when((i >= 10) & (i <= at + 10), 255).when((i == 30) & (F.col("replica") == 2), 7).otherwise(0)
    history = grid.select("replica", "ordinal", F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("checkpoint"), F.lit(1).cast("long").alias("page"), packed_bytes(SIZE, value).alias("raw"))
    counts = history.select("replica", "checkpoint", F.when(F.col("ordinal") == 3, 200).otherwise(F.col("ordinal") * 8 + 108).cast("long").alias("page_count"))
    spans = history.select("replica", "page").distinct().select("replica", "page", F.lit(5).alias("start"), F.lit(40).alias("end"))
    return ops.explained_boundaries(history, counts, spans, ("c0", "c1", "c2"), ops.POLARITIES[0])


def _slots(spark: SparkSession) -> DataFrame:
    """An indirect record at 2 of each page: references by slot, some zero."""
    raw = F.concat(F.lit(b"xx\1"), packed_bytes(20, lambda i: F.when(i % 4 == 0, (F.col("replica") * i + F.col("ordinal")) % 9).otherwise(0)))
    return ops.slot_references(_history(spark).withColumn("raw", raw), 2, 23)


_SLOTS = "s AS (SELECT r, k, j AS slot, (r * 4 * j + k) % 9 AS ref FROM range(1, 3) a(r), range(0, 6) b(k), range(0, 5) c(j) WHERE (r * 4 * j + k) % 9 <> 0)"


def slot_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero references of indirect records."""
    return _slots(spark).select("replica", "ordinal", "slot", "ref")


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where references lead: in range, and to a page that starts with 5."""
    counts = _counts(spark).withColumn("page_count", F.lit(7).cast("long"))
    pages = counts.select("replica", "checkpoint", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("page")).select("replica", "checkpoint", F.col("page").cast("long").alias("page"), F.unhex(F.lpad(F.hex(F.col("page") % 3 + 4), 2, "0")).alias("raw"))
    return ops.reference_edges(_slots(spark), pages, counts).select("replica", "ordinal", "slot", "ref", "error_code")


def _edges(spark: SparkSession) -> DataFrame:
    """Slot 0 leads to page 3, whose bits from 20 up to the page count are set; slot 1 to an empty page 5."""
    grid = _counts(spark).where("ordinal < 3").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"))
    octet = lambda i: F.when(F.col("slot") == 1, 0).otherwise(_byte_of_range(i))
    raw = F.concat(F.lit(b"\5\0\0\0"), packed_bytes(48, octet))
    return grid.select("replica", "ordinal", "checkpoint", "slot", (F.col("slot") * 2 + 3).cast("long").alias("ref"), raw.alias("raw"), F.lit(None).cast("string").alias("error_code"))


def _byte_of_range(i):
    """Byte i of a bitmap of bits 20 to page_count - 1."""
    bits = [F.when((i * 8 + b >= 20) & (i * 8 + b < F.col("page_count")), 1 << b).otherwise(0) for b in range(8)]
    return sum(bits[1:], bits[0])


def surviving_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base formulas whose newly set pages are the appended ones."""
    return ops.surviving_formulas(ops.predicted_pages(_edges(spark)), _counts(spark), GROWTH)


def strict_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base formulas whose new bits stand for all appended pages and no others."""
    return ops.strict_formulas(_edges(spark), _counts(spark), GROWTH)


def covering_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base formulas that take in all pages of the inline record: 20 to 290, or 19 to 290."""
    inline = spark.range(1, 3).select(F.col("id").cast("int").alias("replica"), F.explode(F.sequence(21 - F.col("id"), F.lit(290).cast("long"))).alias("page"))
    return ops.covering_formulas(ops.predicted_pages(_edges(spark)), inline, "c0")


def predicted_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the set bits stand for, by formula: how many, first and last."""
    found = ops.predicted_pages(_edges(spark))
    return found.groupBy("replica", "checkpoint", "formula").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("low"), F.max("page").alias("high"))


def incremental_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every image captured again: some changed, some gone, some new."""
    every = text_pages(spark, sf_dir)
    current = every.where("page % 5 <> 3").withColumn("raw", F.when(F.col("page") % 4 == 1, F.concat(F.lit(b"!"), F.col("raw"))).otherwise(F.col("raw")))
    prior = census.page_digests(every.where("page % 7 <> 2 or page % 5 = 3")).select("image_id", "page", "sha256")
    return ops.capture(current, prior, "image_id").select("image_id", "page", "status", F.octet_length("raw").alias("n_bytes"))


def opened_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all images joined to their blobs by digest; some blobs are not what their digest says."""
    every = census.page_digests(text_pages(spark, sf_dir))
    index = every.select(F.lit(1).alias("replica"), F.col("image_id").cast("int").alias("ordinal"), F.col("image_id").cast("string").alias("checkpoint"), "page", "sha256")
    blobs = every.select("sha256", "raw").distinct().withColumn("raw", F.when(F.col("sha256") < "2", F.lit(b"?")).otherwise(F.col("raw")))
    found = ops.opened(index, blobs, index.select("replica", "page").distinct())
    return found.select("ordinal", "page", F.octet_length("raw").alias("n_bytes"), "error_code")


QUERIES = {
    f.__name__: f
    for f in (
        pointer_windows, returning_windows, joint_models, explained_boundaries, strict_formulas, covering_formulas, model_counts, history_changed_bytes, inline_boundaries, slot_references, reference_edges, surviving_formulas, predicted_page_counts, incremental_capture, opened_blobs,
    )
}

_N = "CASE k " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(COUNTS)) + " END"
_WINDOWS = f"""{_CELLS}, w AS (SELECT a.r, a.k, a.i, a.v AS v0, b.v AS v1, c.v AS v2, d.v AS v3 FROM v a JOIN v b ON b.r = a.r AND b.k = a.k AND b.i = a.i + 1 JOIN v c ON c.r = a.r AND c.k = a.k AND c.i = a.i + 2
    JOIN v d ON d.r = a.r AND d.k = a.k AND d.i = a.i + 3 WHERE a.i BETWEEN {START} AND {END - 4}),
  l AS (SELECT *, 'u24le_page_then_u8_slot' AS layout, v0 + 256 * v1 + 65536 * v2 AS p FROM w UNION ALL SELECT *, 'u8_slot_then_u24le_page', v1 + 256 * v2 + 65536 * v3 FROM w),
  g AS (SELECT r, i, layout, bool_and(p >= 1 AND p < {_N}) AS inside, count(DISTINCT (v0, v1, v2, v3)) FILTER (k <= 2) > 1 AS grows, count(DISTINCT (v0, v1, v2, v3)) FILTER (k >= 3) > 1 AS churns FROM l GROUP BY ALL),
  q AS (SELECT r, i, layout, CASE WHEN grows THEN 'used' ELSE 'free' END AS role FROM g WHERE inside AND grows <> churns)"""
_FORMULA = " UNION ALL ".join(
    f"SELECT r, k, bit, '{f}' AS formula, {'0' if f.startswith('slot') else '3'} + {(-1 if f.endswith('minus_one') else 1 if f.endswith('plus_one') else 0)} + bit AS page FROM b" for f in decode.BASE_FORMULAS
)
_BITS = f"b AS (SELECT r, k, unnest(range(20, {_N})) AS bit FROM range(1, 3) x(r), range(0, 3) y(k)), f AS ({_FORMULA})"
_SURVIVORS = f"""{_BITS}, n AS (SELECT a.r, a.formula, a.page, a.k FROM f a WHERE a.k > 0 AND NOT EXISTS (FROM f c WHERE c.r = a.r AND c.formula = a.formula AND c.k = a.k - 1 AND c.page = a.page)),
  z AS (SELECT r, formula FROM n GROUP BY r, formula HAVING bool_and(page >= CASE k WHEN 1 THEN 300 ELSE 310 END AND page < CASE k WHEN 1 THEN 310 ELSE 325 END))"""

SQL = {
    "pointer_windows": f"WITH {_WINDOWS} SELECT r::INT AS replica, 1::BIGINT AS page, i::INT AS off, layout, role FROM q",
    "model_counts": f"""WITH {_WINDOWS}, {_SURVIVORS}, m AS (SELECT r, layout, count(*) FILTER (role = 'used') * count(*) FILTER (role = 'free') AS pairs FROM q GROUP BY 1, 2)
      SELECT r::INT AS replica, (sum(pairs) * (SELECT count(*) FROM z WHERE z.r = m.r))::BIGINT AS n_models FROM m GROUP BY r""",
    "history_changed_bytes": f"WITH {_CELLS} SELECT r::INT AS replica, 1::BIGINT AS page, i::INT AS off FROM v GROUP BY r, i HAVING count(DISTINCT v) FILTER (k <= 2) > 1 OR count(DISTINCT v) FILTER (k >= 3) > 1",
    "inline_boundaries": f"""WITH {_CELLS}, c AS (SELECT r, k, i, CASE WHEN i < 40 THEN v WHEN i - 40 < k + 3 THEN i - 39 ELSE 0 END AS v FROM v WHERE i >= {START} AND i < {END}),
      o AS (SELECT r, i, max(v) AS most, max(v) FILTER (k = 5) AS last_v FROM c GROUP BY 1, 2)
      SELECT r::INT AS replica, 1::BIGINT AS page, (i + 1)::INT AS boundary FROM o a WHERE last_v <> 0 AND i >= {START} + 5 AND NOT EXISTS (FROM o b WHERE b.r = a.r AND b.i > a.i AND b.most <> 0)""",
    "returning_windows": f"""WITH {_WINDOWS}, t AS (SELECT r, i, layout, bool_and(p >= 1 AND p < {_N}) AS inside, count(DISTINCT (v0, v1, v2, v3)) FILTER (k <= 2) > 1 AS grows, count(DISTINCT (v0, v1, v2, v3)) FILTER (k >= 3) > 1 AS churns,
        count(DISTINCT (v0, v1, v2, v3)) FILTER (k IN (2, 3)) > 1 AS strays, count(DISTINCT (v0, v1, v2, v3)) FILTER (k IN (3, 4)) > 1 AND count(DISTINCT (v0, v1, v2, v3)) FILTER (k IN (3, 5)) = 1 AS back FROM l GROUP BY 1, 2, 3)
      SELECT r::INT AS replica, 1::BIGINT AS page, i::INT AS off, layout, CASE WHEN grows THEN 'used' ELSE 'free' END AS role FROM t WHERE inside AND NOT strays AND (grows AND NOT churns OR churns AND back AND NOT grows)""",
    "joint_models": f"""WITH {_WINDOWS}, {_SURVIVORS}, u AS (SELECT layout, role, i FROM q GROUP BY ALL HAVING count(DISTINCT r) = 2), m AS (SELECT layout, count(*) FILTER (role = 'used') AS a, count(*) FILTER (role = 'free') AS b FROM u GROUP BY 1)
      SELECT (sum(a * b) * 6)::BIGINT AS examined, (sum(a * b) * (SELECT count(*) FROM (SELECT formula FROM z GROUP BY 1 HAVING count(*) = 2)))::BIGINT AS survivors, CASE WHEN sum(a * b) * 6 > 1000 THEN 'resource_bound' END AS error_code FROM m""",
    "explained_boundaries": """WITH c AS (SELECT r, k, i, CASE WHEN i >= 10 AND i <= least(k, 2) + 10 THEN 255 WHEN i = 30 AND r = 2 THEN 7 ELSE 0 END AS v FROM range(1, 3) a(r), range(0, 4) b(k), range(10, 40) d(i)),
      m AS (SELECT r, i, bool_or(k < 3 AND v <> (1 << greatest(0, least(8, 8 * (k + 1) - 8 * (i - 10)))::INT) - 1) AS wrong, bool_or(v <> 0) AS used FROM c GROUP BY 1, 2)
      SELECT r::INT AS replica, 1::BIGINT AS page, e::INT AS boundary, CASE WHEN bool_or(used AND i >= e) THEN 'suffix' ELSE 'survives' END AS status FROM m, range(10, 41) t(e)
      GROUP BY r, e HAVING NOT bool_or(wrong AND i < e) AND e - 10 IN (SELECT k + 1 FROM range(0, 3) w(k))""",
    "strict_formulas": f"""WITH {_SURVIVORS} SELECT r::INT AS replica, formula FROM n GROUP BY r, formula
      HAVING bool_and(page >= CASE k WHEN 1 THEN 300 ELSE 310 END AND page < CASE k WHEN 1 THEN 310 ELSE 325 END) AND count(DISTINCT page) FILTER (k = 1) = 10 AND count(DISTINCT page) FILTER (k = 2) = 15""",
    "covering_formulas": f"""WITH {_BITS}, w AS (SELECT r, unnest(range(21 - r, 291)) AS page FROM range(1, 3) x(r))
      SELECT r::INT AS replica, formula FROM (SELECT DISTINCT r, formula, page FROM f WHERE k = 0) JOIN w USING (r, page) GROUP BY r, formula HAVING count(*) = 270 + r""",
    "slot_references": f"WITH {_SLOTS} SELECT r::INT AS replica, k::INT AS ordinal, slot::INT AS slot, ref::BIGINT AS ref FROM s",
    "reference_edges": f"WITH {_SLOTS} SELECT r::INT AS replica, k::INT AS ordinal, slot::INT AS slot, ref::BIGINT AS ref, CASE WHEN ref >= 7 THEN 'reference_out_of_range' WHEN ref % 3 <> 1 THEN 'not_an_extended_bitmap' END AS error_code FROM s",
    "surviving_formulas": f"WITH {_SURVIVORS} SELECT r::INT AS replica, formula FROM z",
    "predicted_page_counts": f"WITH {_BITS} SELECT r::INT AS replica, 'c' || k AS checkpoint, formula, count(*) AS n, min(page)::BIGINT AS low, max(page)::BIGINT AS high FROM f GROUP BY 1, 2, 3",
    "incremental_capture": f"""WITH {P}, s AS (SELECT image_id, page, length(x) // 2 AS n, page % 5 <> 3 AS now, page % 7 <> 2 OR page % 5 = 3 AS was, page % 4 = 1 AS moved FROM p),
      t AS (SELECT image_id, page, n, moved, CASE WHEN NOT now THEN 'removed' WHEN NOT was THEN 'added' WHEN moved THEN 'changed' ELSE 'unchanged' END AS status FROM s)
      SELECT image_id, page, status, CASE WHEN status IN ('added', 'changed') THEN (n + moved::INT)::INT END AS n_bytes FROM t""",
    "opened_blobs": f"""WITH {P}, dd AS (SELECT image_id, page, length(x) // 2 AS n, sha256(unhex(x)) < '2' AS bad FROM p)
      SELECT image_id::INT AS ordinal, page, CASE WHEN NOT bad THEN n::INT END AS n_bytes, CASE WHEN bad THEN 'unreconstructable_snapshot' END AS error_code FROM dd""",
}
