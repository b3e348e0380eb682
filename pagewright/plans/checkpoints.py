"""Queries over checkpoint histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoints as ops
from ..operators import evidence
from ..sources.generators import page_history
from ..sources.images import PAGE_SIZE

#: The ordered checkpoints of the second experiment.
CHECKPOINTS = (
    "E0 E0R D_GROW_0128 D_DROP D_RECREATE_EMPTY D_REGROW_0128 L_REL_0064 L_REL_0512 L_REL_0768 L_REL_0896 L_REL_0904 L_REL_1024 L_REL_1088 L_REL_1280 "
    "L_DELETE_ALL L_REINSERT_SAME L_IDLE_REOPEN P_ABS_04096 P_ABS_08192 P_ABS_12288 P_ABS_16480 H_REL_0064 H_REL_0896 H_REL_0904 H_IDLE_REOPEN"
).split()
LOW = [c for c in CHECKPOINTS if c.startswith("L_REL")]
HIGH = [c for c in CHECKPOINTS if c.startswith("H_REL")]
GROWTH = [*zip(LOW, LOW[1:]), *zip(HIGH, HIGH[1:])]  # noqa: B905
CHURN = [("L_REL_1280", "L_DELETE_ALL"), ("L_DELETE_ALL", "L_REINSERT_SAME")]
IDLE = [("E0", "E0R"), ("L_REINSERT_SAME", "L_IDLE_REOPEN"), ("H_REL_0904", "H_IDLE_REOPEN")]
ROLES = {
    "empty": "E0R", "grown": "D_GROW_0128", "dropped": "D_DROP", "regrown": "D_REGROW_0128",
    "low_first": "L_REL_0064", "low_last": "L_REL_1280", "high_first": "H_REL_0064", "high_last": "H_REL_0904",
}
PAGES = 40
#: Bytes before a strip that intervals ending in it reach.
BEFORE = 31


def _state(replica, ordinal, page):
    """By page mod 5: constant; with the ordinal, but for idle ones; alternating in the first phase; with the ordinal in tens; missing at first."""
    idle = F.when(ordinal == 1, 0).when(ordinal == 16, 15).when((ordinal == 24) & (page % 10 != 6), 23).otherwise(ordinal)
    phase = F.when(ordinal.isin(2, 5), 100).when(ordinal < 6, 0).otherwise(ordinal)
    return (
        F.when(page % 5 == 0, page)
        .when(page % 5 == 1, page * 1000 + idle)
        .when(page % 5 == 2, page * 1000 + F.when(ordinal.isin(16, 24), phase - 1).otherwise(phase))
        .when(page % 5 == 3, page * 1000 + F.floor(ordinal / 10).cast("int"))
        .when((page % 5 == 4) & (ordinal >= replica), page * 1000 + replica)
    )


_INDEX = f"""x AS (SELECT replica, ordinal, page, CASE page % 5 WHEN 0 THEN page
    WHEN 1 THEN page * 1000 + CASE WHEN ordinal = 1 THEN 0 WHEN ordinal = 16 THEN 15 WHEN ordinal = 24 AND page % 10 <> 6 THEN 23 ELSE ordinal END
    WHEN 2 THEN page * 1000 + CASE WHEN ordinal IN (16, 24) THEN ordinal - 1 WHEN ordinal IN (2, 5) THEN 100 WHEN ordinal < 6 THEN 0 ELSE ordinal END
    WHEN 3 THEN page * 1000 + ordinal // 10 ELSE CASE WHEN ordinal >= replica THEN page * 1000 + replica END END AS s
  FROM range(1, 4) a(replica), range(0, {len(CHECKPOINTS)}) b(ordinal), range(0, {PAGES}) c(page)), y AS (SELECT * FROM x WHERE s IS NOT NULL)"""


def _index(spark: SparkSession) -> DataFrame:
    return page_history(spark, 3, CHECKPOINTS, PAGES, _state)


def _at(name: str) -> str:
    return f"max(s) FILTER (ordinal = {CHECKPOINTS.index(name)})"


def idle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an idle pair changed."""
    return ops.idle_pairs_differ(_index(spark), IDLE).select("replica", "before", "after", "page")


def aba_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose digests follow allocation."""
    return ops.tracks_allocation(_index(spark), ROLES)


def qualify_global_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that change on growth and on release."""
    return ops.qualify_global(_index(spark))


def qualify_tdef_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that change in some growth and in every churn transition."""
    return ops.qualify_tdef(_index(spark), GROWTH, CHURN)


def qualified_page_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a replica's qualified pages are too many."""
    return ops.qualified_bound(qualify_tdef_pages(spark, sf_dir), 12)


def history_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed, added and removed pages of each checkpoint."""
    return ops.changed_pages(_index(spark))


def checkpoint_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive checkpoints of each replica."""
    return ops.transitions(_index(spark).select("replica", "ordinal", "checkpoint").distinct())


def _events_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as checkpoints, users as pages, the day's events as digest."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), "user_id", "event_id")
    state = events.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n"))
    first = events.agg(F.min("day").alias("first"))
    return state.join(F.broadcast(first)).select(
        F.lit(1).alias("replica"), F.datediff("day", "first").alias("ordinal"), F.col("day").cast("string").alias("checkpoint"), F.col("user_id").alias("page"), F.sha2(F.col("n").cast("string").cast("binary"), 256).alias("sha256")
    )


_DAYS = "e AS (SELECT ts::DATE AS day, user_id AS page, count(*) AS n FROM events GROUP BY 1, 2), z AS (SELECT datediff('day', (SELECT min(day) FROM e), day)::INT AS ordinal, page, n, day FROM e), o AS (SELECT DISTINCT ordinal FROM z)"


def checkpoint_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events of a day differ in number from the day before, by day."""
    changed = ops.changed_pages(_events_index(spark, sf_dir))
    return changed.groupBy("ordinal", "status").agg(F.count(F.lit(1)).alias("n_pages"))


def checkpoint_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of event type and user bucket that no event has."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 400).alias("bucket"), "user_id")
    some = events.where("user_id % 3 = 0")
    return evidence.incomplete(some, events, events, "event_type", "bucket")


def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessors by name: one is wrong, one ordinal is left out."""
    rows = spark.range(75).select((F.floor(F.col("id") / 25) + 1).cast("int").alias("replica"), (F.col("id") % 25).cast("int").alias("ordinal")).where("not (replica = 2 and ordinal = 7)")
    name = lambda o: F.concat(F.lit("C"), o.cast("string"))
    before = F.when(F.col("ordinal") > 0, name(F.col("ordinal") - 1))
    rows = rows.withColumn("checkpoint", name(F.col("ordinal"))).withColumn("predecessor", F.when((F.col("replica") == 3) & (F.col("ordinal") == 4), F.lit("C9")).otherwise(before))
    return evidence.chain_errors(rows).where("error_code is not null")


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text whole, in strips of PAGE_SIZE bytes: offset, number of bytes, and the bytes with the 31 before them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    cut = docs.where("octet_length(b) > 0").select("page", "b", F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(PAGE_SIZE))).alias("off"))
    raw = F.substring(F.concat(F.lit(bytes(BEFORE)), F.col("b")), F.col("off") + 1, F.lit(PAGE_SIZE + BEFORE))
    return cut.select("page", "off", F.least(F.lit(PAGE_SIZE), F.octet_length("b") - F.col("off")).alias("n"), raw.alias("raw"))


def _signs(raw):
    """Bytes as a text of one sign each."""
    return F.decode(raw, "ISO-8859-1")


def _spaces(signs):
    return F.length(signs) - F.length(F.replace(signs, F.lit(" "), F.lit("")))


def _last(strips: DataFrame) -> DataFrame:
    """Offsets of the last byte above 127 and of the last 33 of each strip, null if it has none."""
    back = F.reverse(_signs(F.substring("raw", BEFORE + 1, PAGE_SIZE)))
    at = lambda found: F.when(found > 0, F.col("off") + F.col("n") - found)
    return strips.select("page", "off", "n", at(F.regexp_instr(back, F.lit("[\\x80-\\xff]"))).alias("top"), at(F.instr(back, "!")).alias("used"))


#: DuckDB: every byte of every text.
_BYTES = """d AS (SELECT doc_id AS page, hex(encode(coalesce(text, ''))) AS h FROM documents),
  b AS (SELECT page, off::INT AS off, ('0x' || substr(h, 2 * off + 1, 2))::INT AS v FROM (SELECT page, h, unnest(range(0, length(h) // 2)) AS off FROM d))"""


def prefix_sum_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces in the half-open interval of 32 bytes that ends after each offset, and up to it: running counts are carried from strip to strip.

    Within a strip 32 bytes and the 31 before them are the bits of one number.
    """
    strips = _strips(spark, sf_dir).withColumn("flag", _spaces(_signs(F.substring("raw", BEFORE + 1, PAGE_SIZE))))
    sums = ops.prefix_sums(strips, ["flag"], "page", keep=["n", "raw", "flag"])
    parts = sums.select("page", "off", "n", "raw", (F.col("flag_upto") - F.col("flag")).alias("carried"), F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(32))).alias("at"))
    inside = _signs(F.substring("raw", F.lit(BEFORE + 1), F.col("at")))
    digits = F.rpad(F.replace(F.regexp_replace(_signs(F.substring("raw", F.col("at") + 1, F.lit(BEFORE + 32))), r"(?s)[^ ]", "0"), F.lit(" "), F.lit("1")), BEFORE + 32, "0")
    parts = parts.select("page", (F.col("off") + F.col("at")).alias("start"), F.least(F.lit(32), F.col("n") - F.col("at")).alias("n"), (F.col("carried") + _spaces(inside)).alias("carried"), F.conv(digits, 2, 10).cast("long").alias("bits"))
    rows = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    upto = F.call_function("shiftright", F.col("bits"), 31 - F.col("i"))
    one = F.lit(1).cast("long")
    own = F.bit_count(upto.bitwiseAND(F.call_function("shiftleft", one, F.col("i") + 1) - 1))
    window = F.bit_count(upto.bitwiseAND(F.lit((1 << 32) - 1).cast("long")))
    return rows.select("page", (F.col("start") + F.col("i")).alias("off"), (F.col("carried") + own).alias("flag_upto"), window.cast("long").alias("in_interval"))


def last_changed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest offset above 127 of a page, where it is not below a byte, and the suffix slack after it.

    A strip stands at its last changed byte, or where it begins: then what holds of it holds of its bytes up to the page's last.
    """
    strips = _last(_strips(spark, sf_dir)).select("page", F.col("off").alias("start"), "n", F.coalesce("top", "off").alias("off"), F.col("top").isNotNull().alias("changed"))
    rows = ops.last_changed(strips, "page").select("page", "last_from", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("off"))
    top = F.when(F.col("last_from") >= F.col("off"), F.col("last_from"))
    return rows.select("page", "off", F.coalesce(top, F.lit(-1)).alias("last_from"), (top + 1).alias("suffix_start"))


def suffix_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a text after the last changed one, if none of them is in use."""
    strips = _last(_strips(spark, sf_dir)).withColumn("length", F.col("off") + F.col("n"))
    mark = lambda at, changed: F.struct(F.coalesce(at, F.col("off")).alias("off"), (at.isNotNull() & F.lit(changed)).alias("changed"), (at.isNull() | F.lit(changed)).alias("unused"))
    flags = strips.select("page", "length", F.explode(F.array(mark(F.col("top"), True), mark(F.col("used"), False))).alias("m")).select("page", "length", "m.*")
    return ops.suffix_slack(flags, F.max("length"), "page").select("page", F.col("slack").cast("long").alias("slack"))


def single_change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose days go from few events to many once and for all."""
    days = _events_index(spark, sf_dir).select("page", "ordinal")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.max("value") > 10).cast("int").alias("v"))
    table = events.select(F.col("user_id").alias("page"), F.unix_date("day").alias("ordinal"), "v")
    return ops.change_points(table.join(days.select("page").distinct(), "page", "left_semi"), "page")


def growth_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first state of each replica with as many pages as a threshold."""
    states = spark.range(3 * 200).select((F.floor(F.col("id") / 200) + 1).cast("int").alias("replica"), (F.col("id") % 200).alias("ordinal")).withColumn("page_count", F.col("ordinal") * 13 + F.col("replica") * 5)
    return evidence.growth_targets(states, [512 * i for i in range(1, 5)], "replica")



def growth_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that take a table to each page target."""
    return evidence.growth_schedule(spark, [4096, 8192, 12288, 16480], 1300, 37)


def inline_record_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of records on a 256-byte page whose bitmap behaves as an allocation map's, by polarity."""
    return ops.record_relations(_record_history(spark), ("E0", "D_GROW_0128", "D_DROP", "D_REGROW_0128"), page_size=256)


def released_record_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those whose bits are released when the table is made again and whose pages in use end at the page count."""
    names = ("E0", "D_GROW_0128", "D_DROP", "D_REGROW_0128")
    history = _record_history(spark, True)
    found = ops.record_relations(history, names, page_size=256, recreated="D_RECREATE_EMPTY")
    size = F.when(F.col("checkpoint") == "E0", 1).when(F.col("checkpoint") == "D_REGROW_0128", 6).otherwise(4 + F.when(F.col("replica") == 2, 1).otherwise(0))
    counts = history.select("replica", "checkpoint").distinct().withColumn("page_count", size)
    return ops.at_highwater(found, history, counts, ("E0", "D_GROW_0128", "D_REGROW_0128"))


def _record_history(spark: SparkSession, recreated: bool = False) -> DataFrame:
    """Per replica two pages: a record at 40 with set bits in use, one at 60 with clear bits in use; made again, replica 3 keeps a bit."""
    from ..sources.generators import packed_bytes

    names = ("E0", "D_GROW_0128", "D_DROP", "D_REGROW_0128", *(["D_RECREATE_EMPTY"] if recreated else []))
    # bits of the record's first bitmap bytes at each checkpoint
    used = {"E0": 0x01, "D_GROW_0128": 0x0F, "D_DROP": 0x01, "D_REGROW_0128": 0x3F, "D_RECREATE_EMPTY": 0x01}
    out = None
    for at, name in enumerate(names):
        for page, start, flip in ((1, 40, 0), (2, 60, 255)):
            bits = F.lit(used[name] ^ flip)
            if name == "D_RECREATE_EMPTY":
                bits = F.when(F.col("id") == 3, 0x03 ^ flip).otherwise(bits)

            def value(i, start=start, bits=bits, flip=flip):
                edge = F.when((i >= start) & (i < start + 5), 0).when((i >= start + 5) & (i < start + 8), bits).when(i >= start + 8, flip)
                return edge.otherwise((i * 3 + 7) % 251 + 1)

            rows = spark.range(1, 4).select(F.col("id").cast("int").alias("replica"), F.lit(at).alias("ordinal"), F.lit(name).alias("checkpoint"), F.lit(page).cast("long").alias("page"), packed_bytes(256, value).alias("raw"))
            out = rows if out is None else out.unionByName(rows)
    return out


def record_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last byte that transitions change."""
    moved = ops.changed_bytes(_record_history(spark), [("E0", "D_GROW_0128"), ("D_GROW_0128", "D_DROP"), ("D_DROP", "D_REGROW_0128")])
    return ops.record_interval(moved)


def replica_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models (start, polarity, slack) that all replicas keep, with each layer's outcome beside them."""
    found = inline_record_relations(spark, sf_dir)
    agreed = ops.replicas_agree(found, 3, "page", "start", "polarity", "slack")
    outcomes = ops.layer_outcome(found, found, "page", "start", "polarity")
    return agreed.join(outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_replicas")))


QUERIES = {
    f.__name__: f
    for f in (
        idle_gate, aba_pages, qualify_global_pages, qualify_tdef_pages, qualified_page_bound, history_changed_pages, checkpoint_transitions, checkpoint_changed_pages, checkpoint_completeness,
        chain_order, prefix_sum_intervals, last_changed_offsets, suffix_slack, single_change_point, growth_targets, growth_schedule, inline_record_relations, released_record_relations, record_intervals, replica_agreement,
    )
}

_R = {k: _at(v) for k, v in ROLES.items()}
_TDEF = f"""{_INDEX}, t AS (SELECT replica, page FROM y GROUP BY 1, 2 HAVING {_at("E0")} IS NOT NULL AND ({" OR ".join(f"{_at(a)} IS DISTINCT FROM {_at(b)}" for a, b in GROWTH)})
  AND {" AND ".join(f"{_at(a)} IS DISTINCT FROM {_at(b)}" for a, b in CHURN)})"""
_CHANGES = "f AS (SELECT coalesce(a.replica, b.replica) AS replica, coalesce(a.ordinal, b.ordinal + 1) AS ordinal, coalesce(a.page, b.page) AS page, a.s AS now, b.s AS was FROM {t} a FULL JOIN {t} b ON a.replica = b.replica AND a.page = b.page AND a.ordinal = b.ordinal + 1)"
_RECORDS = "(VALUES (1, 40, 'set_means_in_use'), (2, 60, 'set_means_not_in_use')) v(page, start, polarity)"

SQL = {
    "idle_gate": f"WITH {_INDEX}, p AS (" + " UNION ALL ".join(f"SELECT replica, '{a}' AS before, '{b}' AS after, page FROM y GROUP BY replica, page HAVING {_at(a)} IS DISTINCT FROM {_at(b)}" for a, b in IDLE) + ") SELECT replica::INT AS replica, before, after, page FROM p",
    "aba_pages": f"""WITH {_INDEX} SELECT replica::INT AS replica, page FROM y GROUP BY 1, 2 HAVING {" AND ".join(f"{v} IS NOT NULL" for v in _R.values())}
      AND {_R["grown"]} = {_R["regrown"]} AND {_R["grown"]} <> {_R["dropped"]} AND {_R["grown"]} <> {_R["empty"]} AND {_R["low_first"]} <> {_R["low_last"]} AND {_R["high_first"]} <> {_R["high_last"]}""",
    "qualify_global_pages": f"WITH {_INDEX} SELECT replica::INT AS replica, page FROM y GROUP BY 1, 2 HAVING {_at('E0')} IS DISTINCT FROM {_at('D_GROW_0128')} AND {_at('D_GROW_0128')} IS DISTINCT FROM {_at('D_DROP')}",
    "qualify_tdef_pages": f"WITH {_TDEF} SELECT replica::INT AS replica, page FROM t",
    "qualified_page_bound": f"WITH {_TDEF} SELECT replica::INT AS replica, count(*) AS n_pages, CASE WHEN count(*) > 12 THEN 'resource_bound' END AS error_code FROM t GROUP BY 1",
    "history_changed_pages": f"WITH {_INDEX}, {_CHANGES.format(t='y')} SELECT replica::INT AS replica, ordinal::INT AS ordinal, page, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS status FROM f WHERE now IS DISTINCT FROM was AND ordinal BETWEEN 1 AND {len(CHECKPOINTS) - 1}",
    "checkpoint_transitions": "WITH c AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CHECKPOINTS) + f"]) AS c, unnest(range(0, {len(CHECKPOINTS)})) AS i) SELECT r::INT AS replica, a.c AS before, b.c AS after FROM range(1, 4) t(r), c a JOIN c b ON b.i = a.i + 1",
    "checkpoint_changed_pages": f"""WITH {_DAYS}, y AS (SELECT 1 AS replica, ordinal, page, n AS s FROM z), {_CHANGES.format(t='y')}
      SELECT ordinal::INT AS ordinal, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS status, count(*) AS n_pages FROM f WHERE now IS DISTINCT FROM was AND ordinal IN (FROM o) AND ordinal - 1 IN (FROM o) GROUP BY 1, 2""",
    "checkpoint_completeness": """WITH a AS (SELECT DISTINCT event_type FROM events), b AS (SELECT DISTINCT user_id % 400 AS bucket FROM events), h AS (SELECT DISTINCT event_type, user_id % 400 AS bucket FROM events WHERE user_id % 3 = 0)
      SELECT event_type, bucket, 'left_only' AS side FROM a, b WHERE (event_type, bucket) NOT IN (FROM h)""",
    "chain_order": """WITH r AS (SELECT r AS replica, o AS ordinal, CASE WHEN r = 3 AND o = 4 THEN 'C9' WHEN o > 0 THEN 'C' || (o - 1) END AS predecessor FROM range(1, 4) a(r), range(0, 25) b(o) WHERE NOT (r = 2 AND o = 7)),
      l AS (SELECT *, lag('C' || ordinal) OVER w AS before, row_number() OVER w - 1 AS place FROM r WINDOW w AS (PARTITION BY replica ORDER BY ordinal)),
      c AS (SELECT *, CASE WHEN ordinal <> place THEN 'ordinal_gap' WHEN predecessor IS DISTINCT FROM before THEN 'predecessor_differs' END AS error_code FROM l)
      SELECT replica::INT AS replica, ordinal::INT AS ordinal, error_code FROM c WHERE error_code IS NOT NULL""",
    "prefix_sum_intervals": f"""WITH {_BYTES}, s AS (SELECT page, off, sum((v = 32)::INT) OVER (PARTITION BY page ORDER BY off)::BIGINT AS flag_upto, sum((v = 32)::INT) OVER (PARTITION BY page ORDER BY off ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)::BIGINT AS in_interval FROM b) SELECT * FROM s""",
    "last_changed_offsets": f"""WITH {_BYTES}, t AS (SELECT *, max(off) FILTER (v > 127) OVER (PARTITION BY page) AS top FROM b)
      SELECT page, off, CASE WHEN top >= off THEN top ELSE -1 END AS last_from, CASE WHEN top >= off THEN top + 1 END AS suffix_start FROM t""",
    "suffix_slack": f"""WITH {_BYTES}, t AS (SELECT page, count(*) AS n, max(off) FILTER (v > 127) AS top, max(off) FILTER (v = 33) AS bad FROM b GROUP BY page)
      SELECT page, CASE WHEN top IS NULL OR coalesce(bad > top, false) THEN 0 ELSE n - 1 - top END::BIGINT AS slack FROM t""",
    "single_change_point": """WITH v AS (SELECT user_id AS page, ts::DATE AS day, max(value) > 10 AS high FROM events GROUP BY 1, 2)
      SELECT page, datediff('day', DATE '1970-01-01', min(day) FILTER (high))::INT AS first FROM v GROUP BY page HAVING count(*) FILTER (high) > 0 AND count(*) FILTER (NOT high) > 0 AND min(day) FILTER (high) > max(day) FILTER (NOT high)""",
    "growth_targets": """WITH s AS (SELECT r AS replica, o AS ordinal, o * 13 + r * 5 AS page_count FROM range(1, 4) a(r), range(0, 200) b(o)), t AS (SELECT i * 512 AS threshold FROM range(1, 5) c(i))
      SELECT replica::INT AS replica, threshold, min(ordinal) AS ordinal, min(page_count) AS page_count, min(page_count) - threshold AS overshoot FROM s JOIN t ON page_count >= threshold GROUP BY replica, threshold""",
    "growth_schedule": """WITH RECURSIVE t AS (SELECT * FROM (VALUES (1, 4096), (2, 8192), (3, 12288), (4, 16480)) v(step, threshold)),
      s AS (SELECT 0 AS step, 0::BIGINT AS threshold, 0::BIGINT AS batches, 1300::BIGINT AS page_count
        UNION ALL SELECT t.step, t.threshold, ceil((t.threshold - s.page_count) / 37.0)::BIGINT, s.page_count + ceil((t.threshold - s.page_count) / 37.0)::BIGINT * 37 FROM s JOIN t ON t.step = s.step + 1)
      SELECT step, threshold, batches, page_count FROM s WHERE step > 0""",
    "inline_record_relations": f"SELECT r::INT AS replica, page::BIGINT AS page, start, polarity, 255 - (start + 7) AS slack FROM range(1, 4) t(r), {_RECORDS}",
    "released_record_relations": f"""WITH h AS (SELECT r, 1 AS empty, 15 AS grown, 1 AS dropped, 63 AS regrown, CASE r WHEN 3 THEN 3 ELSE 1 END AS again, CASE r WHEN 2 THEN 5 ELSE 4 END AS n FROM range(1, 4) t(r)), g AS (SELECT *, grown & ~empty AS gained FROM h)
      SELECT r::INT AS replica, page::BIGINT AS page, start, polarity, 255 - (start + 7) AS slack FROM g, {_RECORDS}
      WHERE gained <> 0 AND gained & dropped = 0 AND gained & again = 0 AND gained & ~regrown = 0 AND regrown & ~grown <> 0 AND empty & 3 = 1 AND grown & ((2 << n) - 1) = (1 << n) - 1 AND regrown & 127 = 63""",
    "record_intervals": f"SELECT r::INT AS replica, page::BIGINT AS page, start + 5 AS start, start + 8 AS \"end\", 'ambiguous_record_boundary' AS error_code FROM range(1, 4) t(r), {_RECORDS}",
    "replica_agreement": f"SELECT page::BIGINT AS page, start, polarity, 255 - (start + 7) AS slack, 'ambiguous_model' AS outcome, 3::BIGINT AS n_replicas FROM {_RECORDS}",
}
