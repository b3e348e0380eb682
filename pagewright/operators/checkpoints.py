"""Analysis of checkpoint histories: changed pages, qualification, record layout, model survival.

Relations: ``page_index`` (replica, ordinal, checkpoint, page, sha256), ``blobs``
(sha256, raw) and ``counts`` (replica, ordinal, checkpoint, page_count).  A
transition is a pair of checkpoint names.  Pages are qualified on digests alone;
blobs are joined only to the few pages that remain, and bytes become rows only
for those.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import chunk, differing, read_uint, set_bits
from ..sources.images import PAGE_SIZE, byte
from .decode import BASE_FORMULAS, EXTENDED_HEADER, POINTER_LAYOUTS, active_slots, extended_base, pointer

Transitions = Sequence[tuple[str, str]]
POLARITIES = ("set_means_in_use", "set_means_not_in_use")


def transitions(checkpoints: DataFrame) -> DataFrame:
    """(replica, before, after): consecutive checkpoints by ordinal."""
    order = Window.partitionBy("replica").orderBy("ordinal")
    pairs = checkpoints.withColumn("before", F.lag("checkpoint").over(order)).where("before is not null")
    return pairs.select("replica", "before", F.col("checkpoint").alias("after"))


def changed_pages(page_index: DataFrame) -> DataFrame:
    """(replica, ordinal, page, status) of each page that differs from the checkpoint before; missing on one side is changed."""
    now = page_index.select("replica", "ordinal", "page", F.col("sha256").alias("now"))
    was = page_index.select("replica", (F.col("ordinal") + 1).alias("ordinal"), "page", F.col("sha256").alias("was"))
    # a checkpoint after the last, or before the first, has no predecessor to differ from
    known = page_index.select("replica", "ordinal").distinct()
    pairs = known.alias("a").join(known.select("replica", (F.col("ordinal") + 1).alias("ordinal")), ["replica", "ordinal"])
    both = now.join(was, ["replica", "ordinal", "page"], "full").join(pairs, ["replica", "ordinal"], "left_semi")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("now").eqNullSafe(F.col("was"))).select("replica", "ordinal", "page", status.alias("status"))


def capture(current: DataFrame, prior: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, sha256, raw, status) of an incremental capture: unchanged pages carry no bytes, removed ones no digest.

    current: (keys, page, raw); prior: (keys, page, sha256).
    """
    now = current.withColumn("now", F.sha2("raw", 256))
    both = now.join(prior.withColumnRenamed("sha256", "was"), [*keys, "page"], "full")
    same = F.col("now").eqNullSafe(F.col("was"))
    status = F.when(same, "unchanged").when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("changed")
    return both.select(*keys, "page", F.col("now").alias("sha256"), F.when(~same, F.col("raw")).alias("raw"), status.alias("status"))


def history_errors(page_index: DataFrame, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(replica, checkpoint, error_code) of a history that is not whole.

    Every replica has just the named checkpoints, each at its place; a
    checkpoint's pages are 0 to its page count less one, each once; digests are
    64 lower-case hex digits.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("checkpoint")) for i, n in enumerate(names)])).alias("c")
    wanted = counts.select("replica").distinct().select("replica", listed).select("replica", "c.at", "c.checkpoint")
    pages = page_index.groupBy("replica", "checkpoint").agg(
        F.count(F.lit(1)).alias("n"), F.min("page").alias("low"), F.max("page").alias("high"), F.count_distinct("page").alias("kinds"), F.bool_and(F.col("sha256").rlike(r"^[0-9a-f]{64}\z")).alias("sound")
    )
    every = wanted.join(counts.select("replica", "checkpoint", "ordinal", "page_count"), ["replica", "checkpoint"], "full").join(pages, ["replica", "checkpoint"], "left")
    n = F.coalesce("n", F.lit(0))
    code = (
        F.when(F.col("ordinal").isNull(), "missing_checkpoint")
        .when(F.col("at").isNull(), "unknown_checkpoint")
        .when(F.col("ordinal") != F.col("at"), "wrong_ordinal")
        .when((n != F.col("page_count")) | (n > 0) & ((F.col("low") != 0) | (F.col("high") != n - 1) | (F.col("kinds") != n)), "pages_not_contiguous")
        .when(~F.col("sound"), "bad_digest")
    )
    return every.select("replica", "checkpoint", code.alias("error_code")).where("error_code is not null")


def hashes_at(page_index: DataFrame, names: Sequence[str]) -> DataFrame:
    """(replica, page) with a digest column for each named checkpoint: one shuffle, no blobs."""
    picked = [F.max(F.when(F.col("checkpoint") == n, F.col("sha256"))).alias(n) for n in names]
    return page_index.where(F.col("checkpoint").isin(*names)).groupBy("replica", "page").agg(*picked)


def idle_pairs_differ(page_index: DataFrame, pairs: Transitions) -> DataFrame:
    """(replica, before, after, page) where an idle pair is not equal: none means that the gate holds."""
    out = None
    for before, after in pairs:
        wide = hashes_at(page_index, (before, after))
        odd = wide.where(~F.col(f"`{before}`").eqNullSafe(F.col(f"`{after}`"))).select("replica", F.lit(before).alias("before"), F.lit(after).alias("after"), "page")
        out = odd if out is None else out.unionByName(odd)
    return out


def tracks_allocation(page_index: DataFrame, names: dict[str, str]) -> DataFrame:
    """(replica, page) that change, change back and change again with allocation.

    names: checkpoint of empty, grown, dropped, regrown, low_first, low_last,
    high_first, high_last.  Regrown equals grown, which differs from dropped and
    empty; low and high phases each end other than they began; a page missing
    from any of them does not qualify.
    """
    wide = hashes_at(page_index, list(dict.fromkeys(names.values())))
    h = {k: F.col(f"`{v}`") for k, v in names.items()}
    present = F.lit(True)
    for v in h.values():
        present = present & v.isNotNull()
    aba = (h["grown"] == h["regrown"]) & (h["grown"] != h["dropped"]) & (h["grown"] != h["empty"])
    return wide.where(present & aba & (h["low_first"] != h["low_last"]) & (h["high_first"] != h["high_last"])).select("replica", "page")


def qualify_global(page_index: DataFrame, empty: str = "E0", grown: str = "D_GROW_0128", dropped: str = "D_DROP") -> DataFrame:
    """(replica, page) whose digest changes on growth and again on release; a missing page counts as a value."""
    wide = hashes_at(page_index, (empty, grown, dropped))
    differs = lambda a, b: ~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return wide.where(differs(empty, grown) & differs(grown, dropped)).select("replica", "page")


def qualify_tdef(page_index: DataFrame, growth: Transitions, churn: Transitions, empty: str = "E0") -> DataFrame:
    """(replica, page) that exist at first, change in some growth transition and in every churn transition."""
    names = dict.fromkeys([empty, *[n for pair in [*growth, *churn] for n in pair]])
    wide = hashes_at(page_index, list(names))
    differs = lambda a, b: ~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    grows, churns = F.lit(False), F.lit(True)
    for a, b in growth:
        grows = grows | differs(a, b)
    for a, b in churn:
        churns = churns & differs(a, b)
    return wide.where(F.col(f"`{empty}`").isNotNull() & grows & churns).select("replica", "page")


def qualified_bound(pages: DataFrame, most: int) -> DataFrame:
    """(replica, n_pages, error_code): more qualified pages than allowed is a refusal."""
    return pages.groupBy("replica").agg(F.count(F.lit(1)).alias("n_pages")).withColumn("error_code", F.when(F.col("n_pages") > most, "resource_bound"))


def opened(page_index: DataFrame, blobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(replica, ordinal, checkpoint, page, raw) of chosen pages: the digest of each blob is tested, the blob joined late."""
    chosen = page_index.join(pages.select("replica", "page").distinct(), ["replica", "page"], "left_semi")
    sound = blobs.where(F.sha2("raw", 256) == F.col("sha256"))
    return chosen.join(sound, "sha256", "left").select("replica", "ordinal", "checkpoint", "page", "raw", F.when(F.col("raw").isNull(), "unreconstructable_snapshot").alias("error_code"))


def changed_bytes(history: DataFrame, pairs: Transitions) -> DataFrame:
    """(replica, page, off): bytes that some transition changes; equal pages are left out by comparison."""
    left = history.select("replica", "page", F.col("checkpoint").alias("before"), F.col("raw").alias("was"))
    right = history.select("replica", "page", F.col("checkpoint").alias("after"), F.col("raw").alias("now"))
    moved = left.join(_steps(history, pairs), "before").join(right, ["replica", "page", "after"]).where("was <> now")
    return moved.select("replica", "page", F.explode(differing(F.col("was"), F.col("now"))).alias("off")).distinct()


def record_interval(changed: DataFrame, least: int = 5) -> DataFrame:
    """(replica, page, start, end, error_code): from the first to the last changed byte; too short is ambiguous."""
    ends = changed.groupBy("replica", "page").agg(F.min("off").alias("start"), (F.max("off") + 1).alias("end"))
    return ends.withColumn("error_code", F.when(F.col("end") - F.col("start") < least, "ambiguous_record_boundary"))


def byte_history(history: DataFrame, intervals: DataFrame) -> DataFrame:
    """(replica, page, ordinal, off, v) of the bytes of each page's interval."""
    joined = history.join(intervals.select("replica", "page", "start", "end"), ["replica", "page"])
    return joined.select("replica", "page", "ordinal", "raw", F.explode(F.sequence("start", F.col("end") - 1)).alias("off")).select(
        "replica", "page", "ordinal", "off", byte(F.col("raw"), F.col("off")).alias("v")
    )


def change_points(table: DataFrame, *keys: str, low: int = 0, high: int = 1) -> DataFrame:
    """(keys, first): series that are all low before some ordinal and all high from it on."""
    per = table.groupBy(*keys).agg(
        F.bool_and(F.col("v").isin(low, high)).alias("known"),
        F.max(F.when(F.col("v") == low, F.col("ordinal"))).alias("last_low"),
        F.min(F.when(F.col("v") == high, F.col("ordinal"))).alias("first"),
    )
    return per.where("known and last_low is not null and first > last_low").select(*keys, "first")


def inline_boundaries(history: DataFrame, intervals: DataFrame, bitmap_start: Column) -> DataFrame:
    """(replica, page, boundary): where a bitmap may end, before a suffix that is zero at every checkpoint.

    history holds the checkpoints before conversion only.  A boundary follows a
    byte that is not zero at the last of them and nothing but zeros stand after
    it, up to the interval's end, at any of them.
    """
    table = byte_history(history, intervals)
    per = table.groupBy("replica", "page", "off").agg(F.max("v").alias("most"), F.max_by("v", "ordinal").alias("last_v"))
    after = Window.partitionBy("replica", "page").orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("rest", F.coalesce(F.max("most").over(after), F.lit(0)))
    placed = per.join(intervals.select("replica", "page", "start"), ["replica", "page"])
    return placed.where((F.col("last_v") != 0) & (F.col("rest") == 0) & (F.col("off") >= bitmap_start)).select("replica", "page", (F.col("off") + 1).alias("boundary"))


def explained_boundaries(history: DataFrame, counts: DataFrame, intervals: DataFrame, inline: Sequence[str], polarity: str) -> DataFrame:
    """(replica, page, boundary, status): ends of an inline bitmap that its own page counts explain.

    Up to the boundary the bitmap, at each inline checkpoint, says in use for all
    pages of the image from the record's first page on and for no others; at
    one of them it is full up to the boundary.  status is survives where all
    bytes from the boundary to the interval's end are zero at every checkpoint of
    history, suffix where some are not.
    """
    sized = history.join(counts.select("replica", "checkpoint", "page_count"), ["replica", "checkpoint"]).join(intervals.select("replica", "page", "start", "end"), ["replica", "page"])
    first = F.col("start") + 5
    bits = F.greatest(F.col("page_count").cast("long") - read_uint(F.col("raw"), F.col("start") + 1, 4), F.lit(0).cast("long"))
    sized = sized.withColumn("bits", bits).withColumn("inline", F.col("checkpoint").isin(*inline))
    cells = sized.select("replica", "page", "start", "end", "bits", "inline", "raw", F.explode(F.sequence(F.col("start") + 4, F.col("end") - 1)).alias("off")).withColumn("v", byte(F.col("raw"), F.col("off")))
    left = F.least(F.greatest(F.col("bits") - (F.col("off") - first) * 8, F.lit(0).cast("long")), F.lit(8).cast("long")).cast("int")
    wanted = F.call_function("shiftleft", F.lit(1), left) - 1
    wanted = wanted.bitwiseXOR(255) if polarity == POLARITIES[1] else wanted
    per = cells.groupBy("replica", "page", "start", "off").agg(
        F.max(F.when(F.col("inline") & (F.col("off") >= first) & (F.col("v") != wanted), 1).otherwise(0)).alias("wrong"), F.max(F.when(F.col("v") != 0, 1).otherwise(0)).alias("used")
    )
    order = Window.partitionBy("replica", "page").orderBy("off")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    per = per.withColumns({"n_wrong": F.sum("wrong").over(upto), "n_used": F.coalesce(F.sum("used").over(after), F.lit(0))})
    full = sized.where("inline").select("replica", "page", F.col("bits").alias("capacity")).distinct()
    found = per.where("n_wrong = 0").withColumn("capacity", ((F.col("off") - F.col("start") - 4) * 8).cast("long")).join(full, ["replica", "page", "capacity"], "left_semi")
    return found.select("replica", "page", (F.col("off") + 1).alias("boundary"), F.when(F.col("n_used") == 0, "survives").otherwise("suffix").alias("status"))


def pointer_windows(history: DataFrame, counts: DataFrame, intervals: DataFrame, growth: Transitions, churn: Transitions, *, outside: Transitions = (), returns: tuple[str, str, str] | None = None) -> DataFrame:
    """(replica, page, off, layout, role): four-byte windows that point into the image at every checkpoint.

    role is used if some growth transition changes the window and no churn
    transition does, free the other way round.  No transition outside those may
    change either.  Where returns names three checkpoints, a free window differs
    between the first two and is at the third what it was at the first.
    """
    joined = history.join(counts.select("replica", "ordinal", "page_count"), ["replica", "ordinal"]).join(intervals.select("replica", "page", "start", "end"), ["replica", "page"])
    windows = joined.where(F.col("end") - F.col("start") >= 4).select(
        "replica", "page", "checkpoint", "page_count", "raw", F.explode(F.sequence("start", F.col("end") - 4)).alias("off")
    )
    windows = windows.withColumn("w", chunk(F.col("raw"), F.col("off"), 4)).drop("raw")
    layouts = F.explode(F.array(*[F.struct(F.lit(n).alias("layout"), pointer(F.col("w"), n)["page"].alias("at")) for n in POINTER_LAYOUTS])).alias("p")
    rows = windows.select("replica", "page", "checkpoint", "page_count", "off", "w", layouts).select("*", "p.layout", "p.at").drop("p")
    at = lambda n: F.max(F.when(F.col("checkpoint") == n, F.col("w")))
    moves = lambda pairs: F.greatest(F.lit(False), F.lit(False), *[F.coalesce(at(a) != at(b), F.lit(False)) for a, b in pairs])
    back = F.coalesce((at(returns[0]) != at(returns[1])) & (at(returns[0]) == at(returns[2])), F.lit(False)) if returns else F.lit(True)
    inside = F.bool_and((F.col("at") >= 1) & (F.col("at") < F.col("page_count")))
    per = rows.groupBy("replica", "page", "off", "layout").agg(inside.alias("inside"), moves(growth).alias("grows"), moves(churn).alias("churns"), moves(outside).alias("strays"), back.alias("back"))
    role = F.when(F.col("grows") & ~F.col("churns"), "used").when(F.col("churns") & F.col("back") & ~F.col("grows"), "free")
    return per.where("inside and not strays").withColumn("role", role).where("role is not null").select("replica", "page", "off", "layout", "role")


def slot_references(history: DataFrame, record_start: int, record_end: int) -> DataFrame:
    """(replica, ordinal, slot, ref) of the non-zero references of an indirect record on each page of history."""
    return history.select("replica", "ordinal", "checkpoint", F.explode(active_slots(F.col("raw"), record_start, record_end)).alias("s")).select("replica", "ordinal", "checkpoint", F.col("s.slot").alias("slot"), F.col("s.page").alias("ref"))


def reference_edges(slots: DataFrame, every_page: DataFrame, counts: DataFrame) -> DataFrame:
    """slots with the page they lead to and error_code: out of range, or not an extended bitmap page."""
    target = every_page.select("replica", "checkpoint", F.col("page").alias("ref"), "raw")
    joined = slots.join(target, ["replica", "checkpoint", "ref"], "left").join(counts.select("replica", "checkpoint", "page_count"), ["replica", "checkpoint"])
    code = F.when((F.col("ref") < 1) | (F.col("ref") >= F.col("page_count")), "reference_out_of_range").when(F.coalesce(byte(F.col("raw"), 0), F.lit(-1)) != 5, "not_an_extended_bitmap")
    return joined.withColumn("error_code", code)


def predicted_pages(edges: DataFrame) -> DataFrame:
    """(replica, checkpoint, ordinal, formula, page) that the set bits of extended bitmaps stand for under each formula."""
    bits = edges.where("error_code is null").select("replica", "checkpoint", "ordinal", "slot", "ref", F.explode(set_bits(F.col("raw"), skip=EXTENDED_HEADER)).alias("bit"))
    formulas = F.explode(F.array(*map(F.lit, BASE_FORMULAS))).alias("formula")
    return bits.select("*", formulas).select("replica", "checkpoint", "ordinal", "formula", (extended_base(F.col("formula"), F.col("slot"), F.col("ref")) + F.col("bit")).alias("page"))


def _steps(df: DataFrame, pairs: Transitions) -> DataFrame:
    """The transitions as a table (before, after); the caller's list bounds it."""
    table = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in pairs])
    return F.broadcast(df.sparkSession.range(1).select(F.explode(table).alias("s")).select("s.*"))


def strict_formulas(edges: DataFrame, counts: DataFrame, growth: Transitions) -> DataFrame:
    """(replica, formula) whose newly set bits stand for just the appended pages, in every growth transition.

    A bit is new if its slot had it not before the transition; the pages of the
    new bits and the appended pages must be the same set, none where none was
    appended.
    """
    bits = edges.where("error_code is null").select("replica", "checkpoint", "slot", "ref", F.explode(set_bits(F.col("raw"), skip=EXTENDED_HEADER)).alias("bit"))
    steps = _steps(edges, growth)
    now = bits.withColumnRenamed("checkpoint", "after").join(steps, "after")
    was = bits.select("replica", F.col("checkpoint").alias("before"), "slot", "bit")
    formulas = F.explode(F.array(*map(F.lit, BASE_FORMULAS))).alias("formula")
    fresh = now.join(was, ["replica", "before", "slot", "bit"], "left_anti").select("*", formulas)
    fresh = fresh.select("replica", "before", "after", "formula", (extended_base(F.col("formula"), F.col("slot"), F.col("ref")) + F.col("bit")).alias("page"))
    per = fresh.groupBy("replica", "before", "after", "formula").agg(F.count_distinct("page").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"))
    sizes = counts.select("replica", "checkpoint", "page_count")
    spans = steps.join(sizes.toDF("replica", "before", "n_before"), "before").join(sizes.toDF("replica", "after", "n_after"), ["replica", "after"]).select("*", formulas)
    both = spans.join(per, ["replica", "before", "after", "formula"], "left")
    grown = F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0))
    n = F.coalesce("n", F.lit(0))
    exact = (n == grown) & ((n == 0) | ((F.col("low") >= F.col("n_before")) & (F.col("high") < F.col("n_after"))))
    return both.groupBy("replica", "formula").agg(F.bool_and(exact).alias("exact")).where("exact").select("replica", "formula")


def covering_formulas(predicted: DataFrame, inline_pages: DataFrame, conversion: str) -> DataFrame:
    """(replica, formula) whose pages at the conversion take in all pages (replica, page) of the inline record before it."""
    formulas = F.explode(F.array(*map(F.lit, BASE_FORMULAS))).alias("formula")
    wanted = inline_pages.select("replica", "page").distinct().select("replica", "page", formulas)
    missing = wanted.join(predicted.where(F.col("checkpoint") == conversion).select("replica", "formula", "page"), ["replica", "formula", "page"], "left_anti").select("replica", "formula").distinct()
    every = predicted.select("replica").unionByName(inline_pages.select("replica")).distinct().select("replica", formulas)
    return every.join(missing, ["replica", "formula"], "left_anti")


def surviving_formulas(predicted: DataFrame, counts: DataFrame, growth: Transitions) -> DataFrame:
    """(replica, formula) whose newly set pages are just the appended ones in each growth transition.

    Where as many bits are new as pages were appended the two sets must be
    equal; elsewhere every new page must lie inside the image.
    """
    steps = _steps(predicted, growth)
    sizes = counts.select("replica", "checkpoint", "page_count")
    spans = steps.join(sizes.toDF("replica", "before", "n_before"), "before").join(sizes.toDF("replica", "after", "n_after"), ["replica", "after"])
    now = predicted.withColumnRenamed("checkpoint", "after").join(spans, ["replica", "after"])
    was = predicted.select("replica", F.col("checkpoint").alias("before"), "formula", "page")
    fresh = now.join(was, ["replica", "before", "formula", "page"], "left_anti")
    per = fresh.groupBy("replica", "before", "after", "n_before", "n_after", "formula").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("page") >= F.col("n_before")) & (F.col("page") < F.col("n_after"))).alias("appended"),
        F.bool_and((F.col("page") >= 0) & (F.col("page") < F.col("n_after"))).alias("inside"),
        F.count_distinct("page").alias("n_pages"),
    )
    grown = F.col("n_after") - F.col("n_before")
    exact = (grown > 0) & (F.col("n") == grown)
    failed = per.where(~F.when(exact, F.col("appended") & (F.col("n_pages") == grown)).otherwise(F.col("inside"))).select("replica", "formula").distinct()
    every = predicted.select("replica", "formula").distinct()
    return every.join(failed, ["replica", "formula"], "left_anti")


def d_flags(empty: Column, grown: Column, dropped: Column, regrown: Column, polarity: str, recreated: Column | None = None) -> dict[str, Column]:
    """What one byte says at four checkpoints: growth, bits not released, bits not taken again, further bits; at a fifth, bits not released then."""
    if polarity == POLARITIES[1]:
        empty, grown, dropped, regrown = (c.bitwiseXOR(255) for c in (empty, grown, dropped, regrown))
        recreated = None if recreated is None else recreated.bitwiseXOR(255)
    gained = grown.bitwiseAND(empty.bitwiseXOR(255))
    return ({} if recreated is None else {"recreate_violation": gained.bitwiseAND(recreated) != 0}) | {
        "growth": gained != 0,
        "release_violation": gained.bitwiseAND(dropped) != 0,
        "regrowth_violation": gained.bitwiseAND(regrown.bitwiseXOR(255)) != 0,
        "additional": regrown.bitwiseAND(grown.bitwiseXOR(255)) != 0,
    }


def prefix_sums(table: DataFrame, flags: Sequence[str], *keys: str, keep: Sequence[str] = ()) -> DataFrame:
    """Running counts of flags by offset: an interval's count is a difference of two.

    A row is a byte with booleans, or a strip of bytes with their counts; columns to keep go along.
    """
    upto = Window.partitionBy(*keys).orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.select(*keys, "off", *keep, *[F.sum(F.col(f).cast("long")).over(upto).alias(f"{f}_upto") for f in flags])


def last_changed(table: DataFrame, *keys: str) -> DataFrame:
    """last_from: the page's highest changed offset where it is not below the row's, else -1; suffix_start follows it."""
    top = F.max(F.when(F.col("changed"), F.col("off"))).over(Window.partitionBy(*keys))
    return table.withColumn("last_from", F.when(top >= F.col("off"), top).otherwise(-1)).withColumn("suffix_start", F.when(F.col("last_from") >= 0, F.col("last_from") + 1))


def suffix_slack(table: DataFrame, page_size: Column | int, *keys: str) -> DataFrame:
    """(keys, slack): bytes after the last changed one, 0 if some of them is not unused (unused: boolean by row).

    Of each strip of a page only its last changed and its last used byte need be rows; page_size may be an aggregate.
    """
    marked = last_changed(table, *keys)
    top = F.max(F.when(F.col("changed"), F.col("off"))).over(Window.partitionBy(*keys))
    return marked.withColumn("top", top).groupBy(*keys).agg(
        F.when(F.max("top").isNull() | F.coalesce(F.bool_or((F.col("off") > F.col("top")) & ~F.col("unused")), F.lit(False)), 0).otherwise(page_size - 1 - F.max("top")).alias("slack")
    )


def interval_count(length: Column) -> Column:
    """How many half-open intervals, none of them empty, lie in so many bytes."""
    n = length.cast("long")
    return F.call_function("shiftright", n * (n + 1), F.lit(1))


def in_use_pages(record: Column, polarity: str) -> Column:
    """Pages that an inline record says are in use: set bits, or clear ones, after its start page."""
    base = read_uint(record, 1, 4)
    return F.transform(set_bits(record, clear=polarity == POLARITIES[1], skip=5), lambda b: base + b)


def record_relations(history: DataFrame, names: tuple[str, str, str, str], page_size: int = PAGE_SIZE, *, recreated: str | None = None) -> DataFrame:
    """(replica, page, start, polarity, slack) of the record starts whose bitmap behaves as an allocation map's.

    The byte at the start is 0 and the four after it are the same at all four
    checkpoints; in the bitmap after them some bit is taken on growth, all those
    are released on drop and taken again on regrowth, and more are taken then.
    Predicates over the rest of a page are differences of prefix sums.  With a
    fifth checkpoint, recreated, the taken bits must be released there too and
    the first bytes be the same there.
    """
    empty, grown, dropped, regrown = names
    names = (*names, recreated) if recreated else names
    one = lambda n: F.max(F.when(F.col("checkpoint") == n, F.col("raw"))).alias(n)
    wide = history.groupBy("replica", "page").agg(*[one(n) for n in names])
    at = {n: byte(F.col(f"`{n}`"), F.col("off")) for n in names}
    rows = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(page_size - 1))).alias("off")).select("replica", "page", "off", *[v.alias(n) for n, v in at.items()])
    vs = {n: F.col(f"`{n}`") for n in names}
    out = None
    for polarity in POLARITIES:
        flags = d_flags(vs[empty], vs[grown], vs[dropped], vs[regrown], polarity, vs[recreated] if recreated else None)
        unused = 0 if polarity == POLARITIES[0] else 255
        same = reduce(lambda a, b: a & b, [vs[empty] == vs[n] for n in names[1:]])
        table = rows.select("replica", "page", "off", (same & (vs[empty] == 0)).alias("zero"), same.alias("same"), (~same).alias("changed"), (~(same & (vs[empty] == unused))).alias("bad"), *[v.alias(k) for k, v in flags.items()])
        order = Window.partitionBy("replica", "page").orderBy("off")
        after = order.rowsBetween(5, Window.unboundedFollowing)
        total = lambda flag: F.sum(F.col(flag).cast("long")).over(after)  # noqa: E731, B023
        fixed = F.min(F.col("same").cast("int")).over(order.rowsBetween(1, 4)) == 1
        whole = Window.partitionBy("replica", "page")
        top = F.max(F.when(F.col("changed"), F.col("off"))).over(whole)
        last_bad = F.max(F.when(F.col("bad") & (F.col("off") > F.col("top")), F.col("off"))).over(whole)
        table = table.withColumn("top", top)
        table = table.withColumns({"last_bad": last_bad, "fixed": fixed, **{f"n_{f}": total(f) for f in flags}})
        holds = F.col("zero") & F.col("fixed") & (F.col("off") + 5 < page_size) & (F.col("n_growth") > 0) & (F.col("n_release_violation") == 0) & (F.col("n_regrowth_violation") == 0) & (F.col("n_additional") > 0)
        if recreated:
            holds &= F.col("n_recreate_violation") == 0
        slack = F.when((F.col("top") < F.col("off") + 5) | F.col("last_bad").isNotNull(), 0).otherwise(page_size - 1 - F.col("top"))
        found = table.where(holds).select("replica", "page", F.col("off").alias("start"), F.lit(polarity).alias("polarity"), slack.alias("slack"))
        out = found if out is None else out.unionByName(found)
    return out


def at_highwater(found: DataFrame, history: DataFrame, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Of record_relations() those whose bitmap says, at each named checkpoint, in use up to the last page and not beyond.

    The record's first page lies below the page count, all pages from it on are
    in use and the page after the last is not.  Bits are compared as bytes: whole
    ones as hex text, the rest of the last by a mask.
    """
    named = F.col("checkpoint").isin(*names)
    ends = counts.where(named).select("replica", "checkpoint", F.col("page_count").cast("long").alias("end"))
    rows = found.join(history.where(named).select("replica", "page", "checkpoint", "raw"), ["replica", "page"]).join(ends, ["replica", "checkpoint"], "left")
    n = F.col("end") - read_uint(F.col("raw"), F.col("start") + 1, 4)
    inverse = F.col("polarity") == POLARITIES[1]
    whole, rest = F.floor(n / 8).cast("int"), (n % 8).cast("int")
    first = F.col("start") + 5
    full = F.substr(F.hex("raw"), 2 * first + 1, 2 * whole) == F.repeat(F.when(inverse, "00").otherwise("FF"), whole)
    last = byte(F.col("raw"), first + whole)
    last = F.when(inverse, last.bitwiseXOR(255)).otherwise(last)
    low = F.call_function("shiftleft", F.lit(1), rest)
    edge = F.coalesce(last.bitwiseAND(low * 2 - 1) == low - 1, rest == 0)
    fits = F.coalesce((n > 0) & full & edge, F.lit(False))
    keys = [c for c in found.columns]
    good = rows.groupBy(*keys).agg(F.bool_and(fits).alias("fits"), F.count_distinct("checkpoint").alias("n")).where(F.col("fits") & (F.col("n") == len(set(names))))
    return good.select(*keys)


def polarity_conflicts(predicted: DataFrame, inline: DataFrame) -> DataFrame:
    """Rows (replica, checkpoint, page) that one side calls in use and the other does not."""
    a, b = predicted.select("replica", "checkpoint", "page").distinct(), inline.select("replica", "checkpoint", "page").distinct()
    keys = ["replica", "checkpoint", "page"]
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("predicted_only")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("inline_only")))


def layer_outcome(survivors: DataFrame, replicas: DataFrame, *keys: str) -> DataFrame:
    """(replica, n_models, outcome) for every replica: none, one or many survivors."""
    per = survivors.groupBy("replica").agg(F.count_distinct(F.struct(*keys)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    outcome = F.when(n == 0, "no_surviving_model").when(n == 1, "one_model").otherwise("ambiguous_model")
    return replicas.select("replica").distinct().join(per, "replica", "left").select("replica", n.alias("n_models"), outcome.alias("outcome"))


def replicas_agree(survivors: DataFrame, n_replicas: int, *keys: str) -> DataFrame:
    """Models that every replica keeps."""
    return survivors.select("replica", *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_replicas).select(*keys)


def joint_models(pointers: DataFrame, formulas: DataFrame, n_replicas: int, ceiling: int) -> DataFrame:
    """One row (examined, survivors, error_code) of the models that all derivation replicas keep.

    Used times free offsets of each layout, times all formulas, are examined; a
    pair of one and the same offset is no model, and only the formulas that all
    replicas keep count.  More examined than the ceiling is a refusal.
    """
    kept = replicas_agree(pointers, n_replicas, "layout", "role", "off")
    is_role = lambda r: F.bool_or(F.col("role") == r).cast("long")
    per = kept.groupBy("layout", "off").agg(is_role("used").alias("used"), is_role("free").alias("free"))
    per = per.groupBy("layout").agg(F.sum("used").alias("used"), F.sum("free").alias("free"), F.sum(F.col("used") * F.col("free")).alias("both"))
    none = F.lit(0).cast("long")
    pairs = per.agg(F.coalesce(F.sum(F.col("used") * F.col("free")), none).alias("pairs"), F.coalesce(F.sum(F.col("used") * F.col("free") - F.col("both")), none).alias("apart"))
    bases = replicas_agree(formulas, n_replicas, "formula").agg(F.count(F.lit(1)).alias("n"))
    examined = F.col("pairs") * len(BASE_FORMULAS)
    return pairs.join(bases).select(
        examined.alias("examined"), F.when(examined <= ceiling, F.col("apart") * F.col("n")).alias("survivors"), F.when(examined > ceiling, "resource_bound").alias("error_code")
    )


def model_count(pointers: DataFrame, formulas: DataFrame) -> DataFrame:
    """(replica, n_models): used offsets times free offsets of each layout, times formulas."""
    per = pointers.groupBy("replica", "layout").agg(F.count_if(F.col("role") == "used").alias("used"), F.count_if(F.col("role") == "free").alias("free"))
    pairs = per.groupBy("replica").agg(F.sum(F.col("used") * F.col("free")).alias("pairs"))
    return pairs.join(formulas.groupBy("replica").agg(F.count(F.lit(1)).alias("n")), "replica").select("replica", (F.col("pairs") * F.col("n")).alias("n_models"))


def freeze(survivors: DataFrame, path: str) -> str:
    """Write the surviving models once (a second write is refused) and return their digest."""
    survivors.write.mode("errorifexists").parquet(path)
    return frozen_digest(survivors.sparkSession.read.parquet(path))


def frozen_digest(models: DataFrame) -> str:
    """Digest of the models as a set: independent of files and order."""
    rows = models.select(F.sha2(F.to_json(F.struct(*sorted(models.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d")).first().d


def holdout(path: str, digest: str, derived: DataFrame, *keys: str) -> DataFrame:
    """Frozen models with whether the held-out replica's own derivation has them.

    The frozen table is read, and its digest compared, before anything of the
    held-out replica is: a barrier, not a lazy plan.  Models are few (a layer
    refuses more than its bound), so their digest may be taken in one place.
    """
    spark = derived.sparkSession
    frozen = spark.read.parquet(path)
    if frozen_digest(frozen) != digest:
        raise ValueError("frozen models changed")
    mark = derived.select(*keys).distinct().withColumn("held", F.lit(True))
    return frozen.join(mark, list(keys), "left").withColumn("held", F.coalesce("held", F.lit(False)))
