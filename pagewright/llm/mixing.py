"""Mixing sources to target weights by capped water-filling.

A source's target starts as its weight's share of the words asked for.  Sources
whose target would exceed ``epochs`` passes over their own words are clamped
there and the excess goes to the others by weight, until none is above.  The
fixpoint is found in closed form: with the sources ordered by capacity over
weight, the clamped ones are a prefix of that order.

A target is met by whole repetitions of every document and one more repetition
of a seeded random part of the source.  That part is a prefix of the documents
in hash order, cut where its words reach the remainder, so that a source's words
differ from its target by at most half a document.  The cut is found without a
window over a whole source: words are first summed by hash slice, and only the
documents of the one slice that holds the cut are put in order.

Nulls and odd inputs: a null source is a source of its own, last in order; a
null or empty text has no words, gets the repetitions of its place in hash order
and contributes 0 words; a null id hashes as the empty string; equal rows are
interchangeable; a source without words has target 0; an empty table gives no
rows.  Columns of the input stay as they are; the operator's own begin with
``mix_`` and replace columns of the input that begin so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Hash slices of a source; only one slice's documents are ever sorted.
SLICE_HEX = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Add mix_target to a table (mix_key, mix_weight, mix_source_size) of sources.

    One row for each source: small beside the documents, whatever their number.
    """
    every = Window.partitionBy()
    filled = (
        sources.withColumn("cap", F.col("mix_source_size") * F.lit(float(epochs)))
        .withColumn("wanted", F.sum("mix_source_size").over(every) * F.lit(float(share)))
        .withColumn("order", F.col("mix_source_size") / F.col("mix_weight"))
    )
    upto = Window.orderBy("order", "mix_key").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("order", "mix_key").rowsBetween(0, Window.unboundedFollowing)
    filled = (
        filled.withColumn("spent", F.coalesce(F.sum("mix_source_size").over(upto), F.lit(0)) * F.lit(float(epochs)))
        .withColumn("left", F.sum("mix_weight").over(rest))
        .withColumn("full", F.col("cap") * F.col("left") <= (F.col("wanted") - F.col("spent")) * F.col("mix_weight"))
    )
    # the first source that is not full fixes the level of all that follow
    after = Window.orderBy("order", "mix_key").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(~F.col("full"), F.struct("order", "mix_key", "wanted", "spent", "left"))).over(after)
    target = F.when(first.isNull(), F.col("cap")).otherwise((first["wanted"] - first["spent"]) * F.col("mix_weight") / first["left"])
    return filled.withColumn("mix_target", target).select(*sources.columns, "mix_target")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    epochs: int = 3,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target and mix_reps (0 or more repetitions).

    Sources in code-point order, null last, weigh ``weights`` in turn.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    marked = docs.withColumns({"mix_key": key, "mix_size": n_words(F.col(text)), "mix_hash": F.substring(digest, 1, 16)})
    marked = marked.withColumn("mix_slice", F.substring("mix_hash", 1, SLICE_HEX))

    slices = stored(marked.groupBy("mix_key", "mix_slice").agg(F.sum("mix_size").alias("words")), "mix-slices")
    sources = slices.groupBy("mix_key").agg(F.sum("words").alias("mix_source_size"))
    turn = F.row_number().over(Window.orderBy("mix_key")) - 1
    sources = sources.withColumn("mix_weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    sources = water_fill(sources, share, epochs)
    whole = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("mix_whole", whole).withColumn("mix_extra", F.col("mix_target") - F.col("mix_whole") * F.col("mix_source_size"))

    before = Window.partitionBy("mix_key").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = slices.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # the cut lies in the last slice that starts below the remainder
    cut = (
        start.join(sources.select("mix_key", "mix_extra"), "mix_key")
        .where(F.col("start") < F.col("mix_extra"))
        .groupBy("mix_key")
        .agg(F.max(F.struct("mix_slice", "start")).alias("c"))
        .select("mix_key", F.col("c.mix_slice").alias("mix_cut"), F.col("c.start").alias("mix_start"))
    )
    plan = stored(sources.join(cut, "mix_key", "left"), "mix-plan")

    joined = marked.join(plan, "mix_key")
    in_cut = F.col("mix_slice").eqNullSafe(F.col("mix_cut"))
    clear = joined.where(~in_cut).withColumn("mix_more", F.coalesce(F.col("mix_slice") < F.col("mix_cut"), F.lit(False)))
    order = Window.partitionBy("mix_key").orderBy("mix_hash", doc_id, "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("mix_start") + F.coalesce(F.sum("mix_size").over(order), F.lit(0))
    close = joined.where(in_cut).withColumn("mix_more", at * 2 + F.col("mix_size") < F.col("mix_extra") * 2)
    both = clear.unionByName(close)
    reps = F.col("mix_whole") + F.col("mix_more").cast("long")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size", "mix_source_size", "mix_target", reps.alias("mix_reps"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as mix_reps says, without the operator's columns."""
    times = mixed.where("mix_reps > 0").withColumn("mix_nth", F.explode(F.expr("sequence(1L, mix_reps)")))
    return times.select(*[F.col(f"`{c}`") for c in columns])
