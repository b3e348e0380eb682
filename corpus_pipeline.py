"""Pipeline over ``documents``: toxicity, line dedup, near dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; run() writes each stage's rows to the shared folder and reads them again.
All stages but the last return the columns of ``documents``.

Nulls and odd inputs: a null or empty text is not toxic, loses no line, has no
near copy and no word, so the mix never takes it; rows without an id pass the
dedup stages unchanged; rows that repeat an id are one document for the dedup
stages (near dedup keeps or drops all of them) and rows of their own elsewhere;
texts that lost lines get a new ``n_chars``; an empty table gives no rows; columns
beyond those that a stage reads, whatever their names, travel in one struct and
come back as they were.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import linededup, mixing, neardup, sentencepiece_bpe, toxicity
from pagewright.llm.common import spread, stored
from pagewright.llm.queries import TOKENIZER, table


#: The columns that a stage's operator doesn't read.
REST = "pipeline_rest"


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """docs with the columns of these names, and all others in one struct: no operator's column can clash with them."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]
    return docs.select(*own, F.struct(*rest or [F.lit(0)]).alias(REST))


def unpacked(rows: DataFrame, like: DataFrame, *own: str, **new: Column) -> DataFrame:
    """packed() of ``like`` undone, some of its own columns replaced."""
    column = lambda i, c: new[c] if c in new else F.col(c) if c in own else F.col(f"{REST}.c{i}")
    return rows.select(*[column(i, c).alias(c) for i, c in enumerate(like.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(packed(docs, "doc_id", "text"), model, threshold=0.7)
    return unpacked(scored.where("toxic_predicted = 0"), docs, "doc_id", "text")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more code points that 3 or more documents share stay in the last one only."""
    done = linededup.dedup_lines(packed(docs, "doc_id", "text", "n_chars"))
    changed = F.col("line_dropped") > 0
    new = {"text": F.when(changed, F.col("line_kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length("line_kept").cast("long")).otherwise(F.col("n_chars"))}
    return unpacked(done, docs, "doc_id", **new)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word similarity 0.8 or more, the document with the smallest id stays."""
    found = neardup.near_duplicates(docs, words=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 1, 2, 3 in turn, at most 3 epochs; a document stands as often as the mix takes it."""
    own = packed(docs, "doc_id", "source", "text")
    return unpacked(mixing.repeated(mixing.mix(own), own.columns), docs, "doc_id", "source", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row."""
    return sentencepiece_bpe.encode(docs.select("doc_id", "text"), sentencepiece_bpe.read_model(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity, near dedup and encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stage(spark, spread(rows), sf_dir)
        if stage is not STAGES[-1][1]:
            rows = stored(rows, f"pipeline-{name}")
    return rows
