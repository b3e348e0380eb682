"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, langid, linededup, media, mixing, neardup, quality, sentencepiece_bpe, toxicity, warc
from .common import held_out, scratch, spread, stored

#: The tokenizer of op2 and of the pipeline.
TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 in turn, all words, at most 3 epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, weights=(1, 2, 3), share=1.0, epochs=3)
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_reps")).alias("taken"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.read_model(public_tokenizers.path(TOKENIZER))
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), model, ids=False)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are stored in a binary column, and features come from what is read back."""
    files = stored(media.encode_media(table(spark, sf_dir, "documents")), "media", codec="uncompressed")
    return media.media_features(files)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, threshold=0.7)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    read = warc.read_archive(spark, folder)
    block = F.when(F.col("record_type") == "revisit", 0).otherwise(F.octet_length("payload"))
    whole = F.octet_length("record") == F.octet_length("header") + block + 4
    n_bytes = F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("record bytes")).cast("long"))
    return read.select("page_id", n_bytes.alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as this query's contract has it."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup_lines(docs, min_chars=20, min_docs=3)
    kept = F.sha2(F.col("line_kept").cast("binary"), 256)
    return done.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.extract_pages(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sentencepiece, op3_media, op4_toxicity, op5_quality, op6_warc, op7_neardup, op8_langid, op9_linededup, op10_extract)}
