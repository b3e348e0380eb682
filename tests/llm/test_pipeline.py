"""The pipeline's stages on nulls, repeated rows, empty tables and clashing names, and run() against its stages."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import queries as own
from pagewright.llm.common import stored

CLASH = ("line_number", "mix_origin", "toxic_score", "line_kept", "pipeline_rest", "id", "a.b", "bucket")


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """The table with null and empty rows, repeated ids, and columns named like the operators'."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame(
        [(None, "text without an id", "en", "s", 3), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "x y z " * 9, None, "s", None), (9003, "x y z " * 9, None, "s", None), (9004, "word " * 40_000, "en", "s", 1)],
        docs.schema,
    )
    docs = docs.unionByName(more)
    for at, name in enumerate(CLASH):
        docs = docs.withColumn(name, F.concat(F.lit(f"{at}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


@pytest.fixture(scope="module")
def stages(spark, odd, sf_dir):
    """Each stage's input and output."""
    found, rows = {}, odd
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, rows, sf_dir), "test-stage")
        found[name], rows = (rows, after), after
    return found


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_come_back_as_they_were(stages, name):
    before, after = stages[name]
    assert after.columns == before.columns
    for at, c in enumerate(CLASH):
        assert after.where(F.col(f"`{c}`") != F.concat(F.lit(f"{at}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).count() == 0


def test_odd_rows(stages):
    ids = lambda name: [r.doc_id for r in stages[name][1].select("doc_id").collect()]
    for name in ("toxicity", "line_dedup", "near_dedup"):
        assert {None, 9001, 9002, 9003, 9004} <= set(ids(name))
    assert ids("line_dedup").count(9003) == 2
    assert not {9001, 9002} & set(ids("mixing"))  # without words
    lost = stages["line_dedup"][1].where("n_chars <> char_length(text) and doc_id < 9000")
    assert lost.count() == stages["line_dedup"][0].where("n_chars <> char_length(text) and doc_id < 9000").count()


def test_the_last_stage_is_the_library(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(own.TOKENIZER))
    before, after = stages["sentencepiece"]
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(map(str, lib.encode(r.text or ""))).encode()).hexdigest()) for r in before.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.ids_sha256) for r in after.collect()) == want


def test_an_empty_table_gives_no_rows(spark, odd, sf_dir):
    rows = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, sf_dir), "test-empty")
    assert rows.count() == 0


def test_run_gives_what_the_stages_give(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, sf_dir), "test-run")
    got = corpus_pipeline.run(spark, sf_dir)
    order = lambda df: sorted(map(str, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert order(got) == order(rows)
    assert got.where("n_tokens <> size(ids)").count() == 0
