"""A corpus pipeline over documents: classify, drop exact and near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents, extra ones too, whatever their names; the last returns the packed pieces.
No stage fails on an empty table: it returns no rows. Texts are taken whole at any length, and a null text counts as empty.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from symloom.llm import exact_dedup, jaccard, mixing, packing, quality_lm
from symloom.llm.common import fresh_path, recorded, remove

#: Tables that the stage before wrote on its way: its result is written by the time the next one starts, so they can go.
_on_the_way: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _on_the_way)
        with recorded(_on_the_way):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity under a model of trusted text is too high for their language.

    Empty and null texts, null ids and null languages are judged like others; repeated rows fare alike, and rows of one id each by their own text.
    """
    return quality_lm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts stays: the longest, then that of least id, null ids last; of a repeated row, one. Empty and null texts are one group."""
    return exact_dedup.drop_exact_duplicates(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least id. Texts without words and rows with a null id stay; so do all rows of the id that stays."""
    return jaccard.drop_near_duplicates(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: a document appears as often as the mix takes it. A null source is one of its own; repeated rows and null ids are documents of their own."""
    return mixing.mixed_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and their places in sequences. An empty text has one piece, its end; repeated rows each have places."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
#: The model and the tokenizer aren't SQL; tests/llm/test_pipeline_stages.py holds each stage against a plain-Python version, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
