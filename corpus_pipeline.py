"""A training-corpus pipeline over ``documents``: each stage calls one corpus
operator, and its result is written as Parquet and read again by the next.

Defined results of every stage: null text counts as empty and fails the quality rules; null
language or source is a group of its own; texts of any length are read whole; of repeated rows one
stays after near dedup, and ties go to the smaller id; an empty table stays empty; columns
beside those of ``documents`` are carried, and the last stage's ``token_ids`` and ``n_tokens``
take the place of input columns of these names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetlens.llm import bpe, mix, nearjoin, quality, sitelines
from packetlens.llm.common import materialise, prepare, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or an adaptive limit rejects go."""
    prepare(spark)
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fill too many of a source's documents go from all of them."""
    prepare(spark)
    return sitelines.cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    prepare(spark)
    return nearjoin.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes, in training order."""
    prepare(spark)
    return mix.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the documents' columns."""
    prepare(spark)
    return bpe.encoded_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages Parquet in the shared folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The token ids of the last stage can't be computed in SQL.
ORACLE_SQL = None
