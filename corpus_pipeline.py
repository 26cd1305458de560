"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet and read again: toxic documents go,
one document of each near-duplicate class stays, sources are mixed to their target weights by
repeating or leaving out documents, and the result is packed into sequences.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm import mixing, packing, shingle_near, toxicity
from tallyscope.llm.common import drop_kept, keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the toxicity threshold, by a model fitted on ``labels``."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id.

    Candidates are op5's SimHash classes and MinHash bands; a link is a similarity of five-word shingles of 0.8 or more.
    """
    return shingle_near.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens with their sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: No SQL: a trained model and packing decide the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_kept(*written)
        written = [docs]
    return docs
