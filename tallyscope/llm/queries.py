"""One query per corpus operator over its whole table, and SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm import (hidden_markov, jpeg_media, licence_scan, mixing, neighbour_graph, packing, periodic_runs,
                            prefix_trie, quartile_digest, simhash_near, site_style, token_counts, toxicity)
from tallyscope.llm.common import table


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.scored_texts(table(spark, sf_dir, "documents"))


def op2_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, sf_dir, "embeddings"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.stored_texts(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near.near_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_texts(table(spark, sf_dir, "pages"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_time_forward_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.compared_with_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_neighbour_graph": op2_neighbour_graph,
    "op3_jpeg_media": op3_jpeg_media,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_near": op5_simhash_near,
    "op6_toxicity": op6_toxicity,
    "op7_site_style": op7_site_style,
    "op8_licence_scan": op8_licence_scan,
    "op9_best_two_fit_packing": op9_best_two_fit_packing,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_recompression_runs": op11_recompression_runs,
    "op12_time_forward_trie": op12_time_forward_trie,
    "op13_quartile_digest": op13_quartile_digest,
}
ORACLE: dict[str, str] = {}
