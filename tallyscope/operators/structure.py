"""Equal-value collaborative structure (coinjoin_like)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import entries
from tallyscope.settings import RULE_SEVERITY, Structure


def equal_groups(ledger: DataFrame, config: Structure | None = None) -> DataFrame:
    """Largest near-equal output group of every transaction."""
    config = config or Structure()
    group = entries.equal_value_groups(
        entries.amounts("outputs"), config.equal_amount_band_sats, config.min_equal_outputs)
    return ledger.select("txid", group.alias("g")).select(
        "txid",
        F.col("g.size").alias("equal_output_count"),
        F.col("g.denomination").alias("denomination_sats"),
        F.col("g.groups").alias("denomination_group_count"),
    )


def collaborative(config: Structure | None = None) -> Column:
    """Row predicate, so excluding these transactions needs no join anywhere."""
    config = config or Structure()
    return F.when(
        (F.col("input_count") >= config.min_inputs)
        & (F.col("output_count") >= config.min_outputs)
        & (F.col("output_count") >= config.min_equal_outputs),
        entries.has_equal_group(entries.amounts("outputs"), config.equal_amount_band_sats, config.min_equal_outputs),
    ).otherwise(F.lit(False))


def mark_collaborative(ledger: DataFrame, config: Structure | None = None) -> DataFrame:
    return ledger.withColumn("collaborative", collaborative(config))


def coinjoin_like(marked: DataFrame, config: Structure | None = None) -> DataFrame:
    """One finding per collaborative transaction; a filter and a projection, no shuffle."""
    config = config or Structure()
    group = entries.equal_value_groups(
        entries.amounts("outputs"), config.equal_amount_band_sats, config.min_equal_outputs)
    return marked.where("collaborative").withColumn("g", group).select(
        F.col("txid").alias("subject_id"),
        F.lit("").alias("context_id"),
        F.lit("collaborative_transaction_participant").alias("role_hypothesis"),
        F.lit(RULE_SEVERITY["coinjoin_like"]).alias("severity"),
        F.col("ts_us").alias("start_us"),
        F.col("ts_us").alias("end_us"),
        F.lit(1).cast("bigint").alias("independent_supports"),
        (F.col("residual_sats") != 0).alias("amount_quality_affected"),
        "input_count",
        "output_count",
        F.col("g.size").alias("equal_output_count"),
        F.bround(F.col("g.size") / F.col("output_count"), 4).alias("equal_output_share"),
        F.col("g.denomination").alias("denomination_sats"),
        F.col("g.groups").alias("denomination_group_count"),
        F.size(F.array_distinct(entries.amounts("outputs"))).alias("distinct_output_values"),
        F.lit(config.equal_amount_band_sats).alias("equal_amount_band_sats"),
    )
