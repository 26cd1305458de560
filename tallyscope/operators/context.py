"""Context findings: shared endpoints, high activity and unexplained anomalies."""
from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.functions import entries
from tallyscope.functions.prefix import running_total
from tallyscope.functions.text import packed
from tallyscope.settings import RULE_SEVERITY, Anomaly, HighActivity, SharedEndpoint


def endpoint_addresses(endpoints: DataFrame, ledger: DataFrame) -> DataFrame:
    """(src_ip, address, sightings): transactions seen at the endpoint that involve the address."""
    people = ledger.select(
        "txid", F.array_distinct(F.concat(entries.addresses("inputs"), entries.addresses("outputs"))).alias("people"))
    return (
        endpoints.join(people, "txid").select("src_ip", F.explode("people").alias("address"))
        .groupBy("src_ip", "address").agg(F.count("*").alias("sightings"))
    )


def shared_ip(endpoints: DataFrame, ledger: DataFrame, config: SharedEndpoint) -> DataFrame:
    """Endpoints at which several addresses keep appearing; an observation, never a merge.

    A finding has counts; the addresses themselves are rows of ``shared_ip_addresses``. Sightings meet the
    ledger once; a sighting counts under its addresses and, with its instant, under itself.
    """
    people = F.array_distinct(F.concat(entries.addresses("inputs"), entries.addresses("outputs")))
    listed = ledger.select(packed(F.col("txid")).alias("tx"), "ts_us", F.coalesce(people, F.array().cast("array<string>")).alias("people"))
    seen = endpoints.select("src_ip", packed(F.col("txid")).alias("tx")).join(listed, "tx").select(
        "src_ip", "ts_us", F.size("people").alias("n"),
        F.posexplode(F.concat("people", F.array(F.lit(None).cast("string")))).alias("at", "address"))
    whole = F.col("at") == F.col("n")  # the sighting itself, after its addresses
    seen = seen.select("src_ip", whole.alias("whole"), "address", "ts_us").groupBy("src_ip", "whole", "address").agg(
        F.count("*").alias("sightings"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    recurs = ~F.col("whole") & (F.col("sightings") >= config.min_observations_per_address)
    found = (
        seen.groupBy("src_ip")
        .agg(F.max(F.when(F.col("whole"), F.col("sightings"))).alias("observation_count"),
             F.max(F.when(F.col("whole"), F.col("first_us"))).alias("start_us"),
             F.max(F.when(F.col("whole"), F.col("last_us"))).alias("end_us"),
             F.count_if(recurs).alias("distinct_addresses_observed"),
             F.count_if(~F.col("whole")).alias("addresses_seen_at_endpoint"),
             F.min(F.when(recurs, F.col("address"))).alias("subject_id"))
        .where((F.col("observation_count") >= config.min_observations)
               & (F.col("distinct_addresses_observed") >= config.min_recurring_addresses))
    )
    return found.select(
        "subject_id",
        F.concat(F.lit("ip:"), "src_ip").alias("context_id"),
        F.lit("unknown_role").alias("role_hypothesis"),
        F.lit(RULE_SEVERITY["shared_ip_observation"]).alias("severity"),
        "start_us",
        "end_us",
        F.lit(1).cast("bigint").alias("independent_supports"),
        F.lit(False).alias("amount_quality_affected"),
        F.col("src_ip").alias("endpoint"),
        "distinct_addresses_observed",
        "addresses_seen_at_endpoint",
        "observation_count",
        F.lit(config.min_observations_per_address).alias("min_observations_per_address"),
        (F.col("distinct_addresses_observed") >= config.infrastructure_address_count)
        .alias("looks_like_shared_infrastructure"),
        F.lit(False).alias("creates_ownership_edge"),
    )


def shared_ip_addresses(findings: DataFrame, endpoints: DataFrame, ledger: DataFrame) -> DataFrame:
    """(endpoint, address, sightings): the recurring addresses behind each ``shared_ip`` finding."""
    wanted = findings.select(F.col("endpoint").alias("src_ip"), "min_observations_per_address")
    seen = endpoint_addresses(endpoints.join(wanted.select("src_ip"), "src_ip", "left_semi"), ledger)
    return seen.join(wanted, "src_ip").where("sightings >= min_observations_per_address").select(
        F.col("src_ip").alias("endpoint"), "address", "sightings")


def activity_cut(activity: DataFrame, percentile: float) -> DataFrame:
    """Nearest-rank percentile of the per-address transaction counts, as one row.

    Works on the histogram of counts; the cumulative count is taken over a range-sorted table,
    so no task sees all addresses. The rank is rounded half to even.
    """
    histogram = activity.groupBy("tx_count").agg(F.count("*").alias("addresses"))
    ranked = running_total(histogram, ["tx_count"], {"before": "addresses"}, "activity-cut")
    population = ranked.agg(F.sum("addresses")).first()[0] or 0
    rank = Decimal(percentile / 100.0 * (population - 1)).quantize(Decimal(1), ROUND_HALF_EVEN) if population else 0
    rank = min(int(rank), max(population - 1, 0))
    return ranked.where((F.col("before") <= rank) & (F.col("before") + F.col("addresses") > rank)).select(
        F.col("tx_count").alias("activity_cut"))


def high_activity(profiles: DataFrame, cut: int, config: HighActivity) -> DataFrame:
    """Busy addresses with their two-way profile. ``profiles`` is :func:`features.address_profiles`."""
    floor = max(cut, config.min_transactions)
    both = F.col("distinct_senders") + F.col("distinct_receivers") - F.col("distinct_counterparties")
    two_way = (F.col("distinct_senders") > 0) & (F.col("distinct_receivers") > 0)
    service = (
        two_way
        & (F.col("distinct_senders") >= config.min_inbound_counterparties)
        & (F.col("distinct_receivers") >= config.min_outbound_counterparties)
    )
    larger = F.greatest("received_sats", "spent_sats")
    return profiles.where(F.col("tx_count") >= floor).select(
        F.col("address").alias("subject_id"),
        F.lit("").alias("context_id"),
        F.when(service, "high_activity_service_like").otherwise("unknown_role").alias("role_hypothesis"),
        F.lit(RULE_SEVERITY["high_activity_context"]).alias("severity"),
        F.col("first_us").alias("start_us"),
        F.col("last_us").alias("end_us"),
        F.lit(1).cast("bigint").alias("independent_supports"),
        F.lit(False).alias("amount_quality_affected"),
        F.col("tx_count").alias("transaction_count"),
        F.lit(cut).cast("bigint").alias("case_activity_percentile_cut"),
        "distinct_counterparties",
        "distinct_senders",
        "distinct_receivers",
        two_way.alias("bidirectional_flow"),
        both.alias("reciprocal_counterparties"),
        F.bround(F.coalesce(F.try_divide(both, "distinct_counterparties"), F.lit(0.0)), 4).alias("reciprocity_ratio"),
        F.bround(F.coalesce(F.try_divide(F.least("received_sats", "spent_sats"), larger), F.lit(0.0)), 4)
        .alias("flow_balance"),
        F.lit(config.min_inbound_counterparties).alias("min_inbound_counterparties"),
        F.lit(config.min_outbound_counterparties).alias("min_outbound_counterparties"),
        F.bround((F.col("last_us") - F.col("first_us")) / F.lit(3.6e9), 2).alias("activity_span_hours"),
        F.bround(F.col("median_gap_us") / F.lit(3.6e9), 3).alias("median_gap_hours"),
        "received_sats",
        "spent_sats",
        service.alias("service_like_profile"),
    )


def statistical_anomaly(scores: DataFrame, profiles: DataFrame, named: DataFrame, config: Anomaly) -> DataFrame:
    """Addresses at or above the reporting percentile that no named pattern explains.

    ``named`` holds the subjects of the named-pattern findings (column ``subject_id``).
    """
    unusual = scores.where(F.col("anomaly_percentile") >= config.report_above_percentile)
    unexplained = unusual.join(named.select(F.col("subject_id").alias("address")), "address", "left_anti")
    return unexplained.join(profiles, "address").select(
        F.col("address").alias("subject_id"),
        F.lit("").alias("context_id"),
        F.lit("unknown_role").alias("role_hypothesis"),
        F.lit(RULE_SEVERITY["statistical_anomaly"]).alias("severity"),
        F.col("first_us").alias("start_us"),
        F.col("last_us").alias("end_us"),
        F.lit(1).cast("bigint").alias("independent_supports"),
        F.lit(False).alias("amount_quality_affected"),
        F.bround("anomaly_percentile", 2).alias("anomaly_percentile"),
        F.lit(config.report_above_percentile).alias("report_above_percentile"),
        F.col("tx_count").alias("transaction_count"),
        "received_sats",
        "spent_sats",
        F.lit(False).alias("matched_named_pattern"),
    )
