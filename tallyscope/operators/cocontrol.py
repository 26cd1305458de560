"""Candidate common control from repeated co-spending."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import entries
from tallyscope.operators.components import connected_components
from tallyscope.settings import CLUSTER_RULE, RULE_SEVERITY, CommonControl


#: Inputs of a transaction that pair within one row; more are cut into chunks of this size.
_CHUNK = 64


def _with_inputs(marked: DataFrame) -> DataFrame:
    """Rows of several input addresses; one-input rows leave before any array is made."""
    return marked.where(F.size("inputs") >= 2).select(
        "txid", "ts_us", "input_count", "collaborative", (F.col("residual_sats") != 0).alias("discrepancy"),
        F.sort_array(entries.distinct_addresses("inputs")).alias("members"),
    ).where(F.size("members") >= 2)


def co_input_pairs(marked: DataFrame, input_threshold: int | None = None) -> DataFrame:
    """(a, b, txid, ...) for every pair of distinct inputs, a < b.

    Pairs are built inside the row. A transaction with very many inputs is cut into chunks first
    and its pairs of chunks are spread over tasks; the result is the same.
    """
    usable = _with_inputs(marked).where(~F.col("collaborative"))
    if input_threshold is not None:
        usable = usable.where(F.col("input_count") < input_threshold)
    usable = usable.select("txid", "ts_us", "discrepancy", "members")
    narrow = usable.where(F.size("members") <= _CHUNK).withColumns({"left": F.col("members"), "right": F.col("members")})
    chunks = F.transform(F.sequence(F.lit(1), F.size("members"), F.lit(_CHUNK)), lambda i: F.slice(F.col("members"), i, F.lit(_CHUNK)))
    wide = (
        usable.where(F.size("members") > _CHUNK).withColumn("chunks", chunks)
        .select("*", F.posexplode("chunks").alias("at", "left"))
        .withColumn("right", F.explode(F.slice(F.col("chunks"), F.col("at") + 1, F.size("chunks")))).drop("chunks", "at")
        .repartition("txid", F.hash("left"), F.hash("right"))
    )
    return (
        narrow.unionByName(wide).drop("members").withColumn("a", F.explode("left")).withColumn("b", F.explode("right"))
        .where("a < b").select("a", "b", "txid", "ts_us", "discrepancy")
    )


def excluded_transactions(marked: DataFrame, config: CommonControl) -> DataFrame:
    """Multi-input transactions the rule does not count, with the first reason that applies."""
    reason = (
        F.when(F.col("collaborative"), F.lit("collaborative structure"))
        .when(F.col("input_count") >= config.collaborative_input_threshold,
              F.format_string("inputs %d >= %d", "input_count",
                              F.lit(config.collaborative_input_threshold)))
    )
    return _with_inputs(marked).withColumn("reason", reason).where("reason is not null").select(
        "txid", "members", "reason")


def supported_pairs(pairs: DataFrame, floor: int) -> DataFrame:
    """Pairs sharing at least ``floor`` transactions."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared_transaction_count")).where(
        F.col("shared_transaction_count") >= floor)


def repeated_partners(marked: DataFrame) -> DataFrame:
    """Distinct addresses each address was co-spent with more than once."""
    pairs = supported_pairs(co_input_pairs(marked), 2)
    return (
        pairs.select(F.explode(F.array("a", "b")).alias("address"))
        .groupBy("address").agg(F.count("*").alias("repeated_co_input_partners"))
    )


def clusters(supported: DataFrame, config: CommonControl) -> DataFrame:
    """(root, address, member_count, oversized) of every component.

    Components above ``max_cluster_size`` are kept and marked; only their member and edge arrays
    are left out of the hypotheses, as the long tables hold them.
    """
    nodes = connected_components(supported, "a", "b").select("root", F.col("node").alias("address"))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("member_count"))
    return nodes.join(sizes, "root").withColumn("oversized", F.col("member_count") > config.max_cluster_size)


def cluster_support(pairs: DataFrame, supported: DataFrame, members: DataFrame) -> DataFrame:
    """(root, a, b, txid, ...): the transactions behind every supported pair of a cluster."""
    rooted = supported.join(members.select(F.col("address").alias("a"), "root"), "a").select("a", "b", "root")
    return pairs.join(rooted, ["a", "b"])


def cluster_hypotheses(supported: DataFrame, support: DataFrame, members: DataFrame,
                       excluded: DataFrame) -> DataFrame:
    """One row per cluster: members, scored edges, supporting and excluded transaction counts.

    Arrays of members and edges are empty for oversized clusters, which bounds both; all members
    are in ``clusters``, all edges in ``cluster_edges``. Supporting and excluded transactions are
    counted here and listed in their own long tables.
    """
    rooted = supported.join(members.select(F.col("address").alias("a"), "root", "member_count", "oversized"), "a")
    listed = ~F.col("oversized")
    edges = rooted.groupBy("root").agg(
        F.count("*").alias("inferred_edge_count"),
        F.array_sort(F.collect_list(F.when(listed, F.struct("a", "b", "shared_transaction_count")))).alias("edges"),
        F.bool_or("oversized").alias("oversized"),
        F.sum("shared_transaction_count").alias("shared"),
        F.max("member_count").alias("member_count"),
    )
    people = members.groupBy("root").agg(F.sort_array(F.collect_set(F.when(listed, F.col("address")))).alias("members"))
    tx = support.groupBy("root", "txid").agg(
        F.min("ts_us").alias("ts_us"), F.bool_or("discrepancy").alias("discrepancy"))
    supports = tx.groupBy("root").agg(
        F.count("*").alias("supporting_transaction_count"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.bool_or("discrepancy").alias("amount_quality_affected"),
    )
    left_out = cluster_exceptions(excluded, members).groupBy("root").agg(F.count("*").alias("excluded_transactions"))
    strength = F.bround(F.least(F.lit(1.0), F.col("shared") / (F.col("member_count") * 4)), 4)
    return (
        edges.join(people, "root").join(supports, "root").join(left_out, "root", "left")
        .select(
            F.concat(F.lit("clu_"), F.substring(F.sha2("root", 256), 1, 16)).alias("cluster_id"),
            "root", "members", "member_count", "oversized", "edges", "inferred_edge_count",
            strength.alias("strength"),
            F.lit(CLUSTER_RULE).alias("rule_version"),
            "supporting_transaction_count",
            F.coalesce("excluded_transactions", F.lit(0).cast("bigint")).alias("excluded_transactions"),
            "start_us", "end_us", "amount_quality_affected",
        )
    )


def cluster_exceptions(excluded: DataFrame, members: DataFrame) -> DataFrame:
    """(root, txid, reason): excluded transactions that involve a member."""
    return (
        excluded.select("txid", "reason", F.explode("members").alias("address"))
        .join(members.select("address", "root"), "address")
        .select("root", "txid", "reason").distinct()
    )


def common_control(hypotheses: DataFrame, members: DataFrame, config: CommonControl) -> DataFrame:
    """One finding per cluster member."""
    return members.select("root", F.col("address").alias("subject_id")).join(hypotheses, "root").select(
        "subject_id",
        F.col("cluster_id").alias("context_id"),
        F.lit("possible_common_control_member").alias("role_hypothesis"),
        F.lit(RULE_SEVERITY["common_control"]).alias("severity"),
        "start_us",
        "end_us",
        F.col("supporting_transaction_count").alias("independent_supports"),
        "amount_quality_affected",
        "cluster_id",
        "member_count",
        "members",
        "inferred_edge_count",
        "supporting_transaction_count",
        F.lit(config.min_shared_transactions).alias("min_shared_transactions_threshold"),
        "strength",
        "excluded_transactions",
        "rule_version",
        F.filter("edges", lambda e: (e["a"] == F.col("subject_id")) | (e["b"] == F.col("subject_id")))
        .alias("subject_pairs"),
    )


def cluster_edges(hypotheses: DataFrame, supported: DataFrame, members: DataFrame) -> DataFrame:
    """Inferred common-control edges, one per supported pair of every cluster."""
    rooted = supported.join(members.select(F.col("address").alias("a"), "root"), "a")
    return rooted.join(hypotheses.select("root", "cluster_id", "strength", "rule_version"), "root").select(
        F.concat(F.lit("addr:"), "a").alias("source"),
        F.concat(F.lit("addr:"), "b").alias("target"),
        F.concat_ws(":", F.lit("cc"), "cluster_id", "a", "b").alias("key"),
        F.lit("candidate_common_control").alias("kind"),
        "rule_version",
        "strength",
        F.col("shared_transaction_count").alias("support"),
    )
