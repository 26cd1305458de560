"""Supporting records behind findings.

Rows name the finding they support by (detector, subject_id, context_id). Records of a peeling
sequence support every finding of that sequence; they are kept once, with a null subject_id, so
a sequence of n hops has n rows and not n per subject.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import entries

_COLUMNS = ("detector", "subject_id", "context_id", "kind", "txid", "detail")


def _rows(df: DataFrame, detector: str, kind: str, **detail) -> DataFrame:
    body = F.to_json(F.struct(*[value.alias(name) for name, value in detail.items()]))
    return df.select(F.lit(detector).alias("detector"), "subject_id", "context_id", F.lit(kind).alias("kind"),
                     "txid", body.alias("detail"))


def coinjoin_evidence(marked: DataFrame) -> DataFrame:
    df = marked.where("collaborative").withColumn("subject_id", F.col("txid")).withColumn("context_id", F.lit(""))
    return _rows(
        df, "coinjoin_like", "transaction",
        input_count=F.col("input_count"), output_count=F.col("output_count"),
        input_addresses=entries.addresses("inputs"), output_addresses=entries.addresses("outputs"),
        output_amounts_sats=entries.amounts("outputs"), observed_at=F.col("observed_at"))


def collection_evidence(window_tx: DataFrame, reported: DataFrame, ledger: DataFrame) -> DataFrame:
    df = (
        window_tx.withColumnRenamed("receiver", "subject_id")
        .join(reported.select("subject_id", "context_id"), "subject_id")
        .join(ledger.select("txid", "observed_at", entries.addresses("inputs").alias("people")), "txid")
    )
    return _rows(
        df, "collection_pattern", "transaction",
        observed_at=F.col("observed_at"),
        payers=F.filter("people", lambda a: a != F.col("subject_id")),
        amount_to_subject_sats=F.col("received_sats"), amount_discrepancy=F.col("discrepancy"))


def participant_evidence(payments: DataFrame) -> DataFrame:
    df = payments.select(F.col("payer").alias("subject_id"), F.col("receiver").alias("context_id"), "txid", "ts_us")
    return _rows(df, "payment_participant", "transaction",
                 observed_at=F.timestamp_micros("ts_us"), collection_point=F.col("context_id"))


def peel_evidence(hops: DataFrame) -> DataFrame:
    df = hops.withColumn("subject_id", F.lit(None).cast("string")).withColumn(
        "context_id", F.concat(F.lit("peel:"), "chain"))
    return _rows(
        df, "peeling_sequence", "transaction",
        hop=F.col("hop"), observed_at=F.timestamp_micros("ts_us"), dominant_output_address=F.col("address"),
        dominant_output_sats=F.col("amount_sats"), dominant_share=F.col("share"),
        side_outputs=F.transform("side_outputs", lambda e: F.struct(e["address"].alias("address"),
                                                                    e["amount_sats"].alias("amount_sats"))),
        amount_discrepancy=F.col("discrepancy"))


def cluster_evidence(support: DataFrame, members: DataFrame, hypotheses: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per member: the supporting transactions it is an input of (at most four inputs each)."""
    tx = support.select("root", "txid").distinct().join(
        ledger.select("txid", "observed_at", "input_count", entries.distinct_addresses("inputs").alias("people")), "txid")
    inside = (
        tx.select("root", "txid", "observed_at", "input_count", F.explode("people").alias("address"))
        .join(members.select("root", "address"), ["root", "address"])
    )
    together = inside.groupBy("root", "txid").agg(F.sort_array(F.collect_list("address")).alias("co_spent"))
    df = (
        inside.join(together, ["root", "txid"]).join(hypotheses.select("root", "cluster_id"), "root")
        .select(F.col("address").alias("subject_id"), F.col("cluster_id").alias("context_id"), "txid",
                "observed_at", "input_count", "co_spent")
    )
    return _rows(df, "common_control", "transaction", observed_at=F.col("observed_at"),
                 co_spent_addresses=F.col("co_spent"), input_count=F.col("input_count"))


def endpoint_evidence(shared: DataFrame, endpoints: DataFrame, ledger: DataFrame) -> DataFrame:
    df = (
        endpoints.join(shared.select(F.col("endpoint").alias("src_ip"), "subject_id", "context_id"), "src_ip")
        .join(ledger.select("txid", "ts_us"), "txid")
    )
    return _rows(df, "shared_ip_observation", "observation",
                 observed_at=F.timestamp_micros("ts_us"), src_ip=F.col("src_ip"))


def address_evidence(findings: DataFrame, detector: str, address_tx: DataFrame) -> DataFrame:
    """The subject's own transactions (high activity, anomaly)."""
    df = address_tx.select(F.col("address").alias("subject_id"), "txid", "ts_us").join(
        findings.select("subject_id", "context_id"), "subject_id")
    return _rows(df, detector, "transaction", observed_at=F.timestamp_micros("ts_us"))


def with_row_numbers(evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    return evidence.join(ledger.select("txid", "row_number"), "txid", "left").select(
        "detector", "subject_id", "context_id", "kind", "txid", "row_number", "detail")


def evidence_of(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(alert_id, ...) one row per supporting record of the given alerts."""
    keys = alerts.select("alert_id", F.col("pattern").alias("detector"), F.col("subject_id").alias("alert_subject"),
                         "context_id")
    own = evidence.where("subject_id is not null").join(
        keys.withColumn("subject_id", F.col("alert_subject")), ["detector", "subject_id", "context_id"])
    shared = evidence.where("subject_id is null").drop("subject_id").join(
        keys.withColumn("subject_id", F.col("alert_subject")), ["detector", "context_id"])
    names = ["alert_id", "subject_id", "kind", "txid", "row_number", "detail"]
    return own.select(*names).unionByName(shared.select(*names))


def evidence_counts(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(alert_id, evidence_count) without expanding shared records per alert."""
    own = evidence.where("subject_id is not null").groupBy("detector", "subject_id", "context_id").agg(
        F.count("*").alias("own"))
    shared = evidence.where("subject_id is null").groupBy("detector", "context_id").agg(F.count("*").alias("shared"))
    keys = alerts.select("alert_id", F.col("pattern").alias("detector"), "subject_id", "context_id")
    zero = F.lit(0).cast("bigint")
    return (
        keys.join(own, ["detector", "subject_id", "context_id"], "left")
        .join(shared, ["detector", "context_id"], "left")
        .select("alert_id", (F.coalesce("own", zero) + F.coalesce("shared", zero)).alias("evidence_count"))
    )
