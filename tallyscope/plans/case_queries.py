"""Reads over the stored tables of a case: inbox, facets, details, review state."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.functions import entries
from tallyscope.operators.evidence import evidence_counts, evidence_of

FACETS = ("pattern", "priority_band", "evidence_strength", "review_state", "role_hypothesis")


def _page(df: DataFrame, order: Sequence, limit: int, offset: int) -> DataFrame:
    """One page in a total order; sort, offset and limit run as a distributed top-k."""
    return df.orderBy(*order).offset(offset).limit(limit)


def filter_alerts(alerts: DataFrame, pattern: str | None = None, band: str | None = None,
                  evidence_strength: str | None = None, review_state: str | None = None, role: str | None = None,
                  subject: str | None = None) -> DataFrame:
    """Alerts that match every given filter; ``subject`` matches any part of the subject id, ignoring ASCII case."""
    equal = {"pattern": pattern, "priority_band": band, "evidence_strength": evidence_strength,
             "review_state": review_state, "role_hypothesis": role}
    for column, value in equal.items():
        if value:
            alerts = alerts.where(F.col(column) == value)
    if subject:
        alerts = alerts.where(F.lower("subject_id").contains(subject.lower()))
    return alerts


def list_alerts(alerts: DataFrame, evidence: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page of the inbox, highest priority first, with evidence counts."""
    page = _page(filter_alerts(alerts, **filters), [F.desc("priority"), "alert_id"], limit, offset)
    return page.join(evidence_counts(page, evidence), "alert_id", "left").orderBy(F.desc("priority"), "alert_id")


def alert_facets(alerts: DataFrame) -> DataFrame:
    """(facet, value, n) over all alerts of a run, in one pass."""
    cells = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in FACETS])
    return alerts.select(F.explode(cells).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def alerts_for_address(alerts: DataFrame, address: str) -> DataFrame:
    return alerts.where(F.col("subject_id") == address).select(
        "alert_id", "pattern", "pattern_label", "role_hypothesis", "priority", "priority_band", "evidence_strength",
        "review_state").orderBy(F.desc("priority"), "alert_id")


def case_overview(cases: DataFrame, datasets: DataFrame, runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases, newest first, with dataset, run and alert counts and the latest complete run."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    latest = runs.where("status = 'complete'").groupBy("case_id").agg(
        F.max_by("run_id", F.struct("finished_at", "run_id")).alias("latest_run_id"))
    df = (
        cases.join(count(datasets, "dataset_count"), "case_id", "left")
        .join(count(runs, "run_count"), "case_id", "left")
        .join(count(alerts, "alert_count"), "case_id", "left")
        .join(latest, "case_id", "left")
    )
    return df.fillna(0, ["dataset_count", "run_count", "alert_count"]).orderBy(F.desc("updated_at"), "case_id")


def dataset_detail(datasets: DataFrame, issues: DataFrame) -> DataFrame:
    """Datasets with their issue counts by code; a map holds at most one entry per code."""
    counts = (
        issues.groupBy("dataset_id", "code").agg(F.count("*").alias("n"))
        .groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n"))))
                                   .alias("issue_counts"))
    )
    return datasets.join(counts, "dataset_id", "left").withColumn(
        "reconciles",
        F.col("total_rows") == F.col("accepted_clean") + F.col("accepted_warning") + F.col("quarantined"))


def alert_bands(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority_band").agg(F.count("*").alias("n"))


def list_issues(issues: DataFrame, dataset_id: str, code: str | None = None, limit: int = 100,
                offset: int = 0) -> DataFrame:
    """Issues of a dataset by row; dataset-level issues (no row) come first."""
    df = issues.where(F.col("dataset_id") == dataset_id)
    if code:
        df = df.where(F.col("code") == code)
    return _page(df, [F.asc_nulls_first("row_number"), "ordinal", "code"], limit, offset)


def list_source_rows(source_rows: DataFrame, dataset_id: str, status: str | None = None, limit: int = 50,
                     offset: int = 0) -> DataFrame:
    df = source_rows.where(F.col("dataset_id") == dataset_id)
    if status:
        df = df.where(F.col("status") == status)
    return _page(df, ["row_number"], limit, offset)


def trace_source_row(source_rows: DataFrame, datasets: DataFrame, issues: DataFrame, dataset_id: str,
                     row_number: int) -> DataFrame:
    """One original row with its file and the issues recorded for it."""
    at = (F.col("dataset_id") == dataset_id) & (F.col("row_number") == row_number)
    found = issues.where(at).groupBy("dataset_id", "row_number").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "code", "severity", "field", "message"))).alias("issues"))
    return (
        source_rows.where(at).join(datasets.select("dataset_id", "file", "sha256"), "dataset_id")
        .join(found, ["dataset_id", "row_number"], "left")
    )


def alert_detail(alerts: DataFrame, evidence: DataFrame, scores: DataFrame, notes: DataFrame, reviews: DataFrame,
                 alert_id: str) -> tuple[DataFrame, DataFrame]:
    """(alert with score, notes and history; its supporting records)."""
    alert = alerts.where(F.col("alert_id") == alert_id)
    written = notes.where(F.col("alert_id") == alert_id).groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "author", "body"))).alias("notes"))
    history = reviews.where(F.col("alert_id") == alert_id).groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "actor", "from_state", "to_state", "reason"))).alias("review_history"))
    score = scores.select(F.col("address").alias("subject_id"),
                          F.struct("anomaly_score", "anomaly_percentile", "unscored_reason").alias("address_score"))
    detail = (
        alert.join(score, "subject_id", "left").join(written, "alert_id", "left").join(history, "alert_id", "left")
    )
    return detail, evidence_of(alert, evidence)


def list_clusters(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.orderBy(F.desc("strength"), "cluster_id")


def current_review_state(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Alerts with the latest state of the append-only review events."""
    latest = reviews.groupBy("alert_id").agg(F.max_by("to_state", F.struct("at", "event_id")).alias("latest_state"))
    return alerts.join(latest, "alert_id", "left").withColumn(
        "review_state", F.coalesce("latest_state", "review_state")).drop("latest_state")


def case_audit(events: DataFrame, case_id: str, limit: int = 200) -> DataFrame:
    return events.where(F.col("case_id") == case_id).orderBy(F.desc("event_id")).limit(limit)


def address_summary(activity: DataFrame, address: str) -> DataFrame:
    """Totals of one address over the imported period."""
    return activity.where(F.col("address") == address).select(
        "address", F.col("tx_count").alias("transaction_count"), "received_sats", "spent_sats",
        F.col("incoming_tx_count").alias("incoming_transactions"),
        F.col("outgoing_tx_count").alias("outgoing_transactions"),
        F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"))


def address_transactions(address_tx: DataFrame, ledger: DataFrame, address: str, limit: int | None = None,
                         offset: int = 0) -> DataFrame:
    """Transactions of an address with direction and amount, oldest first; all, or one page."""
    own = address_tx.where(F.col("address") == address)
    if limit is not None:
        own = _page(own, ["ts_us", "txid"], limit, offset)
    direction = F.when(F.col("spends") & F.col("receives"), "both").when(F.col("spends"), "out").otherwise("in")
    return own.join(ledger.select("txid", "observed_at", "row_number"), "txid").select(
        "txid", "observed_at", "row_number", direction.alias("direction"), "input_count", "output_count",
        F.when(F.col("received_sats") > 0, F.col("received_sats")).otherwise(F.col("spent_sats")).alias("amount_sats"),
        F.col("discrepancy").alias("amount_discrepancy")).orderBy("observed_at", "txid")


def top_endpoints(ledger: DataFrame, observations: DataFrame, address: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """(address, src_ip, sightings, rank): endpoints at which records of an address were seen, most often first.

    With ``limit`` only so many per address.
    """
    people = F.array_distinct(F.concat(entries.addresses("inputs"), entries.addresses("outputs")))
    mine = ledger.select("txid", F.explode(people).alias("address"))
    if address is not None:
        mine = mine.where(F.col("address") == address)
    counts = (
        observations.where("src_ip is not null").join(mine, "txid")
        .groupBy("address", "src_ip").agg(F.count("*").alias("sightings"))
    )
    order = W.partitionBy("address").orderBy(F.desc("sightings"), "src_ip")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
