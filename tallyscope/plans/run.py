"""The analysis run: ledger in, alerts, evidence, scores and predictions out."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.prefix import one_row
from tallyscope.functions.staging import release, stage, staged_here
from tallyscope.operators import (
    activity,
    cocontrol,
    collection,
    context,
    evidence,
    features,
    model,
    peeling,
    scoring,
    structure,
)
from tallyscope.session import side_by_side
from tallyscope.settings import NAMED_PATTERNS, DetectorConfig


@dataclass
class RunResult:
    run_id: str
    config: DetectorConfig
    ledger: DataFrame
    findings: DataFrame
    alerts: DataFrame
    evidence: DataFrame
    scores: DataFrame
    features: DataFrame
    hypotheses: DataFrame
    cluster_support: DataFrame
    cluster_exceptions: DataFrame
    peel_hops: DataFrame
    predictions: DataFrame
    transaction_predictions: DataFrame
    inferred_edges: DataFrame
    stats: DataFrame
    model_status: str
    model_error: str | None


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def case_tables(ledger: DataFrame, config: DetectorConfig) -> tuple[DataFrame, DataFrame]:
    """The marked ledger and the address-transaction table of a run, staged."""
    marked = stage(structure.mark_collaborative(ledger, config.coinjoin), "ledger")
    return marked, stage(activity.address_transactions(marked), "address-tx")


def run_analysis(ledger: DataFrame, observations: DataFrame, config: DetectorConfig | None = None,
                 anomaly_model: model.AnomalyModel | model.ScoreTable | None = None, run_id: str = "run",
                 made: tuple[DataFrame, DataFrame] | None = None) -> RunResult:
    """Run every detector, score and rank, with a fitted model or a frozen table of scores.

    Tables used by several consumers are staged once: the marked ledger, the address-transaction
    table, the profiles, and the small tables each detector narrows down to. The collaborative
    mark is a column of the ledger, so excluding those transactions is a filter. The two branches with
    the largest shuffles run one after the other, so that only one of them holds disk at a time.

    ``made`` takes the first two, from :func:`case_tables` of the same ledger and configuration.
    """
    config = config or DetectorConfig()
    marked, address_tx = made or case_tables(ledger, config)
    endpoints = activity.endpoint_index(observations)

    def profile_branch():
        profiles = stage(features.address_profiles(marked, address_tx), "profiles")
        frame = features.address_features(profiles)
        scores, status, error = model.score_addresses(frame, anomaly_model)
        cut = context.activity_cut(profiles, config.high_volume.activity_percentile).first()
        busy = context.high_activity(profiles, cut[0] if cut else 0, config.high_volume)
        return profiles, frame, stage(scores, "address-scores"), status, error, stage(busy, "high-activity")

    def collection_branch():
        with staged_here() as made:
            events = collection.receive_events(marked, collection.possible_collectors(marked, config.collection))
            best = stage(collection.best_window(events, config.collection), "best-window")
        release(*made[:-1])
        collectors = best.select(F.col("receiver").alias("address"))
        with staged_here() as made:
            paid = collection.window_payments(
                collection.receive_events(marked, collectors), best, config.collection)
            window = stage(collection.window_transactions(paid, address_tx), "window-tx")
        release(best, *made[:-1])
        return window

    def peel_branch():
        with staged_here() as made:
            chains = peeling.peel_chains(marked, address_tx, config.peeling)
            hops = stage(peeling.peel_hops(chains, marked), "peel-hops")
        release(*made[:-1])
        return hops

    def control_branch():
        rule = config.common_control
        pairs = cocontrol.co_input_pairs(marked, rule.collaborative_input_threshold)
        supported = stage(cocontrol.supported_pairs(pairs, rule.min_shared_transactions), "pairs")
        members = stage(cocontrol.clusters(supported, rule), "clusters")
        support = stage(cocontrol.cluster_support(pairs, supported, members), "cluster-support")
        excluded = cocontrol.excluded_transactions(marked, rule)
        hypotheses = stage(cocontrol.cluster_hypotheses(supported, support, members, excluded), "hypotheses")
        return supported, members, support, excluded, hypotheses

    def endpoint_branch():
        return stage(context.shared_ip(endpoints, marked, config.shared_ip), "shared-ip")

    profiles, frame, scores, status, error, busy = profile_branch()
    window_tx = collection_branch()
    hops, control, shared = side_by_side(marked.sparkSession, peel_branch, control_branch, endpoint_branch)
    supported, members, support, excluded, hypotheses = control

    service_like = busy.where("service_like_profile").select(F.col("subject_id").alias("address"))
    candidates = collection.collection_candidates(marked, window_tx, address_tx, profiles, config.collection)
    graded = stage(collection.grade_collection(candidates, service_like, config.collection), "graded")
    reported = collection.report_collection(graded, config.collection)
    payments = stage(collection.participant_payments(marked, reported, address_tx), "payments")

    typed = {
        "coinjoin_like": structure.coinjoin_like(marked, config.coinjoin),
        "collection_pattern": reported,
        "payment_participant": collection.payment_participants(payments, reported),
        "peeling_sequence": peeling.peel_findings(hops, config.peeling),
        "common_control": cocontrol.common_control(hypotheses, members, config.common_control),
        "shared_ip_observation": shared,
        "high_activity_context": busy,
    }
    named = _union([typed[d].select("subject_id") for d in NAMED_PATTERNS]).distinct()
    unusual = stage(context.statistical_anomaly(scores, profiles, named, config.anomaly), "unusual")
    typed["statistical_anomaly"] = unusual
    findings = stage(_union([scoring.as_findings(df, d) for d, df in typed.items()]), "findings")
    alerts = stage(scoring.build_alerts(findings, scores, run_id, status == "used"), "alerts")

    records = evidence.with_row_numbers(_union([
        evidence.coinjoin_evidence(marked),
        evidence.collection_evidence(window_tx, reported, marked),
        evidence.participant_evidence(payments),
        evidence.peel_evidence(hops),
        evidence.cluster_evidence(support, members, hypotheses, marked),
        evidence.endpoint_evidence(shared, endpoints, marked),
        evidence.address_evidence(busy, "high_activity_context", address_tx),
        evidence.address_evidence(unusual, "statistical_anomaly", address_tx),
    ]), marked)
    inferred = peeling.continuity_edges(hops, config.version).unionByName(cocontrol.cluster_edges(hypotheses, supported, members))
    predictions = scoring.address_predictions(profiles, scores, findings, alerts, marked)
    stats = run_statistics(marked, observations, findings, scores, hypotheses, graded, config, status)
    return RunResult(
        run_id, config, marked, findings, alerts, records, scores, frame, hypotheses,
        support.select("root", "a", "b", "txid"), cocontrol.cluster_exceptions(excluded, members), hops,
        predictions, scoring.transaction_predictions(findings), inferred, stats, status, error)


def run_statistics(ledger: DataFrame, observations: DataFrame, findings: DataFrame, scores: DataFrame,
                   hypotheses: DataFrame, graded: DataFrame, config: DetectorConfig, model_status: str) -> DataFrame:
    """Coverage and result counts of a run as one row."""
    by_detector = findings.groupBy("detector").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "n")))).alias("counts_by_detector"))
    numbers = one_row(
        activity.coverage(ledger, observations),
        findings.agg(F.count("*").alias("alerts_total")),
        scores.agg(F.count("anomaly_score").alias("addresses_scored"),
                   F.count_if(F.col("anomaly_score").isNull()).alias("addresses_unscored")),
        ledger.agg(F.count_if("collaborative").alias("collaborative_transactions_excluded")),
        hypotheses.agg(F.count("*").alias("cluster_hypotheses")),
        collection.collection_counts(graded, config.collection),
        by_detector.select(F.to_json("counts_by_detector").alias("counts_by_detector")),
    )
    return numbers.withColumn("model_status", F.lit(model_status)).withColumn(
        "detector_version", F.lit(config.version))
