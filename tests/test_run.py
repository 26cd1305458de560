import json

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import graph, model
from tallyscope.operators.evidence import evidence_counts, evidence_of
from tallyscope.operators.importing import import_rows
from tallyscope.operators.scoring import sensitivity
from tallyscope.plans import case_queries, evaluate, export
from tallyscope.plans.run import run_analysis
from tallyscope.settings import DetectorConfig
from tests.scenarios import harbour


@pytest.fixture(scope="module")
def run(spark):
    result = import_rows(harbour().frame(spark))
    first = run_analysis(result.transactions, result.observations, run_id="r")
    return run_analysis(result.transactions, result.observations,
                        anomaly_model=model.fit_model(first.features, trees=50), run_id="r")


@pytest.fixture(scope="module")
def alerts(run):
    return run.alerts.collect()


def _of(alerts, pattern):
    return {a.subject_id: a for a in alerts if a.pattern == pattern}


def test_mixing_rounds_only(alerts):
    assert set(_of(alerts, "coinjoin_like")) == set(harbour().marks["veil"])


def test_collection_and_participants(alerts):
    collector = _of(alerts, "collection_pattern")["basin"]
    values = json.loads(collector.indicators)
    assert values["distinct_payers"] == 12 and values["subsequent_outflow_transactions"] == 2
    assert {f"giver{i}" for i in range(12)} <= set(_of(alerts, "payment_participant"))
    assert _of(alerts, "payment_participant")["giver0"].severity < collector.severity
    service = _of(alerts, "collection_pattern").get("counter")
    assert service is None or service.severity <= 30


def test_peeling(alerts):
    peel = [a for a in alerts if a.pattern == "peeling_sequence"]
    chain = {a.subject_id: a.role_hypothesis for a in peel}
    assert chain == {**{f"drip{i}": "sequence_continuation" for i in range(1, 8)},
                     **{f"crumb{i}": "sequence_side_recipient" for i in range(7)}}
    assert {json.loads(a.indicators)["hop_count"] for a in peel} == {7}


def test_common_control_excludes_mixing(alerts, run):
    assert set(_of(alerts, "common_control")) == {"purse-a", "purse-b", "purse-c"}
    row = run.hypotheses.first()
    assert (row.members, row.strength, [e.shared_transaction_count for e in row.edges]) == (
        ["purse-a", "purse-b", "purse-c"], 0.5833, [4, 3])


def test_context_findings_carry_no_severity(alerts):
    shared = json.loads(_of(alerts, "shared_ip_observation")["lodger0"].indicators)
    assert shared["endpoint"] == "198.51.100.8" and shared["distinct_addresses_observed"] == 7
    assert _of(alerts, "high_activity_context")["counter"].role_hypothesis == "high_activity_service_like"
    assert all(a.severity == 0 for a in alerts if a.pattern in ("shared_ip_observation", "high_activity_context"))


def test_every_alert_has_text_and_evidence(run, alerts):
    assert all(a.explanation and a.alternatives and a.caveats for a in alerts)
    counts = {r.alert_id: r.evidence_count for r in evidence_counts(run.alerts, run.evidence).collect()}
    listed = {r.alert_id: r["count"] for r in evidence_of(run.alerts, run.evidence).groupBy("alert_id").count().collect()}
    assert counts == listed and set(counts) == {a.alert_id for a in alerts} and min(counts.values()) > 0


def test_same_input_same_alerts(spark, run, alerts):
    again = import_rows(harbour().frame(spark).repartition(7))
    other = run_analysis(again.transactions, again.observations, run_id="r").alerts
    rules = lambda rows: sorted((a.alert_id, a.indicators) for a in rows if a.pattern != "statistical_anomaly")
    assert rules(other.collect()) == rules(alerts)


def test_labels_do_not_matter(spark, alerts):
    book = harbour()
    for i, row in enumerate(book.rows):
        row["is_planted_suspicious"] = str(i % 2)
    changed = import_rows(book.frame(spark))
    other = run_analysis(changed.transactions, changed.observations, run_id="r").alerts.collect()
    assert {a.alert_id for a in other} == {a.alert_id for a in alerts if a.pattern != "statistical_anomaly"}


def test_predictions_and_evaluation(spark, run):
    rows = {r.address: r for r in run.predictions.collect()}
    assert rows["mask0"].transaction_patterns == ["coinjoin_like"] and rows["mask0"].scored
    truth = spark.createDataFrame(
        [(a, "1" if a in ("basin", "drip3", "mask0") else "0", "p") for a in rows if a != "crew0"] + [("GONE", "1", "p")],
        "wallet_id string, is_suspicious string, pattern_type string")
    tables = evaluate.evaluate(run.predictions, truth)
    seen = tables["coverage"].first()
    assert (seen.joined, seen.in_predictions_only, seen.in_ground_truth_only) == (len(rows) - 1, 1, 1)
    cells = tables["confusion"].first()
    assert (cells.tp, cells.fn) == (3, 0) and cells.recall == 1.0
    assert {r.variant for r in tables["average_precision"].collect()} == set(evaluate.VARIANTS)


def test_sensitivity_without_model(run):
    row = sensitivity(run.alerts, drop_model=True).join(run.alerts.select("alert_id", "severity"), "alert_id")
    assert row.where(F.abs(F.col("revised_priority") - F.col("severity")) > 0.005).isEmpty()


def test_graph_neighbourhood_is_bounded(run):
    edges = graph.overlay_inferred_edges(graph.graph_edges(run.ledger, run.ledger.limit(0).select(
        "txid", "row_number", F.lit("").alias("src_ip"), F.lit(0).alias("src_port"), F.lit("").alias("dst_ip"),
        F.lit(0).alias("dst_port"))), run.inferred_edges)
    view = graph.neighbourhood(edges, ["addr:basin", "addr:NOBODY"], hops=1, node_budget=5)
    assert view.meta["truncated"] and view.meta["nodes_returned"] == 5 and view.meta["missing_seeds"] == ["addr:NOBODY"]
    whole = graph.neighbourhood(edges, ["addr:purse-a"], hops=2, node_budget=300)
    assert {r.id for r in whole.nodes.collect()} >= {"addr:purse-a", "addr:purse-b", "addr:shop0"}
    assert not whole.meta["truncated"]


def test_inbox_and_export(spark, run, tmp_path):
    page = case_queries.list_alerts(run.alerts, run.evidence, limit=5, pattern="payment_participant")
    assert page.count() == 5 and page.where("evidence_count < 1").isEmpty()
    facets = {(r.facet, r.value): r.n for r in case_queries.alert_facets(run.alerts).collect()}
    assert facets["pattern", "coinjoin_like"] == 4
    manifest = export.export_run(spark, run, str(tmp_path / "out"))
    assert manifest["tables"]["alerts"]["rows"] == run.alerts.count()
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out" / "alerts"))
    assert tuple(back.columns) == export.ALERT_COLUMNS and back.count() == run.alerts.count()
    with pytest.raises(ValueError):
        export.export_run(spark, run, str(tmp_path / "no"), status="running")


def test_partial_config_keeps_defaults():
    config = DetectorConfig.from_dict({"peeling": {"min_chain_length": 4, "unknown": 1}})
    assert config.peeling.min_chain_length == 4 and config.peeling.max_gap_hours == 72.0
    assert DetectorConfig.from_dict(config.to_dict()) == config
