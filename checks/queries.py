"""One query per operator, each from the driver tables to a result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.files import FILES, new_folder, part_of, write_landing, write_order_files
from checks.text_rows import placed_text_rows, star_text_rows
from tallyscope.functions import text
from tallyscope.functions.prefix import median_gap, peak_overlap
from tallyscope.functions.staging import release, stage, staged_here
from tallyscope.operators import (
    activity,
    cocontrol,
    collection,
    context,
    evidence,
    features,
    graph,
    importing,
    model,
    normalize,
    peeling,
    profile,
    scoring,
    structure,
)
from tallyscope.plans import case_import, case_queries, evaluate
from tallyscope.plans.run import case_tables, run_analysis
from tallyscope.session import prepare
from tallyscope.settings import (
    DAY_US,
    FEATURE_ORDER,
    Anomaly,
    Collection,
    CommonControl,
    DetectorConfig,
    HighActivity,
    Peeling,
    SharedEndpoint,
    Structure,
)
from tallyscope.sources.formats import read_rows
from tallyscope.sources.scan import look
from tallyscope.sources.star_ledger import read_star_ledger, read_star_observations

LOOSE = Structure(min_inputs=2, min_outputs=2, min_equal_outputs=2)
COLLECT = Collection(window_hours=1440.0)
PEEL = Peeling(min_dominant_share=0.5, max_gap_hours=8760.0)
CONTROL = CommonControl(min_shared_transactions=3)
ACTIVE = HighActivity(activity_percentile=95.0, min_transactions=40)
RUN = DetectorConfig(collection=COLLECT, peeling=PEEL, common_control=CONTROL)

SCORED = DetectorConfig(collection=COLLECT, peeling=PEEL, common_control=CONTROL, anomaly=Anomaly(report_above_percentile=90.0),
                        high_volume=HighActivity(activity_percentile=50.0, min_transactions=20))

#: Features whose values are whole or one function of whole numbers, so two engines agree on ties.
PLAIN_FEATURES = ("tx_count", "incoming_tx_count", "outgoing_tx_count", "distinct_senders", "distinct_receivers", "distinct_counterparties",
                  "received_sats_log", "spent_sats_log", "repeated_co_input_partners", "max_tx_in_24h", "has_multiple_events")
#: A forest of three trees over eight points: tree, node, feature, threshold, left, right, size, depth.
SMALL_FOREST = (
    (0, 0, "tx_count", 20.0, 1, 2, 8, 0), (0, 1, None, 0.0, -1, -1, 5, 1), (0, 2, "received_sats_log", 18.5, 3, 4, 3, 1),
    (0, 3, None, 0.0, -1, -1, 2, 2), (0, 4, None, 0.0, -1, -1, 1, 2),
    (1, 0, "distinct_counterparties", 60.0, 1, 2, 8, 0), (1, 1, "outgoing_tx_count", 0.0, 3, 4, 7, 1), (1, 2, None, 0.0, -1, -1, 1, 1),
    (1, 3, None, 0.0, -1, -1, 4, 2), (1, 4, "tx_count", 90.0, 5, 6, 3, 2), (1, 5, None, 0.0, -1, -1, 2, 3), (1, 6, None, 0.0, -1, -1, 1, 3),
    (2, 0, None, 0.0, -1, -1, 8, 0),
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return run(prepare(spark), folder)

    QUERIES[run.__name__] = prepared
    return prepared


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return structure.mark_collaborative(read_star_ledger(spark, folder))


def _staged(spark: SparkSession, folder: str) -> DataFrame:
    return stage(_ledger(spark, folder), "ledger")


def _address_tx(ledger: DataFrame) -> DataFrame:
    return stage(activity.address_transactions(ledger), "address-tx")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Collaborative transactions with loose thresholds: scan, projection and filter."""
    marked = structure.mark_collaborative(read_star_ledger(spark, folder), LOOSE)
    return structure.coinjoin_like(marked, LOOSE).select(
        F.col("subject_id").alias("txid"), "input_count", "output_count", "equal_output_count", "denomination_sats")


# --- ledger view -----------------------------------------------------------------------
@query
def ledger_index(spark, folder):
    return activity.ledger_index(read_star_ledger(spark, folder)).select("txid", "ts_us", "tx_index")


@query
def ledger_entries(spark, folder):
    return activity.tx_io(read_star_ledger(spark, folder))


@query
def address_activity(spark, folder):
    return activity.address_activity(activity.address_transactions(read_star_ledger(spark, folder))).select(
        "address", "tx_count", "incoming_tx_count", "outgoing_tx_count", "received_sats", "spent_sats")


@query
def dominant_output(spark, folder):
    return _rounded(activity.dominant_outputs(read_star_ledger(spark, folder)))


@query
def coverage(spark, folder):
    return activity.coverage(read_star_ledger(spark, folder), read_star_observations(spark, folder))


@query
def endpoint_index(spark, folder):
    return activity.endpoint_index(read_star_observations(spark, folder))


@query
def address_endpoints(spark, folder):
    return graph.address_endpoints(
        read_star_ledger(spark, folder), activity.endpoint_index(read_star_observations(spark, folder)))


@query
def top_endpoints(spark, folder):
    return case_queries.top_endpoints(read_star_ledger(spark, folder), read_star_observations(spark, folder)).select(
        "address", "src_ip", "sightings", F.col("rank").cast("bigint").alias("rank"))


# --- validation ------------------------------------------------------------------------
def _normalized(spark, folder):
    return normalize.normalize_rows(placed_text_rows(spark, folder)[0])


@query
def norm_amounts(spark, folder):
    return _normalized(spark, folder).where("tx is not null").select(
        "row_number", "tx.total_in_sats", "tx.total_out_sats", "tx.fee_sats", "tx.residual_sats")


@query
def norm_status(spark, folder):
    return _normalized(spark, folder).select("row_number", "status", F.size("issues").cast("bigint").alias("n_issues"))


def _resolved(spark, folder):
    with staged_here() as made:
        rows = _normalized(spark, folder).drop("raw").withColumns({"dataset_id": F.lit("d"), "file": F.lit("f")})
    rows = stage(rows, "normalized")
    release(*made)
    return importing.resolve_duplicates(rows)


@query
def resolve_duplicates(spark, folder):
    return _resolved(spark, folder).select("row_number", "status", "repeat_sighting")


@query
def issue_counts(spark, folder):
    return importing.issue_counts(importing.validation_issues(_resolved(spark, folder))).select("code", "n")


@query
def import_summary(spark, folder):
    return importing.import_summary(_resolved(spark, folder)).select(
        "total_rows", "accepted_clean", "accepted_warning", "quarantined", "transactions_stored",
        "observations_stored", "reconciles")


# --- files -----------------------------------------------------------------------------
@query
def dataset_fingerprints(spark, folder):
    return look(spark, write_order_files(spark, folder)).select(
        part_of("path").alias("part"), "byte_size", "sha256", "format", "encoding", "delimiter", "newline", F.array_join("header", ";").alias("header"))


def _imported(spark, folder, kind):
    case = new_folder(spark, "case")
    case_import.import_ledger(spark, write_landing(spark, folder, kind), case)
    ledger, sightings = case_import.load_ledger(spark, case)
    seen = sightings.groupBy("txid").agg(F.count("*").alias("sightings"))
    return ledger.join(seen, "txid").select("txid", "total_in_sats", "total_out_sats", "fee_sats", "residual_sats", "input_count",
                                            "output_count", "quality_status", "sightings")


@query
def import_csv(spark, folder):
    return _imported(spark, folder, "csv")


@query
def import_json(spark, folder):
    return _imported(spark, folder, "json")


@query
def import_xml(spark, folder):
    return _imported(spark, folder, "xml")


@query
def import_retry(spark, folder):
    """Rows per case table after an attempt that died, a retry, an import of known files, and a clean-up."""
    landing, case = write_landing(spark, folder, "csv", FILES), new_folder(spark, "case")  # the result counts the files
    with staged_here() as made:
        lost = importing.import_rows(read_rows(spark, landing).withColumn("dataset_id", F.lit("ds_lost")))
        case_import.write_case_tables(lost, case)  # and no row in datasets
    release(*made)
    written = case_import.import_ledger(spark, landing, case)
    again = case_import.import_ledger(spark, landing, case)
    dropped = case_import.drop_abandoned(spark, case)
    counts = [case_import.load_table(spark, case, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"),
                                                            F.count_distinct("dataset_id").alias("datasets")) for name in case_import.TABLES]
    stored = [spark.read.parquet(f"{case}/{name}").agg(F.lit(f"{name} on disk").alias("name"), F.count("*").alias("rows"),
                                                       F.count_distinct("dataset_id").alias("datasets")) for name in case_import.TABLES]
    rounds = [df.agg(F.lit(name).alias("name"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("rows"), F.count("*").alias("datasets"))
              for name, df in (("retry", written), ("known files", again))]
    clean = spark.range(1).select(F.lit("dropped").alias("name"), F.lit(0).cast("bigint").alias("rows"), F.lit(dropped).cast("bigint").alias("datasets"))
    merged = clean
    for df in (*counts, *stored, *rounds):
        merged = merged.unionByName(df)
    return merged


@query
def profile_ledger(spark, folder):
    return profile.profile_ledger(star_text_rows(spark, folder)).select(
        "rows", "distinct_txids", "duplicated_txids", "length_mismatch_rows", "empty_element_rows",
        "repeated_address_rows", "residual_rows", "residual_rows_within_1", "max_abs_residual", "distinct_addresses")


@query
def value_histograms(spark, folder):
    return profile.value_histograms(star_text_rows(spark, folder))


# --- structure and co-spending ---------------------------------------------------------
@query
def equal_groups(spark, folder):
    return structure.equal_groups(read_star_ledger(spark, folder)).select(
        "txid", F.col("equal_output_count").cast("bigint").alias("equal_output_count"), "denomination_sats",
        F.col("denomination_group_count").cast("bigint").alias("denomination_group_count"))


@query
def coinjoin_like(spark, folder):
    return flagship(spark, folder)


@query
def equal_output_histogram(spark, folder):
    return profile.equal_output_histogram(read_star_ledger(spark, folder))


@query
def co_input_pairs(spark, folder):
    return cocontrol.co_input_pairs(_ledger(spark, folder), CONTROL.collaborative_input_threshold).select(
        "a", "b", "txid")


@query
def supported_pairs(spark, folder):
    pairs = cocontrol.co_input_pairs(_ledger(spark, folder), CONTROL.collaborative_input_threshold)
    return cocontrol.supported_pairs(pairs, CONTROL.min_shared_transactions)


@query
def excluded_transactions(spark, folder):
    return cocontrol.excluded_transactions(_ledger(spark, folder), CONTROL).select("txid", "reason")


def _clusters(spark, folder):
    ledger = _staged(spark, folder)
    pairs = cocontrol.co_input_pairs(ledger, CONTROL.collaborative_input_threshold)
    supported = stage(cocontrol.supported_pairs(pairs, CONTROL.min_shared_transactions), "pairs")
    return ledger, pairs, supported, stage(cocontrol.clusters(supported, CONTROL), "clusters")


@query
def clusters(spark, folder):
    return _clusters(spark, folder)[3].select("root", "address", "member_count")


def _hypotheses(spark, folder):
    ledger, pairs, supported, members = _clusters(spark, folder)
    support = cocontrol.cluster_support(pairs, supported, members)
    found = cocontrol.cluster_hypotheses(supported, support, members, cocontrol.excluded_transactions(ledger, CONTROL))
    return found, supported, members


@query
def cluster_hypotheses(spark, folder):
    return _hypotheses(spark, folder)[0].select(
        "root", "member_count", "inferred_edge_count", "strength", "supporting_transaction_count",
        "excluded_transactions", "start_us", "end_us")


@query
def cluster_edges(spark, folder):
    return cocontrol.cluster_edges(*_hypotheses(spark, folder)).select("source", "target", "support", "strength")


# --- features --------------------------------------------------------------------------
def _features(spark, folder):
    ledger = _staged(spark, folder)
    return features.address_features(features.address_profiles(ledger, _address_tx(ledger)))


@query
def features_counts(spark, folder):
    ledger = _ledger(spark, folder)
    totals = activity.address_activity(activity.address_transactions(ledger))
    return totals.join(activity.counterparties(ledger), "address", "left").select(
        "address", "tx_count", "incoming_tx_count", "outgoing_tx_count",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
          for c in ("distinct_senders", "distinct_receivers", "distinct_counterparties")])


@query
def features_values(spark, folder):
    frame = _features(spark, folder)
    return _rounded(frame.select(
        "address", "received_sats_log", "spent_sats_log", "mean_incoming_sats_log", "incoming_value_concentration",
        "mean_input_count", "mean_output_count", "equal_output_participation"))


@query
def features_time(spark, folder):
    frame = _features(spark, folder)
    return _rounded(frame.select(
        "address", "median_inter_event_hours", "activity_span_hours", "max_tx_in_24h", "has_multiple_events"))


@query
def features_partners(spark, folder):
    return cocontrol.repeated_partners(_ledger(spark, folder))


@query
def address_features(spark, folder):
    return _rounded(_features(spark, folder))


@query
def event_gaps(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return median_gap(events, ["user_id"])


@query
def event_peaks(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"))
    spans = events.withColumn("end_us", F.col("start_us") + DAY_US)
    return peak_overlap(spans, ["user_id", "event_type"])


# --- collection ------------------------------------------------------------------------
@query
def receive_events(spark, folder):
    return collection.receive_events(_ledger(spark, folder)).select("txid", "ts_us", "payer", "receiver")


def _best(ledger):
    events = collection.receive_events(ledger, collection.possible_collectors(ledger, COLLECT))
    with staged_here() as made:
        best = stage(collection.best_window(events, COLLECT), "best-window")
    release(*made[:-1])
    return best


@query
def best_window(spark, folder):
    return _best(_staged(spark, folder))


def _graded(spark, folder):
    ledger = _staged(spark, folder)
    address_tx = _address_tx(ledger)
    best = _best(ledger)
    events = collection.receive_events(ledger, best.select(F.col("receiver").alias("address")))
    with staged_here() as made:
        window = stage(collection.window_transactions(
            collection.window_payments(events, best, COLLECT), address_tx), "window-tx")
    release(best, *made[:-1])
    totals = activity.address_activity(address_tx)
    candidates = collection.collection_candidates(ledger, window, address_tx, totals, COLLECT)
    service = stage(_busy(ledger, address_tx).where("service_like_profile").select(
        F.col("subject_id").alias("address")), "service-like")
    return ledger, address_tx, collection.grade_collection(candidates, service, COLLECT)


@query
def collection_graded(spark, folder):
    graded = _graded(spark, folder)[2]
    return _rounded(graded.select(
        "address", "distinct_payers", "observed_span_hours", "contributing_transactions", "incoming_sats_in_window",
        "payment_amount_cv", "payments_similar_in_size", "inbound_concentration", "subsequent_outflow_sats",
        "subsequent_outflow_transactions", "distinct_outflow_destinations", "start_us", "end_us",
        "service_like_profile", F.col("severity")))


@query
def payment_participants(spark, folder):
    ledger, address_tx, graded = _graded(spark, folder)
    reported = collection.report_collection(stage(graded, "graded"), COLLECT)
    payments = collection.participant_payments(ledger, reported, address_tx)
    return collection.payment_participants(payments, reported).select(
        "subject_id", "collection_point", "payments_to_collection_point", "paid_sats", "start_us", "end_us")


# --- context ---------------------------------------------------------------------------
@query
def activity_cut(spark, folder):
    totals = activity.address_activity(activity.address_transactions(read_star_ledger(spark, folder)))
    return context.activity_cut(totals, 95.0)


def _busy(ledger, address_tx):
    profiles = stage(features.address_profiles(ledger, address_tx), "profiles")
    cut = context.activity_cut(profiles, ACTIVE.activity_percentile).first()[0]
    return context.high_activity(profiles, cut, ACTIVE)


@query
def high_activity(spark, folder):
    ledger = _staged(spark, folder)
    address_tx = stage(activity.address_transactions(ledger).drop("txid"), "address-tx")
    return _rounded(_busy(ledger, address_tx).select(
        "subject_id", "role_hypothesis", "transaction_count", "case_activity_percentile_cut", "distinct_counterparties",
        "distinct_senders", "distinct_receivers", "reciprocal_counterparties", "reciprocity_ratio", "flow_balance",
        "activity_span_hours", "median_gap_hours", "service_like_profile"))


@query
def shared_endpoint(spark, folder):
    endpoints = activity.endpoint_index(read_star_observations(spark, folder))
    return context.shared_ip(endpoints, read_star_ledger(spark, folder), SharedEndpoint()).select(
        "endpoint", "subject_id", "observation_count", "distinct_addresses_observed", "addresses_seen_at_endpoint",
        "looks_like_shared_infrastructure")


@query
def shared_endpoint_addresses(spark, folder):
    endpoints = activity.endpoint_index(read_star_observations(spark, folder))
    ledger = read_star_ledger(spark, folder)
    return context.shared_ip_addresses(context.shared_ip(endpoints, ledger, SharedEndpoint()), endpoints, ledger)


# --- peeling ---------------------------------------------------------------------------
@query
def next_hop(spark, folder):
    ledger = _staged(spark, folder)
    spends = activity.address_transactions(ledger).where("spends")
    return peeling.next_hop(peeling.peel_steps(ledger, PEEL), spends, PEEL.max_gap_hours).select(
        "txid", "address", "next_txid", "next_us")


def _hops(spark, folder):
    ledger = _staged(spark, folder)
    chains = peeling.peel_chains(ledger, activity.address_transactions(ledger), PEEL)
    return peeling.peel_hops(chains, ledger)


@query
def peel_chains(spark, folder):
    return _hops(spark, folder).select("chain", "hop", "txid", "address", "amount_sats", "share", "gap_hours")


@query
def peel_findings(spark, folder):
    return peeling.peel_findings(stage(_hops(spark, folder), "peel-hops"), PEEL).select(
        "subject_id", "context_id", "role_hypothesis", "severity", "hop_count", "side_recipient_count", "min_share",
        "max_share", "total_peeled_off_sats", "subject_position")


# --- model -----------------------------------------------------------------------------
@query
def feature_quantiles(spark, folder):
    return _rounded(model.feature_quantiles(stage(_features(spark, folder), "features"), 101).select(
        "feature", F.col("level").cast("bigint").alias("level"), "value"))


@query
def percentile_rank(spark, folder):
    totals = stage(activity.address_activity(activity.address_transactions(read_star_ledger(spark, folder))), "totals")
    reference = totals.groupBy(F.col("received_sats").alias("score")).agg(F.count("*").alias("weight"))
    values = totals.select("address", "spent_sats")
    return _rounded(model.percentile_rank(values, reference, "spent_sats"))


@query
def anomaly_scores(spark, folder):
    frame = stage(_features(spark, folder), "features")
    return model.score_addresses(frame, model.fit_model(frame))[0]


@query
def normal_scores(spark, folder):
    frame = stage(_features(spark, folder), "features")
    scaled = model.quantile_normal(model.impute_constant(frame), stage(model.feature_quantiles(frame, 101), "quantiles"))
    return scaled.unpivot("address", list(PLAIN_FEATURES), "feature", "score").withColumn("score", F.round("score", 6))


@query
def fixed_forest_scores(spark, folder):
    nodes = spark.createDataFrame(
        [(t, n, FEATURE_ORDER.index(f) if f else -1, *rest) for t, n, f, *rest in SMALL_FOREST], model.NODE_SCHEMA)
    return _rounded(model.anomaly_scores(model.impute_constant(_features(spark, folder)), nodes, 8, 3), 9)


# --- scoring ---------------------------------------------------------------------------
def _priorities(spark, folder):
    ledger = _staged(spark, folder)
    totals = stage(activity.address_activity(_address_tx(ledger)), "totals")
    reference = totals.groupBy(F.col("tx_count").alias("score")).agg(F.count("*").alias("weight"))
    ranked = model.percentile_rank(totals, reference, "tx_count")
    partners = cocontrol.repeated_partners(ledger)
    severity = F.when(F.col("repeated_co_input_partners") > 0, 40.0).otherwise(0.0)
    return ranked.join(partners, "address", "left").withColumn("severity", severity)


@query
def review_priority(spark, folder):
    busy = F.col("tx_count") >= 100
    blended = scoring.blended_priority(F.col("severity"), F.col("anomaly_percentile"), busy)
    return _rounded(_priorities(spark, folder).select(
        "address", "severity", blended.alias("priority"), scoring.priority_band(blended).alias("priority_band"),
        scoring.evidence_strength(F.col("tx_count"), F.col("spent_sats") > F.col("received_sats"),
                                  F.col("severity") == 0).alias("evidence_strength")))


@query
def sensitivity(spark, folder):
    alerts = _priorities(spark, folder).withColumn(
        "blended", scoring.blended_priority(F.col("severity"), F.col("anomaly_percentile")))
    alerts = alerts.select(F.col("address").alias("alert_id"), "severity", "anomaly_percentile",
                           F.round("blended", 2).alias("priority"),
                           scoring.priority_band(F.col("blended")).alias("priority_band"))
    return scoring.sensitivity(alerts, drop_model=True).select(
        "alert_id", "revised_priority", "revised_band")


@query
def project_tx_patterns(spark, folder):
    ledger = structure.mark_collaborative(read_star_ledger(spark, folder), LOOSE)
    tagged = ledger.where("collaborative").select(
        F.col("txid").alias("subject_id"), F.lit("transaction").alias("subject_type"),
        F.lit("coinjoin_like").alias("detector"))
    return scoring.project_tx_patterns(tagged, ledger).select(
        "address", F.array_join("transaction_patterns", ",").alias("transaction_patterns"))


def _run(spark, folder):
    return run_analysis(read_star_ledger(spark, folder), read_star_observations(spark, folder), RUN, None, "check")


@query
def alerts(spark, folder):
    return _run(spark, folder).alerts.select(
        "alert_id", "subject_type", "subject_id", "pattern", "role_hypothesis", "priority", "priority_band",
        "evidence_strength")


@query
def predictions(spark, folder):
    return _run(spark, folder).predictions.select(
        "address", "scored", F.array_join("patterns", ",").alias("patterns"),
        F.array_join("transaction_patterns", ",").alias("transaction_patterns"), "review_priority", "raised_alert",
        F.array_join("roles", ",").alias("roles"))


def _scored_run(spark, folder):
    made = case_tables(read_star_ledger(spark, folder), SCORED)
    totals = activity.address_activity(made[1])
    scores = totals.select("address", F.when(
        F.col("tx_count") % 13 != 0, (F.col("tx_count") - 1000 * F.col("outgoing_tx_count")).cast("double")).alias("anomaly_score"))
    return run_analysis(made[0], read_star_observations(spark, folder), SCORED, model.freeze_scores(scores), "check", made)


@query
def alerts_scored(spark, folder):
    held = F.get_json_object("priority_components", "$.suppression").isNotNull()
    return _rounded(_scored_run(spark, folder).alerts.select(
        "alert_id", "subject_id", "pattern", "priority", "priority_band", "evidence_strength", "anomaly_percentile", held.alias("suppressed")))


@query
def predictions_scored(spark, folder):
    return _rounded(_scored_run(spark, folder).predictions.select(
        "address", "scored", "anomaly_percentile", F.array_join("patterns", ",").alias("patterns"), "review_priority", "raised_alert",
        F.array_join("roles", ",").alias("roles")))


@query
def run_statistics(spark, folder):
    return _run(spark, folder).stats.select(
        "transactions", "addresses", "observations", "alerts_total", "addresses_unscored", "collaborative_transactions_excluded",
        "cluster_hypotheses", "collection_candidates", "collection_reported", "collection_below_threshold")


# --- graph -----------------------------------------------------------------------------
@query
def graph_nodes(spark, folder):
    ledger = read_star_ledger(spark, folder)
    totals = activity.address_activity(activity.address_transactions(ledger))
    return graph.graph_nodes(ledger, totals, read_star_observations(spark, folder)).select(
        "id", "kind", "label", "received_sats", "tx_count", "total_out_sats", "fee_sats")


@query
def graph_edges(spark, folder):
    return graph.graph_edges(read_star_ledger(spark, folder), read_star_observations(spark, folder)).select(
        "source", "target", "key", "kind", "amount_sats")


def _view(spark, folder):
    edges = graph.graph_edges(read_star_ledger(spark, folder), read_star_observations(spark, folder))
    return graph.neighbourhood(stage(edges, "edges"), ["addr:A0", "addr:nobody"], hops=2, node_budget=300)


@query
def neighbourhood(spark, folder):
    return _view(spark, folder).nodes.select("id", "hop", "rank")


@query
def neighbourhood_edges(spark, folder):
    return _view(spark, folder).edges.select("source", "target", "key", "kind")


# --- evaluation ------------------------------------------------------------------------
def _judged(spark, folder):
    """Predictions from documents and truth from labels, so both sides grow with the tables."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    long = F.col("n_chars") > 1000
    none = F.array().cast("array<string>")
    predictions = docs.select(
        F.col("doc_id").cast("string").alias("address"),
        F.when(F.col("lang") != "en", F.col("n_chars").cast("double")).alias("anomaly_percentile"),
        (F.col("lang") != "en").alias("scored"),
        F.when(long, F.array(F.lit("peeling_sequence"))).otherwise(none).alias("patterns"),
        F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("shared_ip_observation"))).otherwise(none)
        .alias("transaction_patterns"),
        F.col("n_chars").cast("double").alias("review_priority"),
        F.array("lang").alias("roles"))
    truth = labels.select(
        F.col("doc_id").cast("string").alias("wallet_id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("quality").cast("string")).alias("is_suspicious"),
        F.concat(F.lit("toxic_"), F.col("toxic").cast("string")).alias("pattern_type"))
    return predictions, truth


@query
def join_coverage(spark, folder):
    return evaluate.join_coverage(*_judged(spark, folder))


@query
def confusion(spark, folder):
    return _rounded(evaluate.confusion(evaluate.joined(*_judged(spark, folder))))


@query
def predicted_patterns(spark, folder):
    return evaluate.predicted_patterns(evaluate.joined(*_judged(spark, folder)))


@query
def average_precision(spark, folder):
    return _rounded(evaluate.average_precision(evaluate.ranking_variants(evaluate.joined(*_judged(spark, folder)))))


@query
def precision_at_k(spark, folder):
    ranked = evaluate.ranking_variants(evaluate.joined(*_judged(spark, folder)))
    return _rounded(evaluate.precision_at_k(ranked).select(
        "variant", F.col("k").cast("bigint").alias("k"), "hits", "denominator", "precision"))


@query
def per_pattern(spark, folder):
    return _rounded(evaluate.per_pattern(evaluate.joined(*_judged(spark, folder))))


@query
def per_role(spark, folder):
    return evaluate.per_role(evaluate.joined(*_judged(spark, folder)))


def _customer_truth(spark, folder):
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("wallet_id"),
        F.when(F.col("c_acctbal") < 0, "1").otherwise("0").alias("is_suspicious"),
        F.col("c_mktsegment").alias("pattern_type"))


@query
def profile_truth(spark, folder):
    return profile.profile_truth(
        _customer_truth(spark, folder), activity.tx_io(read_star_ledger(spark, folder)).select("address"))


@query
def truth_counts(spark, folder):
    return profile.truth_counts(_customer_truth(spark, folder))


@query
def pattern_endpoints(spark, folder):
    return profile.pattern_endpoints(
        _customer_truth(spark, folder), read_star_ledger(spark, folder), read_star_observations(spark, folder), "BUILDING")


@query
def pattern_touch_counts(spark, folder):
    return profile.pattern_touch_counts(_customer_truth(spark, folder), read_star_ledger(spark, folder))


# --- case queries ----------------------------------------------------------------------
def _inbox(spark, folder):
    """Events read as alerts, so the case queries run over a table that grows."""
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id").cast("string").alias("alert_id"), F.col("user_id").cast("string").alias("subject_id"),
        F.col("event_type").alias("pattern"), F.lit("").alias("context_id"), F.col("value").alias("priority"),
        scoring.priority_band(F.col("value")).alias("priority_band"),
        F.when(F.col("value") > 50, "medium").otherwise("low").alias("evidence_strength"),
        F.lit("new").alias("review_state"),
        F.concat(F.lit("role_"), F.col("event_type")).alias("role_hypothesis"))


@query
def alerts_for_address(spark, folder):
    inbox = _inbox(spark, folder).withColumn("pattern_label", F.upper("pattern"))
    return case_queries.alerts_for_address(inbox, "1").select("alert_id", "pattern", "pattern_label", "priority", "priority_band")


@query
def alert_facets(spark, folder):
    return case_queries.alert_facets(_inbox(spark, folder))


@query
def list_alerts(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    records = events.select(
        F.col("event_type").alias("detector"), F.col("user_id").cast("string").alias("subject_id"),
        F.lit("").alias("context_id"), F.lit("observation").alias("kind"))
    page = case_queries.list_alerts(_inbox(spark, folder), records, limit=50, offset=10, pattern="click", subject="1")
    return page.select("alert_id", "subject_id", "priority", "priority_band", "evidence_count")


@query
def review_state(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    reviews = events.select(
        F.col("user_id").cast("string").alias("alert_id"), F.col("event_type").alias("to_state"),
        F.col("ts").alias("at"), "event_id")
    subjects = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("alert_id"), F.lit("new").alias("review_state"))
    return case_queries.current_review_state(subjects, reviews)


@query
def case_overview(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    cases = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("updated_at"))
    datasets = orders.select(F.col("o_custkey").alias("case_id"))
    runs = orders.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("finished_at"))
    found = spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias("case_id"))
    return case_queries.case_overview(cases, datasets, runs, found).select(
        "case_id", "dataset_count", "run_count", "alert_count", "latest_run_id")


def _star_case(spark, folder):
    """(datasets, source_rows, issues): customers as files, their orders as rows, the lines of these as issues."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("dataset_id"), F.col("o_orderkey").alias("row_number"),
        F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "accepted_warning").otherwise("quarantined").alias("status"),
        F.to_json(F.struct("o_orderpriority")).alias("payload"))
    n_of = lambda status: F.count(F.when(F.col("status") == status, 1))
    totals = rows.groupBy("dataset_id").agg(
        F.count("*").alias("total_rows"), n_of("accepted").alias("accepted_clean"), n_of("accepted_warning").alias("accepted_warning"),
        n_of("quarantined").alias("quarantined"))
    files = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_name").alias("file"), F.sha2("c_name", 256).alias("sha256"))
    issues = spark.read.parquet(f"{folder}/lineitem.parquet").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("dataset_id"), F.col("l_orderkey").alias("row_number"), F.col("l_linenumber").alias("ordinal"),
        F.col("l_returnflag").alias("code"), F.lit("warning").alias("severity"), F.col("l_linestatus").alias("field"),
        F.col("l_partkey").cast("string").alias("message"))
    return files.join(totals, "dataset_id"), rows, issues


@query
def dataset_detail(spark, folder):
    datasets, _, issues = _star_case(spark, folder)
    listed = F.transform(F.array_sort(F.map_entries("issue_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return case_queries.dataset_detail(datasets, issues).select(
        "dataset_id", "file", "total_rows", "accepted_clean", "accepted_warning", "quarantined", "reconciles",
        F.array_join(listed, ",").alias("issue_counts"))


@query
def list_issues(spark, folder):
    _, _, issues = _star_case(spark, folder)
    return case_queries.list_issues(issues, "1", code="R", limit=20, offset=2).select("row_number", "ordinal", "code", "message")


@query
def list_source_rows(spark, folder):
    _, rows, _ = _star_case(spark, folder)
    return case_queries.list_source_rows(rows, "1", status="accepted", limit=10)


@query
def trace_source_row(spark, folder):
    datasets, rows, issues = _star_case(spark, folder)
    return case_queries.trace_source_row(rows, datasets, issues, "1", _first_order(spark, folder)).select(
        "dataset_id", "row_number", "file", "sha256", "status",
        F.array_join(F.transform("issues", lambda i: F.concat_ws("/", i["ordinal"].cast("string"), i["code"], i["field"], i["message"])), ",").alias("issues"))


def _first_order(spark, folder):
    """The smallest order of customer 1, whose row is traced."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_custkey = 1")
    return orders.agg(F.min("o_orderkey").alias("k")).first()["k"]


@query
def alert_detail(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    inbox = _inbox(spark, folder)
    of_user = events.where("user_id = 1").agg(F.min("event_id").cast("string").alias("id")).first()["id"] or ""
    notes = events.select(F.col("user_id").cast("string").alias("alert_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("author"),
                          F.col("event_id").cast("string").alias("body")).withColumn("alert_id", F.when(F.col("alert_id") == "1", of_user))
    reviews = notes.select("alert_id", F.col("created_at").alias("at"), F.col("author").alias("actor"), F.lit("new").alias("from_state"),
                           F.col("author").alias("to_state"), F.col("body").alias("reason"))
    records = events.select(
        F.col("event_type").alias("detector"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("subject_id"),
        F.lit("").alias("context_id"), F.lit("observation").alias("kind"), F.col("event_id").cast("string").alias("txid"),
        F.col("event_id").alias("row_number"), F.col("props").alias("detail"))
    scores = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("address"), F.col("c_acctbal").alias("anomaly_score"), F.lit(50.0).alias("anomaly_percentile"),
        F.lit(None).cast("string").alias("unscored_reason"))
    detail, support = case_queries.alert_detail(inbox, records, scores, notes, reviews, of_user)
    return detail.select(
        "alert_id", "subject_id", "pattern", F.col("address_score.anomaly_score").alias("anomaly_score"),
        F.array_join(F.transform("notes", lambda n: n["body"]), ",").alias("notes"),
        F.array_join(F.transform("review_history", lambda r: r["to_state"]), ",").alias("states")).join(
        support.select("alert_id", "txid"), "alert_id")


@query
def case_audit(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("case_id", F.col("user_id").cast("string"))
    return case_queries.case_audit(events, "1").select("event_id", "case_id", "event_type")


# --- evidence, histories, inferred edges -----------------------------------------------
@query
def coinjoin_evidence(spark, folder):
    ledger = read_star_ledger(spark, folder)
    rows = evidence.with_row_numbers(evidence.coinjoin_evidence(structure.mark_collaborative(ledger, LOOSE)), ledger)
    value = lambda path: F.get_json_object("detail", path)
    return rows.select(
        "detector", "subject_id", "txid", "row_number", value("$.input_count").cast("int").alias("input_count"),
        value("$.output_addresses[0]").alias("first_output"), value("$.output_amounts_sats[0]").cast("bigint").alias("first_output_sats"))


@query
def peel_evidence(spark, folder):
    rows = evidence.with_row_numbers(evidence.peel_evidence(_hops(spark, folder)), read_star_ledger(spark, folder))
    value = lambda path: F.get_json_object("detail", path)
    return rows.select(
        "context_id", "txid", "row_number", value("$.hop").cast("bigint").alias("hop"),
        value("$.dominant_output_address").alias("address"), value("$.dominant_output_sats").cast("bigint").alias("amount_sats"),
        F.size(F.from_json(value("$.side_outputs"), "array<string>")).alias("side_outputs"))


@query
def overlay_edges(spark, folder):
    supplied = graph.graph_edges(read_star_ledger(spark, folder), read_star_observations(spark, folder))
    inferred = peeling.continuity_edges(stage(_hops(spark, folder), "peel-hops"), "check")
    return graph.overlay_inferred_edges(supplied.withColumns({"rule_version": F.lit(None).cast("string"), "support": F.lit(None).cast("bigint")}),
                                        inferred.drop("strength")).select("source", "target", "key", "kind", "support")


@query
def decorated_view(spark, folder):
    view, ledger = _view(spark, folder), read_star_ledger(spark, folder)
    totals = stage(activity.address_activity(activity.address_transactions(ledger)), "totals")
    shown, _ = graph.graph_payload(view, graph.graph_nodes(ledger, totals, read_star_observations(spark, folder)))
    scores = totals.where("tx_count > 5").select(
        "address", F.col("tx_count").cast("double").alias("anomaly_percentile"), F.when(F.col("tx_count") % 2 == 0, 0.5).alias("anomaly_score"))
    found = _inbox(spark, folder).withColumn("subject_id", F.concat(F.lit("A"), "subject_id"))
    return graph.decorate_graph(shown, scores, found).select(
        "id", "hop", "rank", "kind", "label", F.col("score.anomaly_percentile").alias("anomaly_percentile"), F.col("score.scored").alias("scored"),
        F.col("alert.pattern").alias("pattern"), F.col("alert.priority").alias("priority"), F.col("alert.band").alias("band"))


@query
def view_edges(spark, folder):
    view = _view(spark, folder)
    return graph.graph_payload(view, view.nodes.select("id"))[1].select("id", "kind", "inferred")


@query
def address_history(spark, folder):
    ledger = read_star_ledger(spark, folder)
    return case_queries.address_transactions(activity.address_transactions(ledger), ledger, "A0").select(
        "txid", "row_number", "direction", "input_count", "output_count", "amount_sats")


@query
def address_totals(spark, folder):
    totals = activity.address_activity(activity.address_transactions(read_star_ledger(spark, folder)))
    return case_queries.address_summary(totals, "A0").select(
        "address", "transaction_count", "received_sats", "spent_sats", "incoming_transactions", "outgoing_transactions",
        F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query
def amount_discrepancies(spark, folder):
    stated = F.col("fee_sats") + F.col("row_number") % 3 - 1
    ledger = read_star_ledger(spark, folder).withColumn("fee_sats", stated).withColumn(
        "residual_sats", F.col("total_in_sats") - F.col("total_out_sats") - F.col("fee_sats"))
    return activity.amount_discrepancies(ledger)


@query
def instants(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    spelled = lambda pattern: F.date_format("ts", pattern)
    ways = [spelled("yyyy-MM-dd HH:mm:ss"), spelled("yyyy-MM-dd'T'HH:mm:ss'Z'"), spelled("yyyyMMdd'T'HHmmss"),
            F.concat(spelled("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30")), spelled("yyyy-MM-dd HH:mm"), spelled("yyyy-MM-dd HH:mm:ss,SSS"),
            spelled("yyyy/MM/dd HH:mm:ss"), F.concat(spelled("yyyy-MM-dd HH:mm:ss"), F.lit("-0145"))]
    way = (F.col("event_id") % len(ways)).cast("int")
    return events.select("event_id", F.unix_micros(text.parse_instant(F.get(F.array(*ways), way))).alias("instant_us"))


@query
def canonical_ips(spark, folder):
    n = F.col("event_id")
    ways = [F.concat(F.lit("10."), (n % 300).cast("string"), F.lit(".0.1")), F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(n % 65536)),
            F.concat(F.lit("010.0.0."), (n % 200).cast("string")), F.concat(F.lit("host:"), n.cast("string"))]
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", text.canonical_ip(F.get(F.array(*ways), (n % len(ways)).cast("int"))).alias("ip"))
