"""Collection points and the addresses that paid them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.functions import entries
from tallyscope.functions.prefix import peak_overlap
from tallyscope.functions.sieve import mark_possible
from tallyscope.functions.staging import stage
from tallyscope.functions.text import packed, unpacked
from tallyscope.operators.activity import payer_receiver_pairs
from tallyscope.settings import RULE_SEVERITY, SERVICE_LIKE_CEILING, Collection, hours_us


def possible_collectors(marked: DataFrame, config: Collection) -> DataFrame:
    """Addresses whose receipts could reach the payer floor at all.

    The payers of each receipt are counted with repeats, which can only overstate the distinct
    count, so no collector is lost; the long tail leaves before payments are expanded.
    """
    return (
        marked.where("not collaborative")
        .select(F.explode(entries.distinct_addresses("outputs")).alias("address"),
                F.size(entries.distinct_addresses("inputs")).alias("n"))
        .groupBy("address").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= config.min_distinct_payers)
        .select("address")
    )


def receive_events(marked: DataFrame, receivers: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(receiver, ts_us, payer, txid): non-collaborative payments, self-payments left out."""
    return payer_receiver_pairs(marked.where("not collaborative"), receivers=receivers, few=few)


def payer_stretches(events: DataFrame, config: Collection) -> DataFrame:
    """(receiver, start_us, end_us): when a payer counts, without overlap per payer.

    A payer counts at instant T while its latest payment is at most one window old. When all its
    payments to a receiver lie within one window, that is one stretch from the first payment to
    one window after the last, found by a hash aggregate; this covers one-off payers. Only payers
    active for longer are walked payment by payment, inside (receiver, payer, time bucket); a
    copy of each bucket's first payment closes the bucket before it.
    """
    window = hours_us(config.window_hours)
    width = 4 * max(window, 1)
    key = ["receiver", "payer"]
    spans = events.groupBy(*key).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    brief = F.col("last_us") - F.col("first_us") <= window
    short = spans.where(brief).select(
        "receiver", F.col("first_us").alias("start_us"), (F.col("last_us") + window).alias("end_us"))
    points = (
        events.join(spans.where(~brief).select(*key), key, "left_semi")
        .select(*key, F.col("ts_us").alias("at"), F.expr(f"ts_us div {width}").alias("bucket")).distinct()
    )
    guards = (
        points.groupBy(*key, "bucket").agg(F.min("at").alias("at"))
        .select(*key, "at", (F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("guard"))
    )
    after = W.partitionBy(*key, "bucket").orderBy("at")
    walked = (
        points.withColumn("guard", F.lit(False)).unionByName(guards)
        .withColumn("next_at", F.lead("at").over(after))
        .where("not guard")
        .select("receiver", F.col("at").alias("start_us"),
                F.least(F.col("at") + window, F.col("next_at") - 1).alias("end_us"))
    )
    return short.unionByName(walked)


def best_window(events: DataFrame, config: Collection) -> DataFrame:
    """Most distinct payers in any inclusive window per receiver, and when it is first reached."""
    return (
        peak_overlap(stage(payer_stretches(events, config), "payer-stretches"), ["receiver"])
        .where(F.col("peak") >= config.min_distinct_payers)
        .select("receiver", F.col("peak").alias("distinct_payers"), "peak_us")
    )


def window_payments(events: DataFrame, best: DataFrame, config: Collection) -> DataFrame:
    """The payments inside each receiver's best window.

    Payments at the closing instant count only up to the one that completed the payer set, in
    (payer, txid) order. A payer that completes the set has no payment before that instant, so only
    identifiers of that instant are compared. What lies in a window is little beside all payments and is
    read twice, so it is staged.
    """
    window = hours_us(config.window_hours)
    inside = stage(events.join(best, "receiver").where(
        (F.col("ts_us") <= F.col("peak_us")) & (F.col("ts_us") >= F.col("peak_us") - window)), "window-payments")
    closing = (
        inside.groupBy("receiver", "payer", "peak_us")
        .agg(F.min("ts_us").alias("ts_us"), F.min(F.when(F.col("ts_us") == F.col("peak_us"), F.col("txid"))).alias("txid"))
        .where("ts_us = peak_us")
        .groupBy("receiver").agg(F.max(F.struct("payer", "txid")).alias("closing"))
    )
    return inside.join(closing, "receiver").where(
        (F.col("ts_us") < F.col("peak_us")) | (F.struct("payer", "txid") <= F.col("closing"))
    ).select("receiver", "distinct_payers", "payer", "txid", "ts_us", "discrepancy")


def window_transactions(payments: DataFrame, address_tx: DataFrame) -> DataFrame:
    """Distinct transactions of the window with the amount each paid to the receiver."""
    tx = payments.select("receiver", "distinct_payers", packed(F.col("txid")).alias("tx"), "ts_us", "discrepancy").distinct()
    return tx.join(_receipts(address_tx), ["receiver", "tx"]).select(
        "receiver", unpacked(F.col("tx")).alias("txid"), "distinct_payers", "ts_us", "discrepancy", "received_sats")


def _receipts(address_tx: DataFrame) -> DataFrame:
    return address_tx.where("receives").select(F.col("address").alias("receiver"), packed(F.col("txid")).alias("tx"), "received_sats")


def collection_candidates(marked: DataFrame, window_tx: DataFrame, address_tx: DataFrame,
                          activity: DataFrame, config: Collection) -> DataFrame:
    """Measured values of every receiver that clears the payer floor."""
    measured = window_tx.groupBy("receiver").agg(
        F.max("distinct_payers").alias("distinct_payers"),
        F.count("*").alias("contributing_transactions"),
        F.sum("received_sats").alias("incoming_sats_in_window"),
        F.avg("received_sats").alias("mean_payment"),
        F.stddev_pop("received_sats").alias("spread"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.bool_or("discrepancy").alias("amount_quality_affected"),
    )
    starts = measured.select(F.col("receiver").alias("address"), "start_us")
    outflow = (
        address_tx.where("spends").join(starts, "address").where("ts_us >= start_us")
        .groupBy(F.col("address").alias("receiver"))
        .agg(F.sum("spent_sats").alias("subsequent_outflow_sats"),
             F.count("*").alias("subsequent_outflow_transactions"))
    )
    destinations = (
        payer_receiver_pairs(marked, payers=starts)
        .select("ts_us", F.col("payer").alias("address"), F.col("receiver").alias("destination"))
        .join(starts, "address").where("ts_us >= start_us")
        .select("address", "destination").distinct()
        .groupBy(F.col("address").alias("receiver"))
        .agg(F.count("*").alias("distinct_outflow_destinations"))
    )
    receipts = activity.select(F.col("address").alias("receiver"), "incoming_tx_count")
    zero = F.lit(0).cast("bigint")
    cv = F.when((F.col("contributing_transactions") > 1) & (F.col("mean_payment") != 0),
                F.col("spread") / F.col("mean_payment")).otherwise(F.lit(0.0))
    return (
        measured.join(receipts, "receiver").join(outflow, "receiver", "left")
        .join(destinations, "receiver", "left").withColumn("cv", cv)
        .select(
            F.col("receiver").alias("address"),
            "distinct_payers",
            F.lit(float(config.window_hours)).alias("window_hours"),
            F.bround((F.col("end_us") - F.col("start_us")) / F.lit(3.6e9), 2).alias("observed_span_hours"),
            "contributing_transactions",
            "incoming_sats_in_window",
            F.bround("mean_payment", 2).alias("mean_payment_sats"),
            F.bround("cv", 4).alias("payment_amount_cv"),
            ((F.col("cv") != 0) & (F.col("cv") <= config.similar_amount_cv)).alias("payments_similar_in_size"),
            F.bround(F.col("contributing_transactions") / F.col("incoming_tx_count"), 4)
            .alias("inbound_concentration"),
            F.coalesce("subsequent_outflow_sats", zero).alias("subsequent_outflow_sats"),
            F.coalesce("subsequent_outflow_transactions", zero).alias("subsequent_outflow_transactions"),
            F.coalesce("distinct_outflow_destinations", zero).alias("distinct_outflow_destinations"),
            F.lit(config.min_distinct_payers).alias("min_distinct_payers_threshold"),
            "start_us",
            "end_us",
            "amount_quality_affected",
        )
    )


def grade_collection(candidates: DataFrame, service_like: DataFrame, config: Collection) -> DataFrame:
    """Add ``service_like_profile``, ``graded_severity`` and the parts that made it up."""
    known = service_like.select("address", F.lit(True).alias("service_like_profile"))
    df = candidates.join(known, "address", "left").withColumn(
        "service_like_profile", F.coalesce("service_like_profile", F.lit(False)))
    ratio = F.col("distinct_payers") / F.lit(float(max(1, config.min_distinct_payers)))
    base = F.least(F.lit(60.0), F.greatest(F.lit(0.0), 20.0 * F.log2(ratio) + 20.0))
    enough = F.col("contributing_transactions") >= config.min_transactions_for_corroboration
    similar = enough & F.col("payments_similar_in_size")
    burst = enough & (F.col("observed_span_hours") <= config.window_hours / 3.0)
    onward = (
        enough & (F.col("incoming_sats_in_window") > 0)
        & (F.col("subsequent_outflow_sats") >= config.onward_movement_ratio * F.col("incoming_sats_in_window"))
        & (F.col("distinct_outflow_destinations") <= config.concentrated_outflow_destinations)
    )
    focused = enough & (F.col("inbound_concentration") >= 0.8)
    points = lambda test, value: F.when(test, value).otherwise(0.0)
    raw = F.least(
        F.lit(RULE_SEVERITY["collection_pattern"]),
        F.col("base") + points(similar, 8.0) + points(burst, 7.0) + points(onward, 10.0) + points(focused, 5.0))
    final = F.when(F.col("service_like_profile"), F.least("uncapped", F.lit(SERVICE_LIKE_CEILING))).otherwise(
        F.col("uncapped"))
    reasons = F.array_compact(F.array(
        F.format_string("Base %.0f from %d payers (floor %d).", "base", "distinct_payers",
                        F.lit(config.min_distinct_payers)),
        F.when(~enough, F.format_string("No corroboration: %d contributing transactions, %d needed.",
                                        "contributing_transactions",
                                        F.lit(config.min_transactions_for_corroboration))),
        F.when(similar, F.lit("+8 similar payment sizes.")),
        F.when(burst, F.format_string("+7 all payments within %.1f hours.", "observed_span_hours")),
        F.when(onward, F.format_string("+10 value moved on to %d destinations.", "distinct_outflow_destinations")),
        F.when(focused, F.format_string("+5 window holds %.0f%% of incoming activity.",
                                        F.col("inbound_concentration") * 100)),
        F.when(F.col("service_like_profile"),
               F.format_string("Service-like profile: held at %.0f (was %.0f).", "severity", "uncapped"))
        .otherwise(F.format_string("Final severity %.0f.", "severity")),
    ))
    return (
        df.withColumn("base", base).withColumn("uncapped", raw).withColumn("severity", final)
        .withColumn("graded_severity", F.bround("severity", 2))
        .withColumn("severity_breakdown", reasons)
        .drop("base", "uncapped")
    )


def report_collection(graded: DataFrame, config: Collection) -> DataFrame:
    """Collection points at or above the reporting bar, in the common finding shape."""
    return graded.where(F.col("severity") >= config.min_report_severity).select(
        F.col("address").alias("subject_id"),
        F.lit("").alias("context_id"),
        F.lit("collection_point").alias("role_hypothesis"),
        "severity",
        "start_us",
        "end_us",
        F.col("contributing_transactions").alias("independent_supports"),
        "amount_quality_affected",
        "distinct_payers",
        "window_hours",
        "observed_span_hours",
        "contributing_transactions",
        "incoming_sats_in_window",
        "mean_payment_sats",
        "payment_amount_cv",
        "payments_similar_in_size",
        "inbound_concentration",
        "subsequent_outflow_sats",
        "subsequent_outflow_transactions",
        "distinct_outflow_destinations",
        "min_distinct_payers_threshold",
        "service_like_profile",
        "graded_severity",
        "severity_breakdown",
    )


def collection_counts(graded: DataFrame, config: Collection) -> DataFrame:
    """One row: candidates, reported and below the bar."""
    kept = F.col("severity") >= config.min_report_severity
    return graded.agg(
        F.count("*").alias("collection_candidates"),
        F.count_if(kept).alias("collection_reported"),
        F.count_if(~kept).alias("collection_below_threshold"),
    )


def participant_payments(marked: DataFrame, reported: DataFrame, address_tx: DataFrame) -> DataFrame:
    """Every payment to a reported collection point, not only those in its window."""
    points = reported.select(F.col("subject_id").alias("address"))
    receipts = mark_possible(_receipts(address_tx), F.col("receiver"), points, "address", "_possible").where("_possible").drop("_possible")
    paid = receive_events(marked, receivers=points, few=True).withColumn("tx", packed(F.col("txid"))).drop("txid")
    return paid.join(receipts, ["receiver", "tx"]).select(
        "receiver", unpacked(F.col("tx")).alias("txid"), "ts_us", "discrepancy", "payer", "received_sats")


def payment_participants(payments: DataFrame, reported: DataFrame) -> DataFrame:
    """One finding per (payer, collection point); each payer is credited the whole payment."""
    windows = reported.select(
        F.col("subject_id").alias("receiver"),
        F.col("start_us").alias("collection_window_start_us"),
        F.col("end_us").alias("collection_window_end_us"),
    )
    return (
        payments.groupBy("receiver", "payer")
        .agg(F.count("*").alias("payments_to_collection_point"),
             F.sum("received_sats").alias("paid_sats"),
             F.min("ts_us").alias("start_us"),
             F.max("ts_us").alias("end_us"),
             F.bool_or("discrepancy").alias("amount_quality_affected"))
        .join(windows, "receiver")
        .select(
            F.col("payer").alias("subject_id"),
            F.col("receiver").alias("context_id"),
            F.lit("potential_payment_participant").alias("role_hypothesis"),
            F.lit(RULE_SEVERITY["payment_participant"]).alias("severity"),
            "start_us",
            "end_us",
            F.col("payments_to_collection_point").alias("independent_supports"),
            "amount_quality_affected",
            F.col("receiver").alias("collection_point"),
            "payments_to_collection_point",
            "paid_sats",
            "collection_window_start_us",
            "collection_window_end_us",
        )
    )
