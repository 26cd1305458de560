"""The eighteen behavioural features of an address."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.prefix import HEAVY_ROWS, heavy_apart, median_gap, peak_overlap
from tallyscope.operators.activity import address_activity, counterparties
from tallyscope.operators.cocontrol import repeated_partners
from tallyscope.settings import DAY_US, FEATURE_ORDER, FEATURE_SCHEMA

FEATURE_MEANING = {
    "tx_count": "transactions the address appears in",
    "incoming_tx_count": "transactions paying the address",
    "outgoing_tx_count": "transactions funded by the address",
    "distinct_senders": "addresses funding transactions that pay this one",
    "distinct_receivers": "addresses paid by transactions this one funds",
    "distinct_counterparties": "senders and receivers together",
    "received_sats_log": "log1p of the total received",
    "spent_sats_log": "log1p of the total spent",
    "mean_incoming_sats_log": "log1p of the mean amount per receiving transaction",
    "incoming_value_concentration": "largest receipt as a share of the total received",
    "mean_input_count": "mean number of inputs of its transactions",
    "mean_output_count": "mean number of outputs of its transactions",
    "equal_output_participation": "share of its transactions with a group of equal outputs",
    "repeated_co_input_partners": "addresses co-spent with it more than once",
    "median_inter_event_hours": "median gap between its transactions, 0 for one",
    "activity_span_hours": "first to last transaction, 0 for one",
    "max_tx_in_24h": "most transactions in any 24 hours",
    "has_multiple_events": "1 when the gap features are defined",
}


def busiest_day(address_tx: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Most transactions of each address in any inclusive 24-hour window."""
    spans = address_tx.select("address", F.col("ts_us").alias("start_us"), (F.col("ts_us") + DAY_US).alias("end_us"))
    return peak_overlap(spans, ["address"], heavy_rows).select("address", F.col("peak").alias("max_tx_in_24h"))


def inter_event_gaps(address_tx: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Exact median gap between consecutive transactions; no row for single-event addresses."""
    return median_gap(address_tx.select("address", F.col("ts_us").alias("at")), ["address"], heavy_rows)


def _median_of(gaps: str) -> Column:
    """Middle of a sorted array, the mean of the two middle values of an even one; null when empty."""
    middle = lambda at: F.get(gaps, F.expr(at).cast("int"))
    return (middle(f"(size({gaps}) - 1) div 2") + middle(f"size({gaps}) div 2")) / 2.0


def _most_within(at: str, width: int) -> Column:
    """Most values of a sorted array in any inclusive window of ``width``, in one pass.

    The window never shrinks: a value makes the best count grow by one when it lies within ``width`` of
    the value that many places before it.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("most"))
    grows = lambda acc, value: value - F.get(at, acc["i"] - acc["most"]) <= F.lit(width)
    return F.aggregate(
        at, start,
        lambda acc, value: F.struct(
            (acc["i"] + 1).alias("i"), (acc["most"] + F.when(grows(acc, value), 1).otherwise(0)).alias("most")),
        lambda acc: acc["most"].cast("bigint"))


def _own_profiles(address_tx: DataFrame) -> DataFrame:
    """Totals, median gap and busiest day of addresses of bounded size, from one shuffle by address.

    The instants of an address are one sorted array, which gives the gaps and the sliding count. An
    unknown address has totals only; unknown instants are equal to each other and have no gap to known ones.
    """
    known = F.col("address").isNotNull()
    rows = address_tx.repartition("address").sortWithinPartitions("address", "ts_us")
    gathered = address_activity(
        rows,
        F.sort_array(F.collect_list(F.when(known, F.col("ts_us")))).alias("at"),
        F.count_if(known & F.col("ts_us").isNull()).alias("undated"))
    steps = F.zip_with(
        F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))),
        lambda later, earlier: later - earlier)
    ties = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.col("undated") - 1, F.lit(0)).cast("int"))
    return (
        gathered.withColumn("gaps", F.sort_array(F.concat(steps, ties)))
        .withColumn("median_gap_us", F.when(F.size("gaps") > 0, _median_of("gaps")))
        .withColumn("max_tx_in_24h", F.when(known, _most_within("at", DAY_US)))
        .drop("at", "undated", "gaps")
    )


def address_profiles(marked: DataFrame, address_tx: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Raw per-address measurements; every part is one row per address and joins on that key.

    Addresses of at most ``heavy_rows`` transactions are measured in one pass; heavier ones by partial
    aggregates and blocks of a range sort.
    """
    light, heavy = heavy_apart(address_tx, ["address"], heavy_rows, "profile")
    own = _own_profiles(light)
    if heavy is not None:
        own = own.unionByName(
            address_activity(heavy).join(inter_event_gaps(heavy, heavy_rows), "address", "left")
            .join(busiest_day(heavy, heavy_rows), "address", "left"))
    return (
        own.join(counterparties(marked), "address", "left")
        .join(repeated_partners(marked), "address", "left")
        .fillna(0, ["distinct_senders", "distinct_receivers", "distinct_counterparties",
                    "repeated_co_input_partners"])
    )


def address_features(profiles: DataFrame) -> DataFrame:
    """The feature matrix: address plus the allowlisted columns in their fixed order."""
    hours = F.lit(3.6e9)
    share = F.try_divide("largest_receipt_sats", "received_sats")
    mean_receipt = F.try_divide("received_sats", "incoming_tx_count")
    values = {
        "received_sats_log": F.log1p(F.col("received_sats")),
        "spent_sats_log": F.log1p(F.col("spent_sats")),
        "mean_incoming_sats_log": F.coalesce(F.log1p(mean_receipt), F.lit(0.0)),
        "incoming_value_concentration": F.coalesce(share, F.lit(0.0)),
        "median_inter_event_hours": F.coalesce(F.col("median_gap_us") / hours, F.lit(0.0)),
        "activity_span_hours": (F.col("last_us") - F.col("first_us")) / hours,
        "has_multiple_events": F.when(F.col("tx_count") > 1, 1.0).otherwise(0.0),
    }
    return allowlist(profiles.select(
        "address", *[values.get(name, F.col(name)).cast("double").alias(name)
                     if name in values else F.col(name).cast("double").alias(name) for name in FEATURE_ORDER]))


def allowlist(frame: DataFrame) -> DataFrame:
    """Keep address and the declared features in order; anything missing or non-numeric is an error."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    missing = [name for name in FEATURE_ORDER if name not in kinds]
    if missing:
        raise ValueError(f"features missing from the frame: {missing}")
    text = [name for name in FEATURE_ORDER if not isinstance(kinds[name], T.NumericType)]
    if text:
        raise ValueError(f"non-numeric features: {text}")
    return frame.select("address", *FEATURE_ORDER)


def assert_feature_contract(columns: list[str]) -> None:
    """Raise when model columns differ from the declared features or their order."""
    extra = [c for c in columns if c not in FEATURE_ORDER]
    if extra:
        raise ValueError(f"columns outside the feature contract: {extra}")
    if list(columns) != list(FEATURE_ORDER):
        raise ValueError("feature order differs from the contract")


def feature_contract() -> dict:
    return {"schema_version": FEATURE_SCHEMA, "feature_order": list(FEATURE_ORDER), "definitions": FEATURE_MEANING}
