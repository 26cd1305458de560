"""Per-transaction and per-address views of a ledger."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import entries
from tallyscope.functions.prefix import dense_index, one_row
from tallyscope.functions.sieve import mark_possible
from tallyscope.functions.text import packed, unpacked
from tallyscope.settings import Structure

_PER_TX = ("txid", "ts_us", "input_count", "output_count", "discrepancy", "equal_outputs")

#: Pair expansion of one transaction is split over tasks above this many pairs.
WIDE_PAIRS = 250_000
_CHUNK = 512


def tx_io(ledger: DataFrame, *carried: str) -> DataFrame:
    """Long form: one row per input or output, with its array position and any columns carried along."""
    side = F.when(F.col("at") < F.col("funded"), F.lit("input")).otherwise(F.lit("output"))
    both = F.posexplode(F.concat("inputs", "outputs")).alias("at", "e")
    return ledger.select("txid", *carried, F.size("inputs").alias("funded"), both).select(
        "txid", side.alias("side"), "e.position", "e.address", "e.amount_sats", *carried)


def ledger_index(ledger: DataFrame) -> DataFrame:
    """Dense ``tx_index`` in (observed time, txid) order."""
    return dense_index(ledger, ["ts_us", "txid"], "tx_index", "ledger-index")


def dominant_outputs(ledger: DataFrame) -> DataFrame:
    """Largest output of each transaction and its share of the output value."""
    return (
        ledger.select("txid", entries.dominant_output().alias("d")).where("d is not null")
        .select("txid", "d.address", "d.amount_sats", "d.share")
    )


def amount_discrepancies(ledger: DataFrame) -> DataFrame:
    """Transactions whose amounts do not reconcile with the supplied fee."""
    return ledger.where("residual_sats <> 0").select("txid", "residual_sats", "fee_sats")


def address_transactions(ledger: DataFrame, structure: Structure | None = None) -> DataFrame:
    """One row per (address, transaction) with the amounts moved and transaction-level facts.

    Rows in which no address repeats are exploded in place; only rows with a repeated address
    are grouped, so most of the ledger needs no shuffle here.
    """
    structure = structure or Structure()
    equal = entries.has_equal_group(
        entries.amounts("outputs"), structure.equal_amount_band_sats, structure.min_equal_outputs)
    zero = F.lit(0).cast("bigint")
    names = F.concat(entries.addresses("inputs"), entries.addresses("outputs"))
    marked = ledger.select(
        "txid", "ts_us", "input_count", "output_count",
        (F.col("residual_sats") != 0).alias("discrepancy"),
        equal.alias("equal_outputs"),
        F.size("inputs").alias("funded"),
        (F.size(F.array_distinct(names)) < F.size(names)).alias("repeats"),
        F.concat("inputs", "outputs").alias("both"),
    )
    marked = marked.select("*", F.posexplode("both").alias("at", "e")).drop("both")
    spends, amount = F.col("at") < F.col("funded"), F.col("e.amount_sats")
    flat = marked.select(
        *_PER_TX, "repeats", "e.address", F.when(spends, zero).otherwise(amount).alias("received_sats"),
        F.when(spends, amount).otherwise(zero).alias("spent_sats"), (~spends).alias("receives"), spends.alias("spends"))
    plain = flat.where("not repeats").drop("repeats")
    folded = (
        flat.where("repeats").groupBy("address", *_PER_TX)
        .agg(F.sum("received_sats").alias("received_sats"), F.sum("spent_sats").alias("spent_sats"),
             F.bool_or("receives").alias("receives"), F.bool_or("spends").alias("spends"))
    )
    return plain.unionByName(folded)


def address_activity(address_tx: DataFrame, *more: Column) -> DataFrame:
    """Totals per address, and any further aggregates; one partially aggregated shuffle."""
    return address_tx.groupBy("address").agg(
        F.count("*").alias("tx_count"),
        F.count_if("receives").alias("incoming_tx_count"),
        F.count_if("spends").alias("outgoing_tx_count"),
        F.sum("received_sats").alias("received_sats"),
        F.sum("spent_sats").alias("spent_sats"),
        F.max("received_sats").alias("largest_receipt_sats"),
        F.avg("input_count").alias("mean_input_count"),
        F.avg("output_count").alias("mean_output_count"),
        F.avg(F.col("equal_outputs").cast("double")).alias("equal_output_participation"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        *more,
    )


def endpoint_index(observations: DataFrame) -> DataFrame:
    """Distinct (endpoint, transaction) sightings."""
    return observations.where("src_ip is not null").select("src_ip", "txid").distinct()


def coverage(ledger: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: transaction, address, observation and endpoint counts and the period."""
    tx = ledger.agg(
        F.count("*").alias("transactions"),
        F.count_if(F.col("residual_sats") != 0).alias("transactions_with_amount_discrepancy"),
        F.min("ts_us").alias("period_start_us"),
        F.max("ts_us").alias("period_end_us"),
    )
    people = tx_io(ledger).agg(F.count_distinct("address").alias("addresses"))
    seen = observations.agg(
        F.count("*").alias("observations"),
        F.count_distinct("src_ip").alias("distinct_src_ips"),
    )
    return one_row(tx, people, seen)


def payer_receiver_pairs(ledger: DataFrame, receivers: DataFrame | None = None,
                         payers: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(txid, ts_us, discrepancy, payer, receiver) for every distinct payer and receiver of a transaction.

    The pairs come from the row's own arrays, so there is no join. A transaction with very many
    pairs is first cut into array chunks that are spread over tasks; the result is the same. Such
    rows have a long side, which the Parquet statistics of the counts rule out for most row
    groups, so the second scan reads little.
    ``receivers`` / ``payers`` restrict one side (column ``address``) before the other side is
    expanded. With ``few`` receivers, from a table, most rows leave before that join.
    """
    counts = ("input_count", "output_count")
    base = ledger.select(
        *counts, "txid", "ts_us", (F.col("residual_sats") != 0).alias("discrepancy"),
        entries.distinct_addresses("inputs").alias("payers"),
        entries.distinct_addresses("outputs").alias("receivers"),
    )
    pairs = F.col("input_count").cast("bigint") * F.col("output_count")
    long_side = math.isqrt(WIDE_PAIRS)
    narrow = base.where(pairs <= WIDE_PAIRS).drop(*counts)
    chunk = lambda name: F.transform(
        F.sequence(F.lit(1), F.size(name), F.lit(_CHUNK)), lambda i: F.slice(F.col(name), i, F.lit(_CHUNK)))
    wide = (
        base.where((F.col("input_count") > long_side) | (F.col("output_count") > long_side))
        .where(pairs > WIDE_PAIRS).drop(*counts)
        .withColumn("payers", F.explode(chunk("payers")))
        .withColumn("receivers", F.explode(chunk("receivers")))
        .repartition("txid", F.hash("payers"), F.hash("receivers"))
    )
    rows = narrow.unionByName(wide)
    if receivers is not None:
        mark = F.when(F.col("discrepancy"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
        mark = F.when(F.col("discrepancy").isNull(), F.lit(b"\x02")).otherwise(mark)
        rows = rows.select("ts_us", "payers", F.concat(mark, F.coalesce(packed(F.col("txid")), F.lit(b""))).alias("tx"), F.explode("receivers").alias("receiver"))
        if few:
            rows = mark_possible(rows, F.col("receiver"), receivers, "address", "_possible").where("_possible").drop("_possible")
        rows = rows.join(receivers.select(F.col("address").alias("receiver")), "receiver", "left_semi")
        first, rest = F.substring("tx", 1, 1), F.substring(F.col("tx"), F.lit(2), F.octet_length("tx") - 1)
        rows = rows.select(
            "ts_us", "receiver", F.explode("payers").alias("payer"), F.when(F.octet_length("tx") > 1, unpacked(rest)).alias("txid"),
            F.when(first != F.lit(b"\x02"), first == F.lit(b"\x01")).alias("discrepancy"))
    else:
        rows = rows.withColumn("payer", F.explode("payers")).drop("payers")
        if payers is not None:
            rows = rows.join(payers.select(F.col("address").alias("payer")), "payer", "left_semi")
        rows = rows.withColumn("receiver", F.explode("receivers"))
    return rows.where("payer <> receiver").select("txid", "ts_us", "discrepancy", "payer", "receiver")


def counterparties(ledger: DataFrame) -> DataFrame:
    """Distinct senders, receivers and counterparties per address.

    Both directions of a relation share one unordered key, so the pair rows are shuffled once,
    with duplicates dropped on the map side; the per-address counts are sums of flags.
    """
    forward = F.col("payer") < F.col("receiver")
    relations = (
        payer_receiver_pairs(ledger)
        .groupBy(F.least("payer", "receiver").alias("low"), F.greatest("payer", "receiver").alias("high"))
        .agg(F.bool_or(forward).alias("low_pays"), F.bool_or(~forward).alias("high_pays"))
    )
    ends = F.array(
        F.struct(F.col("low").alias("address"), F.col("high_pays").alias("sender"),
                 F.col("low_pays").alias("receiver")),
        F.struct(F.col("high").alias("address"), F.col("low_pays").alias("sender"),
                 F.col("high_pays").alias("receiver")),
    )
    return (
        relations.select(F.explode(ends).alias("e")).select("e.*")
        .groupBy("address")
        .agg(F.count_if("sender").alias("distinct_senders"),
             F.count_if("receiver").alias("distinct_receivers"),
             F.count("*").alias("distinct_counterparties"))
    )
