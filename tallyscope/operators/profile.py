"""Profiles of a ledger file and of a truth file."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import entries
from tallyscope.functions.money import to_minor_units
from tallyscope.functions.prefix import one_row
from tallyscope.functions.text import strip
from tallyscope.operators.activity import tx_io
from tallyscope.operators.normalize import HEX64


def profile_ledger(rows: DataFrame) -> DataFrame:
    """Counts over raw rows as one row: identifiers, time range, list shapes and residuals."""
    field = lambda name: F.coalesce(F.try_element_at("raw", F.lit(name)), F.lit(""))
    names = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
    df = rows.select(
        field("txid").alias("txid"), field("timestamp").alias("time"),
        *[F.split(field(n), ";", -1).alias(n) for n in names], to_minor_units(strip(field("fee"))).alias("fee"))
    total = lambda n: F.aggregate(
        F.transform(n, lambda a: to_minor_units(strip(a))), F.lit(0).cast("bigint"), lambda a, u: a + u)
    residual = total("input_amounts") - total("output_amounts") - F.col("fee")
    blank = F.lit(False)
    for n in names:
        blank = blank | F.exists(n, lambda x: strip(x) == "")
    twice = lambda n: F.size(F.array_distinct(n)) < F.size(n)
    df = df.withColumn("residual", residual)
    per_row = df.agg(
        F.count("*").alias("rows"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count_if((F.size("input_addresses") != F.size("input_amounts"))
                   | (F.size("output_addresses") != F.size("output_amounts"))).alias("length_mismatch_rows"),
        F.count_if(blank).alias("empty_element_rows"),
        F.count_if(twice("input_addresses") | twice("output_addresses")).alias("repeated_address_rows"),
        F.count_if(F.col("residual") != 0).alias("residual_rows"),
        F.count_if((F.col("residual") != 0) & (F.abs("residual") <= 1)).alias("residual_rows_within_1"),
        F.max(F.abs("residual")).alias("max_abs_residual"),
        F.bool_and(F.col("txid").rlike(HEX64)).alias("all_txids_hex64"),
    )
    ids = df.groupBy("txid").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("distinct_txids"), F.count_if(F.col("n") > 1).alias("duplicated_txids"))
    people = df.select(F.explode(F.concat("input_addresses", "output_addresses")).alias("a")).distinct().agg(
        F.count("*").alias("distinct_addresses"))
    return one_row(per_row, ids, people)


def value_histograms(rows: DataFrame) -> DataFrame:
    """(measure, value, n): list lengths, script types, ports, address lengths and prefixes."""
    field = lambda name: F.coalesce(F.try_element_at("raw", F.lit(name)), F.lit(""))
    split = lambda name: F.split(field(name), ";", -1)
    item = lambda measure, value: F.struct(F.lit(measure).alias("measure"), value.cast("string").alias("value"))
    per_row = rows.select(F.explode(F.array(
        item("input_count", F.size(split("input_addresses"))), item("output_count", F.size(split("output_addresses"))),
        item("script_type", field("script_type")), item("dst_port", field("dst_port")),
        item("txid_length", F.length(field("txid"))))).alias("m"))
    per_address = rows.select(F.explode(F.concat(split("input_addresses"), split("output_addresses"))).alias("a")).select(
        F.explode(F.array(item("address_length", F.length("a")), item("address_prefix", F.substring("a", 1, 1)))).alias("m"))
    return per_row.unionByName(per_address).groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))


def profile_truth(truth: DataFrame, addresses: DataFrame) -> DataFrame:
    """Truth rows, distinct ids and the ids missing on either side, as one row."""
    ids = truth.select(F.col("wallet_id").alias("address")).distinct()
    seen = addresses.select("address").distinct()
    return one_row(
        truth.agg(F.count("*").alias("rows"), F.count_if(F.col("is_suspicious") == "1").alias("suspicious_rows")),
        ids.agg(F.count("*").alias("distinct_ids")),
        seen.join(ids, "address", "left_anti").agg(F.count("*").alias("addresses_without_truth")),
        ids.join(seen, "address", "left_anti").agg(F.count("*").alias("truth_without_addresses")),
    )


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("pattern_type", "is_suspicious").agg(F.count("*").alias("n"))


def pattern_touch_counts(truth: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct transactions that involve an address of each truth pattern; '?' marks unknown ones."""
    known = truth.select(F.col("wallet_id").alias("address"), "pattern_type").dropDuplicates(["address"])
    io = tx_io(ledger).select("txid", "address").distinct()
    return (
        io.join(known, "address", "left")
        .select("txid", F.coalesce("pattern_type", F.lit("?")).alias("pattern_type")).distinct()
        .groupBy("pattern_type").agg(F.count("*").alias("transactions"))
    )


def pattern_endpoints(truth: DataFrame, ledger: DataFrame, observations: DataFrame, pattern: str) -> DataFrame:
    """(src_ip, sightings) of the transactions that involve an address of ``pattern``."""
    wanted = truth.where(F.col("pattern_type") == pattern).select(F.col("wallet_id").alias("address")).distinct()
    touched = tx_io(ledger).select("txid", "address").join(wanted, "address", "left_semi").select("txid").distinct()
    return observations.join(touched, "txid", "left_semi").groupBy("src_ip").agg(F.count("*").alias("sightings"))


def equal_output_histogram(ledger: DataFrame) -> DataFrame:
    """(multiplicity, transactions): most repeated exact output value of transactions with 3+ outputs."""
    group = entries.equal_value_groups(entries.amounts("outputs"), 0, 3)
    return (
        ledger.where("output_count >= 3").select(group["size"].alias("multiplicity"))
        .groupBy("multiplicity").agg(F.count("*").alias("transactions"))
    )
