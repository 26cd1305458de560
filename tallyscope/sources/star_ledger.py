"""Read an order/line-item star schema as a ledger.

Every order with line items becomes one transaction: its lines are the outputs, the customer
and some suppliers are the inputs, and the customer's nation is the network endpoint. Customer,
part and supplier keys share one address space, so addresses both receive and spend.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions import entries

UNITS_PER_QUANTITY = 100_000


def _entry(position, address, amount):
    return F.struct(
        position.cast("int").alias("position"), address.alias("address"), amount.alias("amount_sats")
    )


def _address(key) -> "F.Column":
    return F.concat(F.lit("A"), key.cast("string"))


def read_star_ledger(spark: SparkSession, folder: str, *shown: str) -> DataFrame:
    """One ledger row per order, without observations; ``shown`` are further columns of the order to keep."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("observed_at")
    )
    lines = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        .repartition("o_orderkey").sortWithinPartitions("o_orderkey", "l_linenumber")
        .groupBy("o_orderkey")
        .agg(F.sort_array(F.collect_list(
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    )
    units = lambda line: (line["l_quantity"] * UNITS_PER_QUANTITY).cast("bigint")
    outputs = F.transform("lines", lambda line, p: _entry(p, _address(line["l_partkey"]), units(line)))
    funded = F.slice(F.col("lines"), F.lit(1), (F.col("o_orderkey") % 3).cast("int"))
    extra = F.transform(funded, lambda line, p: _entry(p + 1, _address(line["l_suppkey"]), units(line)))
    first = F.array(_entry(F.lit(0), _address(F.col("o_custkey")), F.col("total_out_sats")))
    return (
        orders.join(lines, "o_orderkey")
        .withColumn("outputs", outputs)
        .withColumn("total_out_sats", entries.total("outputs"))
        .withColumn("inputs", F.concat(first, extra))
        .withColumn("total_in_sats", entries.total("inputs"))
        .select(
            F.sha2(F.col("o_orderkey").cast("string"), 256).alias("txid"),
            "observed_at",
            F.unix_micros("observed_at").alias("ts_us"),
            (F.col("total_in_sats") - F.col("total_out_sats")).alias("fee_sats"),
            "total_in_sats",
            "total_out_sats",
            F.lit(0).cast("bigint").alias("residual_sats"),
            F.size("inputs").alias("input_count"),
            F.size("outputs").alias("output_count"),
            F.lit(None).cast("string").alias("script_type"),
            F.lit("clean").alias("quality_status"),
            (F.col("o_orderkey") + 1).alias("row_number"),
            "inputs",
            "outputs",
            *shown,
        )
    )


def read_star_observations(spark: SparkSession, folder: str) -> DataFrame:
    """One network sighting per order that has line items."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customers = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_nationkey")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    return (
        orders.join(lines, "o_orderkey", "left_semi")
        .join(customers, orders.o_custkey == customers.c_custkey)
        .select(
            F.sha2(F.col("o_orderkey").cast("string"), 256).alias("txid"),
            (F.col("o_orderkey") + 1).alias("row_number"),
            F.col("o_orderdate").cast("timestamp").alias("observed_at"),
            F.concat(F.lit("10.0."), F.col("c_nationkey").cast("string"), F.lit(".1")).alias("src_ip"),
            F.lit(40000).alias("src_port"),
            F.lit("10.9.9.9").alias("dst_ip"),
            F.lit(8333).alias("dst_port"),
        )
    )
