"""Peeling sequences: a dominant output carried forward hop by hop."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.functions import entries
from tallyscope.functions.prefix import HEAVY_ROWS, by_weight, position_within
from tallyscope.functions.staging import release, stage
from tallyscope.settings import RULE_SEVERITY, SIDE_RECIPIENT_SEVERITY, Peeling, hours_us


def peel_steps(marked: DataFrame, config: Peeling) -> DataFrame:
    """Transactions that can be a hop: a dominant output and something branching away."""
    largest = F.array_max(entries.amounts("outputs"))
    return (
        marked.where("not collaborative and output_count >= 2")
        .where((F.col("total_out_sats") > 0) & (largest / F.col("total_out_sats") >= config.min_dominant_share))
        .withColumn("d", entries.dominant_output())
        .select("txid", "ts_us", F.col("d.address").alias("address"), F.col("d.amount_sats").alias("amount_sats"),
                F.col("d.share").alias("share"))
    )


def next_hop(steps: DataFrame, spends: DataFrame, max_gap_hours: float, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Earliest later spend of each step's dominant address within the gap.

    "Later" is strictly later in (time, txid) order: an as-of join, done by reading both sides of
    an address backwards. A heavy address lies in blocks of a range sort; what a block does not
    find itself is the first spend of the nearest later block that has one, so any gap will do.
    """
    paid = spends.select("address", "ts_us", "txid", F.lit(1).alias("kind"))
    probes = steps.select("address", "ts_us", "txid", F.lit(0).alias("kind"))
    light, heavy = by_weight(probes.unionByName(paid), ["address"], ["ts_us", "txid"], heavy_rows, "next-hop")
    spend = F.when(F.col("kind") == 1, F.struct("ts_us", "txid"))

    def read_back(rows: DataFrame, *by: str) -> DataFrame:
        backwards = W.partitionBy(*by).orderBy(F.desc("ts_us"), F.desc("txid"), "kind").rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn("next", F.last(spend, ignorenulls=True).over(backwards)).where("kind = 0")

    found = read_back(light, "address").select("address", "ts_us", "txid", "next")
    if heavy is not None:
        later = W.partitionBy("address").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
        carried = (
            heavy.groupBy("address", "block").agg(F.min(spend).alias("first"))
            .select("address", "block", F.last("first", ignorenulls=True).over(later).alias("carried"))
        )
        found = found.unionByName(
            read_back(heavy, "address", "block").join(carried, ["address", "block"])
            .select("address", "ts_us", "txid", F.coalesce("next", "carried").alias("next")))
    return found.where(F.col("next.ts_us") - F.col("ts_us") <= hours_us(max_gap_hours)).select(
        "txid", "ts_us", "address", F.col("next.txid").alias("next_txid"), F.col("next.ts_us").alias("next_us"))


def _heads(links: DataFrame) -> DataFrame:
    """Earliest live start reaching each node, with its distance, by pointer doubling.

    Round r tells the node 2^r steps ahead about the best start known so far, so a sequence of
    n hops settles in log2(n) rounds. ``links`` has txid, ts_us, succ and live.
    """
    start = F.when(F.col("live"), F.struct("ts_us", "txid", F.lit(0).cast("bigint").alias("hop")))
    state = stage(links.select("txid", start.alias("start"), F.col("succ").alias("jump")), "peel-heads")
    step = 1
    while not state.where("jump is not null").isEmpty():
        news = state.where("jump is not null and start is not null").select(
            F.col("jump").alias("txid"),
            F.struct("start.ts_us", "start.txid", (F.col("start.hop") + step).alias("hop")).alias("start"))
        best = state.select("txid", "start").unionByName(news).groupBy("txid").agg(F.min("start").alias("start"))
        ahead = state.select(F.col("txid").alias("jump"), F.col("jump").alias("far"))
        jumps = state.select("txid", "jump").join(ahead, "jump", "left").select("txid", F.col("far").alias("jump"))
        nxt = stage(best.join(jumps, "txid"), "peel-heads")
        release(state)
        state, step = nxt, step * 2
    return state.select("txid", "start")


def claim_chains(links: DataFrame, min_length: int) -> DataFrame:
    """Non-overlapping chains over successor links, the earliest start claiming shared tails.

    Taken in time order, a start claims its path up to the first node already claimed, provided
    that is at least ``min_length`` nodes. This is done for all starts at once, in rounds. Among
    live starts (those with enough nodes ahead of them) the earliest one reaching a node owns it,
    which splits every tree into segments. A segment of full length whose tail runs into the end
    of its tree, or into another segment of full length, is a chain: nothing earlier can take its
    nodes and the node it runs into is always taken first. Claimed nodes leave and what remains
    goes into the next round, until no start is long enough. Returns (chain, hop, txid), hop from 1.

    ``links`` has txid, ts_us, succ (null at the end); succ is later in (ts_us, txid) order.
    """
    remaining = stage(links.select("txid", "ts_us", "succ"), "peel-links")
    claimed = None
    while True:
        far = remaining.select("txid", "ts_us", "succ",
                               (F.lit("") if min_length <= 1 else F.col("succ")).alias("far"))
        ahead = remaining.select(F.col("txid").alias("far"), F.col("succ").alias("beyond"))
        for _ in range(min_length - 2):
            far = far.join(ahead, "far", "left").select("txid", "ts_us", "succ", F.col("beyond").alias("far"))
        live = stage(far.select("txid", "ts_us", "succ", F.col("far").isNotNull().alias("live")), "peel-live")
        if live.where("live").isEmpty():
            break
        heads = _heads(live).where("start is not null").select(
            "txid", F.col("start.txid").alias("chain"), F.col("start.hop").alias("hop"))
        nodes = stage(heads.join(live.select("txid", "succ"), "txid"), "peel-nodes")
        segments = nodes.groupBy("chain").agg(
            F.count("*").alias("length"), F.max_by("succ", "hop").alias("entry"))
        entered = nodes.select(F.col("txid").alias("entry"), F.col("chain").alias("entry_chain"))
        lengths = segments.select(F.col("chain").alias("entry_chain"), F.col("length").alias("entry_length"))
        accepted = (
            segments.where(F.col("length") >= min_length)
            .join(entered, "entry", "left").join(lengths, "entry_chain", "left")
            .where(F.col("entry").isNull() | (F.col("entry_length") >= min_length))
            .select("chain")
        )
        members = stage(
            nodes.join(accepted, "chain", "left_semi").select("chain", (F.col("hop") + 1).alias("hop"), "txid"),
            "peel-chains")
        claimed = members if claimed is None else claimed.unionByName(members)
        taken = members.select(F.col("txid").alias("succ"), F.lit(True).alias("gone"))
        rest = (
            live.join(members, "txid", "left_anti").join(taken, "succ", "left")
            .select("txid", "ts_us", F.when(F.col("gone").isNull(), F.col("succ")).alias("succ"))
        )
        nxt = stage(rest, "peel-links")
        release(remaining, live, nodes)
        remaining = nxt
    if claimed is None:
        claimed = remaining.limit(0).select(F.lit("").alias("chain"), F.lit(0).cast("bigint").alias("hop"), "txid")
    return claimed


def peel_chains(marked: DataFrame, address_tx: DataFrame, config: Peeling) -> DataFrame:
    """(chain, hop, txid) of every candidate sequence.

    The earliest spend decides: when it is not a qualifying hop itself, the sequence ends there.
    A step that neither leads on nor is led to is a sequence of one and stays out of the rounds
    unless a single step is long enough.
    """
    steps = stage(peel_steps(marked, config), "peel-steps")
    hops = next_hop(steps, address_tx.where("spends"), config.max_gap_hours)
    usable = stage(
        hops.join(steps.select(F.col("txid").alias("next_txid")), "next_txid", "left_semi")
        .select("txid", F.col("next_txid").alias("succ")), "peel-usable")
    nodes = steps.select("txid", "ts_us")
    if config.min_chain_length > 1:
        linked = usable.select("txid").unionByName(usable.select(F.col("succ").alias("txid"))).distinct()
        nodes = nodes.join(linked, "txid", "left_semi")
    links = nodes.join(usable, "txid", "left")
    return claim_chains(links, config.min_chain_length)


def peel_hops(chains: DataFrame, marked: DataFrame) -> DataFrame:
    """Chains with the measured values of every hop; the long form of a sequence."""
    body = marked.select("txid", "ts_us", "total_in_sats", "total_out_sats", "outputs",
                         (F.col("residual_sats") != 0).alias("discrepancy"))
    hops = chains.join(body, "txid").withColumn("d", entries.dominant_output())
    following = hops.select("chain", (F.col("hop") - 1).alias("hop"), F.col("ts_us").alias("next_us"))
    side = F.filter("outputs", lambda e: e["address"] != F.col("d.address"))
    return hops.join(following, ["chain", "hop"], "left").select(
        "chain", "hop", "txid", "ts_us", "total_in_sats", "discrepancy",
        F.col("d.address").alias("address"),
        F.col("d.amount_sats").alias("amount_sats"),
        F.bround("d.share", 4).alias("share"),
        F.bround((F.col("next_us") - F.col("ts_us")) / F.lit(3.6e9), 2).alias("gap_hours"),
        side.alias("side_outputs"),
        entries.total(side).alias("peeled_sats"),
    )


def peel_findings(hops: DataFrame, config: Peeling) -> DataFrame:
    """One finding per continuation address and per side recipient of every sequence.

    Per-hop lists stay in the long ``peel_hops`` table under the sequence id; a finding carries
    their counts and bounds, so its size does not depend on the length of the sequence.
    """
    continuing = hops.groupBy("chain", "address").agg(F.min("hop").alias("first_hop"))
    continuing = position_within(continuing, ["chain"], "first_hop", "subject_position").drop("first_hop")
    sides = hops.select("chain", F.explode(F.array_distinct(entries.addresses("side_outputs"))).alias("address")).distinct()
    side_counts = sides.groupBy("chain").agg(F.count("*").alias("side_recipient_count"))
    summary = hops.groupBy("chain").agg(
        F.count("*").alias("hop_count"),
        F.min("share").alias("min_share"),
        F.max("share").alias("max_share"),
        F.min("gap_hours").alias("min_gap_hours"),
        F.max("gap_hours").alias("max_gap_hours"),
        F.sum("peeled_sats").alias("total_peeled_off_sats"),
        F.min_by("total_in_sats", "hop").alias("entry_value_sats"),
        F.max_by("amount_sats", "hop").alias("final_continuation_sats"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.bool_or("discrepancy").alias("amount_quality_affected"),
        F.count_distinct("address").alias("continuation_count"),
    ).join(side_counts, "chain", "left")
    subjects = continuing.select(
        "chain", "address", F.lit("sequence_continuation").alias("role_hypothesis"),
        F.lit(RULE_SEVERITY["peeling_sequence"]).alias("severity"), "subject_position",
    ).unionByName(
        sides.join(continuing, ["chain", "address"], "left_anti").select(
            "chain", "address", F.lit("sequence_side_recipient").alias("role_hypothesis"),
            F.lit(SIDE_RECIPIENT_SEVERITY).alias("severity"), F.lit(None).cast("bigint").alias("subject_position"))
    )
    return subjects.join(summary, "chain").select(
        F.col("address").alias("subject_id"),
        F.concat(F.lit("peel:"), "chain").alias("context_id"),
        "role_hypothesis",
        "severity",
        "start_us",
        "end_us",
        F.col("hop_count").alias("independent_supports"),
        "amount_quality_affected",
        "hop_count",
        "continuation_count",
        F.coalesce("side_recipient_count", F.lit(0).cast("bigint")).alias("side_recipient_count"),
        "min_share",
        "max_share",
        F.lit(float(config.min_dominant_share)).alias("min_dominant_share_threshold"),
        "min_gap_hours",
        "max_gap_hours",
        F.lit(float(config.max_gap_hours)).alias("max_gap_hours_threshold"),
        "total_peeled_off_sats",
        "entry_value_sats",
        "final_continuation_sats",
        F.concat(F.lit("peel:"), F.substring("chain", 1, 12)).alias("chain_id"),
        F.col("role_hypothesis").alias("subject_role"),
        "subject_position",
    )


def continuity_edges(hops: DataFrame, rule_version: str) -> DataFrame:
    """Inferred edge per consecutive pair of hops."""
    following = hops.select("chain", (F.col("hop") - 1).alias("hop"), F.col("txid").alias("next_txid"))
    return hops.join(following, ["chain", "hop"]).select("txid", "next_txid").distinct().select(
        F.concat(F.lit("tx:"), "txid").alias("source"),
        F.concat(F.lit("tx:"), "next_txid").alias("target"),
        F.concat_ws(":", F.lit("continuity"), "txid", "next_txid").alias("key"),
        F.lit("inferred_continuity").alias("kind"),
        F.lit(rule_version).alias("rule_version"),
        F.lit(None).cast("double").alias("strength"),
        F.lit(2).cast("bigint").alias("support"),
    )
