"""Mix sources to target token shares by entropy balancing.

Each source gets a target. Among all document rates between 0 and ``most_copies`` whose expected
words meet the targets, the rates closest in relative entropy to a flat rate are exponential tilts
of the document size, cut at the ceiling; the tilt of each source solves a convex dual. Newton
steps for all sources run together over the table of (source, size) counts: rates depend on
nothing else, so a corpus is summarised once and each step is one small aggregate. Rates are then
rounded into copies so that a source's words come within one small document of its target.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.llm.common import keep

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
ROUNDS = 60
CLOSE = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; null counts 0.

    A run starts where such a character follows white space or the beginning, so runs are
    counted by their starts without building them.
    """
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most_copies: int = MOST_COPIES) -> dict[str | None, float]:
    """Targets by source: ``share`` of all sizes split by weight, none above ``most_copies`` times its size.

    Sources are taken by code point, null last, and the weights repeat over them. What a full
    source cannot take is shared again by weight among the others until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    top = {s: most_copies * sizes[s] for s in order}
    target: dict[str | None, float] = {}
    rest, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > top[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = float(top[s])
            rest -= top[s]
            open_.remove(s)
    return target


def _tilts(cells: DataFrame, wanted: dict[int, float], scale: dict[int, float], most: int) -> dict[int, float]:
    """Newton iterations on the dual, all sources at once.

    ``cells`` has key, size and n. The rate of a cell is min(most, exp(tilt * size / mean size)).
    Each round is one aggregate by source giving the words and their derivative at the present
    tilt; a bracket around every root turns a step that leaves it into a bisection, so the search
    ends whatever the start. Sources at their ceiling or without words need no tilt.
    """
    spark = cells.sparkSession
    state = {k: [0.0, -1e4, 1e4] for k in wanted}
    busy = set(wanted)
    for _ in range(ROUNDS):
        if not busy:
            break
        tilt = spark.createDataFrame([(k, state[k][0] / scale[k]) for k in busy], "key long, tilt double")
        raw = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(50.0)))
        words = F.col("n") * F.col("size") * F.least(raw, F.lit(float(most)))
        slope = F.when(raw < most, F.col("n") * F.col("size") * F.col("size") * raw).otherwise(0.0)
        got = cells.join(tilt, "key").groupBy("key").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")).collect()
        for r in got:
            k, miss = r["key"], r["words"] - wanted[r["key"]]
            at, low, high = state[k]
            if abs(miss) <= CLOSE * max(wanted[k], 1.0):
                busy.discard(k)
                continue
            low, high = (low, at) if miss > 0 else (at, high)
            step = at - miss / (r["slope"] / scale[k]) if r["slope"] > 0 else low
            state[k] = [step if low < step < high else (low + high) / 2, low, high]
            if high - low < 1e-13:
                busy.discard(k)
    return {k: v[0] / scale[k] for k, v in state.items()}


def _round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies per (size) cell of one source: error diffusion from large sizes to small ones.

    Each cell takes its exact words plus what the larger sizes left over, in whole copies, so what
    is missed in the end is about half of the smallest size.
    """
    cells = cells.sort_values("size", ascending=False, kind="stable")
    sizes, n = cells["size"].to_numpy(), cells["n"].to_numpy()
    exact, most = cells["exact"].to_numpy(), cells["most"].to_numpy()
    copies, carried = np.zeros(len(cells), np.int64), 0.0
    for i in range(len(cells)):
        wish = exact[i] + carried
        copies[i] = min(max(int(np.floor(wish / sizes[i] + 0.5)), 0), int(n[i] * most[i]))
        carried = wish - copies[i] * sizes[i]
    return pd.DataFrame({"key": cells["key"].to_numpy(), "size": sizes, "n": n, "copies": copies})


def mixed_copies(docs: DataFrame, columns: Sequence[str], weights: Sequence[float] = WEIGHTS,
                 share: float = SHARE, most_copies: int = MOST_COPIES) -> DataFrame:
    """``columns`` of every row as the struct _doc, and _size, _source_size, _target and _copies (0 to ``most_copies``).

    Null texts count 0 words; rows without words weigh nothing and are taken once. Null sources
    form the last source. An empty table stays empty. Repeated rows are rows of their own. Which
    documents of a cell get an extra copy goes by a hash of id and text, so rerunning agrees; only
    rows equal in both are told apart by their place, and those are interchangeable.
    One row per source passes through the driver.
    """
    spark = docs.sparkSession
    source = docs["source"].cast("string")
    rows = keep(docs.select(
        F.struct(*[docs[c] for c in columns]).alias("_doc"), word_count(docs["text"]).alias("_size"),
        source.isNull().alias("_nameless"), F.coalesce(source, F.lit("")).alias("_name"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("_hash"),
        F.monotonically_increasing_id().alias("_row")), "rows")
    cells = keep(rows.groupBy("_nameless", "_name", "_size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("_nameless", "_name").agg(
        F.sum(F.col("n") * F.col("_size")).alias("words"), F.sum("n").alias("docs")).collect()
    sizes = {None if r["_nameless"] else r["_name"]: r["words"] for r in totals}
    targets = source_targets(sizes, weights, share, most_copies)
    keys = {s: i for i, s in enumerate(targets)}
    sources = keep(spark.createDataFrame(
        [(keys[s], s is None, s or "", sizes[s], float(targets[s])) for s in keys],
        "key long, _nameless boolean, _name string, _source_size long, _target double"), "sources")
    positive = keep(cells.where("_size > 0").join(sources.select("key", "_nameless", "_name"), ["_nameless", "_name"]).select(
        "key", F.col("_size").alias("size"), "n"), "balance")
    inner = {keys[s]: targets[s] for s in keys if 0 < targets[s] < most_copies * sizes[s]}
    means = {keys[s]: r["words"] / r["docs"] for r in totals
             if r["words"] for s in [None if r["_nameless"] else r["_name"]]}
    tilts = _tilts(positive, inner, means, most_copies)
    known = spark.createDataFrame([(k, tilts.get(k)) for k in keys.values()], "key long, tilt double")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most_copies))).otherwise(
        F.least(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(50.0))), F.lit(float(most_copies))))
    exact = positive.join(known, "key").select(
        "key", "size", "n", (rate * F.col("n") * F.col("size")).alias("exact"), F.lit(most_copies).alias("most"))
    rounded = exact.groupBy("key").applyInPandas(_round_cells, "key long, size long, n long, copies long")
    plan = keep(rounded.join(sources.select("key", "_nameless", "_name"), "key").select(
        "_nameless", "_name", F.col("size").alias("_size"), F.expr("copies div n").alias("_each"),
        F.expr("copies % n").alias("_extra")), "copies")
    last = _last_extra(rows.select(*_CELL, "_hash", "_row"), plan)
    full = keep(plan.join(last, _CELL, "left").drop("_extra"), "plan")
    extra = F.coalesce(F.struct("_hash", "_row") <= F.col("_last"), F.lit(False)).cast("long")
    return (
        rows.join(full, _CELL, "left").join(sources.drop("key"), ["_nameless", "_name"])
        .select("_doc", "_size", "_source_size", "_target",
                F.when(F.col("_size") == 0, 1).otherwise(F.col("_each") + extra).alias("_copies"))
    )


_CELL = ["_nameless", "_name", "_size"]


def _last_extra(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(cell, _last): the last row by (hash, row) that gets one copy more than the others.

    Cells are cut into 1,024 ranges of the hash. Counts by range, combined before the shuffle,
    show which range holds the last row; only that range is ranked, so a cell with a third of all
    rows never meets in one task.
    """
    some = rows.join(plan.where("_extra > 0").drop("_each"), _CELL).withColumn("_slot", F.shiftright("_hash", 54))
    counts = some.groupBy(*_CELL, "_extra", "_slot").agg(F.count("*").alias("_n"))
    order = W.partitionBy(*_CELL).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    hit = (
        counts.withColumn("_upto", F.sum("_n").over(order))
        .where("_upto >= _extra and _upto - _n < _extra")
        .select(*_CELL, "_slot", (F.col("_extra") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    inside = W.partitionBy(*_CELL, "_slot").orderBy("_hash", "_row")
    return (
        some.drop("_extra").join(hit, [*_CELL, "_slot"]).withColumn("_rank", F.row_number().over(inside))
        .where("_rank = _rest").select(*_CELL, F.struct("_hash", "_row").alias("_last"))
    )


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                  most_copies: int = MOST_COPIES) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with the columns of ``docs``."""
    return (
        mixed_copies(docs, docs.columns, weights, share, most_copies)
        .where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select("_doc.*")
    )


def taken_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                most_copies: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target and taken (copies times size) for every row."""
    return mixed_copies(docs, ["doc_id"], weights, share, most_copies).select(
        F.col("_doc.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
