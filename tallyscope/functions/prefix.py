"""Running totals, sliding counts and gaps that never put one hot key into one task.

Plain windows partition by key, so a key holding a third of all rows becomes one task. Here only
keys of at most ``HEAVY_ROWS`` rows are windowed whole. The rows of heavier keys are range-sorted
by key and order, so a key covers as many blocks as its rows need however they lie in time; work
is done inside (key, block) and joined up through one summary row per block of the key.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.functions.staging import stage

_ROW_MASK = (1 << 33) - 1

#: Rows of one key that a single window takes; a key with more is cut into blocks.
HEAVY_ROWS = 200_000


def into_blocks(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Range-sorted ``rows`` with ``block``, a number that never falls along ``order``; equal rows share a block."""
    return stage(rows.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), label)


def heavy_apart(rows: DataFrame, keys: Sequence[str], heavy_rows: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of light keys, rows of heavy keys); the second is None without heavy keys.

    Null keys count as light. There are at most rows / ``heavy_rows`` heavy keys; their table is staged,
    so the optimizer knows its size when it picks the joins. ``rows`` is read once to count and once by
    the caller, so it should be a table or cheap to make from one; it is not written again.
    """
    keys = list(keys)
    heavy = stage(
        rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_rows).select(*keys).na.drop(),
        f"{label}-heavy")
    if heavy.isEmpty():
        return rows, None
    return rows.join(heavy, keys, "left_anti"), rows.join(heavy, keys, "left_semi")


def by_weight(rows: DataFrame, keys: Sequence[str], order: Sequence[str], heavy_rows: int,
              label: str) -> tuple[DataFrame, DataFrame | None]:
    """As :func:`heavy_apart`, the rows of heavy keys range-sorted and with ``block``."""
    light, heavy = heavy_apart(rows, keys, heavy_rows, label)
    return light, None if heavy is None else into_blocks(heavy, [*keys, *order], f"{label}-blocks")


def _open_steps(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of the steps, and the largest running sum with its earliest instant, per ``by``."""
    inside = W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return (
        steps.withColumn("open", F.sum("step").over(inside)).groupBy(*by)
        .agg(F.sum("step").alias("net"), F.max(F.struct("open", (-F.col("at")).alias("neg_at"))).alias("best"))
    )


def _steps(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """+1 where an interval opens and -1 after it closes, summed per instant."""
    one = F.lit(1).cast("bigint")
    return (
        intervals.select(*keys, F.explode(F.array(
            F.struct(F.col("start_us").alias("at"), one.alias("step")),
            F.struct((F.col("end_us") + 1).alias("at"), (-one).alias("step")),
        )).alias("s"))
        .select(*keys, F.col("s.at").alias("at"), F.col("s.step").alias("step"))
        .groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    )


def peak_overlap(intervals: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Most intervals open at once per key, and the earliest instant that many are open.

    ``intervals`` has ``start_us`` and ``end_us`` (both inclusive). A sliding window of width W
    over events is the case of intervals [t, t + W]: the count at instant T is the number of
    events in [T - W, T]. The intervals of light keys are shuffled once, by key, and become steps
    there. Those of heavy keys become steps first, pre-summed per instant on the map side; a block
    is summarised as (net, best prefix), and blocks of a key combine like a scan.
    """
    keys = list(keys)
    light, heavy = heavy_apart(intervals.select(*keys, "start_us", "end_us"), keys, heavy_rows, "peak")
    best = _open_steps(_steps(light.repartition(*keys), keys), keys).select(*keys, "best")
    if heavy is not None:
        heavy = into_blocks(_steps(heavy, keys), [*keys, "at"], "peak-blocks")
        before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        best = best.unionByName(
            _open_steps(heavy, [*keys, "block"])
            .withColumn("base", F.coalesce(F.sum("net").over(before), F.lit(0)))
            .groupBy(*keys)
            .agg(F.max(F.struct((F.col("base") + F.col("best.open")).alias("open"),
                                F.col("best.neg_at").alias("neg_at"))).alias("best")))
    return best.select(*keys, F.col("best.open").alias("peak"), (-F.col("best.neg_at")).alias("peak_us"))


def _gaps(points: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(key, gap_us, weight) of the neighbours inside ``by``; equal instants give gaps of zero."""
    gap = F.col("at") - F.lag("at").over(W.partitionBy(*by).orderBy("at"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return points.withColumn("gap_us", gap).select(*keys, F.explode(F.array_compact(F.array(
        F.when(F.col("gap_us").isNotNull(), F.struct(F.col("gap_us").alias("gap_us"), one.alias("weight"))),
        F.when(F.col("n") > 1, F.struct(zero.alias("gap_us"), (F.col("n") - 1).alias("weight"))),
    ))).alias("g")).select(*keys, "g.gap_us", "g.weight")


def _middle(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median by rank: weights are summed along a range sort, the middle ranks are looked up."""
    blocks = into_blocks(gaps.groupBy(*keys, "gap_us").agg(F.sum("weight").alias("weight")), [*keys, "gap_us"], "gap-ranks")
    sizes = blocks.groupBy(*keys, "block").agg(F.sum("weight").alias("held"))
    whole = W.partitionBy(*keys)
    bases = sizes.select(
        *keys, "block", F.sum("held").over(whole).alias("total"),
        F.coalesce(F.sum("held").over(whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = W.partitionBy(*keys, "block").orderBy("gap_us").rowsBetween(W.unboundedPreceding, 0)
    ranked = blocks.withColumn("inside", F.sum("weight").over(inside)).join(bases, [*keys, "block"])
    upto = F.col("base") + F.col("inside")
    holds = lambda rank: (rank < upto) & (rank >= upto - F.col("weight"))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    return ranked.where(holds(low) | holds(high)).groupBy(*keys).agg(
        ((F.min("gap_us") + F.max("gap_us")) / 2.0).alias("median_gap_us"))


def median_gap(events: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Exact median gap between consecutive events (``at`` in microseconds) of each key.

    A light key's events are shuffled once and its gaps fit one aggregate buffer. A heavy key's equal
    instants collapse to one counted row first; its gaps are taken block by block, the step between
    blocks from their first and last instants, and the median is picked by rank, so no buffer grows
    with the key. Unknown instants are equal to each other and have no gap to known ones.
    """
    keys = list(keys)
    light, heavy = heavy_apart(events.select(*keys, "at"), keys, heavy_rows, "gap")
    along = W.partitionBy(*keys).orderBy("at")
    before = F.lag("at").over(along)
    unknown = F.col("at").isNull() & (F.row_number().over(along) > 1)
    found = (
        light.withColumn("gap_us", F.when(unknown, F.lit(0)).otherwise(F.col("at") - before)).where("gap_us is not null")
        .groupBy(*keys).agg(F.expr("percentile(gap_us, 0.5D)").alias("median_gap_us"))
    )
    if heavy is None:
        return found
    heavy = into_blocks(heavy.groupBy(*keys, "at").agg(F.count("*").alias("n")), [*keys, "at"], "gap-blocks")
    across = (
        heavy.groupBy(*keys, "block").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .withColumn("gap_us", F.col("first") - F.lag("last").over(W.partitionBy(*keys).orderBy("block")))
        .where("gap_us is not null").select(*keys, "gap_us", F.lit(1).cast("bigint").alias("weight"))
    )
    return found.unionByName(_middle(_gaps(heavy, keys, [*keys, "block"]).unionByName(across), keys))


def running_total(df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, Column | str],
                  label: str) -> DataFrame:
    """Add exclusive running sums over a global order without a single-task window.

    Rows are range-partitioned by ``order`` and staged with their partition number. Sums run
    inside each partition; the partition totals (one row per partition) give the offsets.
    ``order`` must identify a row.
    """
    named = {f"_v{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(totals.values())}
    placed = stage(
        df.withColumns(named).orderBy(*order).withColumn("_part", F.spark_partition_id()), label)
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(*[F.sum(v).alias(v) for v in named])
    offsets = offsets.select("_part", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"{v}_base")
                                        for v in named])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_part")
    out = out.withColumns({
        name: F.col(f"{v}_base") + F.coalesce(F.sum(v).over(inside), F.lit(0))
        for name, v in zip(totals, named)
    })
    return out.drop("_part", *named, *[f"{v}_base" for v in named])


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str, label: str,
                shown: Sequence[Column | str] = ("*",)) -> DataFrame:
    """Number rows 0, 1, 2, ... in a global order.

    The range sort leaves each partition ordered, so the row id inside the partition is known
    when the sort runs; only the partition sizes are needed afterwards. ``shown`` are the columns to
    keep, made of the sorted rows: what comes before the sort runs once more to sample its ranges.
    """
    placed = stage(df.orderBy(*order).select(*shown, F.monotonically_increasing_id().alias("_row")), label)
    part = F.shiftright("_row", 33)
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))
    )
    return (
        placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.col("_row").bitwiseAND(F.lit(_ROW_MASK)))
        .drop("_part", "_row", "_base")
    )


def position_within(df: DataFrame, keys: Sequence[str], at: str, name: str, width: int = 100_000) -> DataFrame:
    """1-based position of each row inside its key by the integer ``at`` (distinct within a key)."""
    keys = list(keys)
    cut = df.withColumn("_bucket", F.expr(f"{at} div {int(width)}"))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(at)
    return (
        cut.withColumn("_rn", F.row_number().over(inside)).join(bases, [*keys, "_bucket"])
        .withColumn(name, F.col("_base") + F.col("_rn")).drop("_bucket", "_base", "_rn")
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Merge single-row aggregates into one row."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
