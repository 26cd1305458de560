"""Isolation forest over address features: fit, score and rank against a frozen reference.

The model is plain tables. Everything kept on the driver or sent to tasks has a bound given by
the model's own parameters: 18 features x 1,000 quantiles and, per tree, at most twice the
subsample size in nodes. Feature rows and scores are only ever handled in partitions.
"""
from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.functions.prefix import running_total
from tallyscope.functions.staging import stage
from tallyscope.operators.features import assert_feature_contract
from tallyscope.settings import FEATURE_ORDER, FEATURE_SCHEMA
from tallyscope.sources.tables import table_checksum

# Fixed values of the fit.
SEED = 42
TREES = 200
SUBSAMPLE = 256
MODEL_FORMAT = "isolation-forest-tables/v1"

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, depth int")


@dataclass
class AnomalyModel:
    quantiles: DataFrame      # feature, level, value
    nodes: DataFrame          # NODE_SCHEMA
    reference: DataFrame      # score, weight: histogram of the fitted scores
    feature_order: tuple[str, ...] = FEATURE_ORDER
    subsample: int = SUBSAMPLE
    trees: int = TREES


@dataclass
class ScoreTable:
    """Scores made elsewhere, frozen: (address, anomaly_score), their histogram and a digest of both."""

    scores: DataFrame
    reference: DataFrame      # score, weight
    digest: str


def freeze_scores(scores: DataFrame, reference: DataFrame | None = None) -> ScoreTable:
    """Write down (address, anomaly_score) and the reference population its percentiles are taken in.

    Without a ``reference`` (score, weight) the scores themselves are the population. Null and
    non-finite scores leave an address unscored; an address scored twice with different values is an error.
    """
    value = F.col("anomaly_score").cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    kept = stage(scores.where(usable).select("address", value.alias("anomaly_score")).distinct(), "frozen-scores")
    twice = kept.groupBy("address").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"address {twice['address']!r} has more than one score")
    known = stage(reference_distribution(kept) if reference is None else reference.select("score", "weight"), "frozen-reference")
    digests = [str(table_checksum(df).first()["digest"]) for df in (kept, known)]
    return ScoreTable(kept, known, hashlib.sha256("|".join(digests).encode()).hexdigest())


def entity_holdout(frame: DataFrame, fraction: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(fit, held out) split by address; the same address always lands on the same side."""
    bucket = F.pmod(F.xxhash64("address", F.lit(seed)), F.lit(1_000_000))
    cut = int(fraction * 1_000_000)
    return frame.where(bucket >= cut), frame.where(bucket < cut)


def impute_constant(frame: DataFrame) -> DataFrame:
    return frame.fillna(0.0, list(FEATURE_ORDER))


def _long(frame: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("value")) for name in FEATURE_ORDER])
    return frame.select(F.explode(cells).alias("c")).select("c.feature", "c.value")


def feature_quantiles(frame: DataFrame, count: int | None = None) -> DataFrame:
    """(feature, level, value): evenly spaced exact quantiles of every feature, over all rows.

    Cells become counts by (feature, value); their running total over a range sort gives each
    value the block of ranks it covers, so no feature is one task or one buffer. A level lies at
    rank level / (levels - 1) * (rows - 1) and is interpolated between the values at the whole
    ranks around it. Which levels a block of ranks covers is arithmetic, so a value costs as many
    rows as levels meet it, and most values none.
    """
    rows = frame.count()
    levels = count or min(1000, max(10, rows))
    if not rows:
        return frame.sparkSession.createDataFrame([], "feature string, level int, value double")
    cells = _long(impute_constant(frame)).groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = running_total(cells, ["feature", "value"], {"ahead": "n"}, "quantile-ranks")
    base = ranked.groupBy("feature").agg(F.min("ahead").alias("base"))
    blocks = ranked.join(F.broadcast(base), "feature").select(
        "feature", "value", (F.col("ahead") - F.col("base")).alias("low"), (F.col("ahead") - F.col("base") + F.col("n")).alias("high"))
    last, steps = rows - 1, levels - 1
    # level i lies between ranks i * last div steps and the next one; a block [low, high) holds the first
    # for a whole range of levels and the second for that range moved by one rank
    first = F.expr(f"greatest(low - 1, 0) * {steps}L div {max(last, 1)}L")
    final = F.expr(f"least({steps}L, (high * {steps}L - 1) div {max(last, 1)}L)") if last else F.lit(steps).cast("long")
    near = blocks.where(first <= final).select("feature", "value", "low", "high", F.explode(F.sequence(first, final)).alias("level"))
    near = near.withColumns({"rank": F.expr(f"level * {last}L div {max(steps, 1)}L"), "rest": F.expr(f"level * {last}L % {max(steps, 1)}L")})
    under = F.when((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), F.col("value"))
    over = F.when((F.col("rank") + 1 >= F.col("low")) & (F.col("rank") + 1 < F.col("high")), F.col("value"))
    return (
        near.groupBy("feature", F.col("level").cast("int").alias("level"), "rest")
        .agg(F.max(under).alias("under"), F.max(over).alias("over"))
        .select("feature", "level", F.when((F.col("rest") == 0) | (F.col("under") == F.col("over")), F.col("under")).otherwise(
            (steps - F.col("rest")) / steps * F.col("under") + F.col("rest") / steps * F.col("over")).alias("value"))
    )


def _inverse_normal(p: np.ndarray) -> np.ndarray:
    """Acklam's published rational approximation of the normal quantile function."""
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
    q = p - 0.5
    r = q * q
    middle = q * np.polyval(a, r) / np.polyval((*b, 1.0), r)
    t = np.sqrt(-2.0 * np.log(np.minimum(p, 1.0 - p)))
    outer = np.polyval(c, t) / np.polyval((*d, 1.0), t)
    return np.where(np.abs(q) <= 0.47575, middle, np.where(q < 0, outer, -outer))


def _normal_scores(matrix: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Map each column through its quantile table to normal scores, clipped at the ends.

    Flat stretches of the table are entered from both sides and averaged, so a repeated value
    lands in the middle of its block.
    """
    levels = np.linspace(0.0, 1.0, table.shape[1])
    out = np.empty_like(matrix)
    for j in range(matrix.shape[1]):
        column, knots = matrix[:, j], table[j]
        rising = np.interp(column, knots, levels)
        falling = 1.0 - np.interp(-column, -knots[::-1], levels)
        rank = (rising + falling) / 2.0
        rank = np.where(column <= knots[0] + 1e-7, 0.0, rank)
        rank = np.where(column >= knots[-1] - 1e-7, 1.0, rank)
        out[:, j] = _inverse_normal(np.clip(rank, 1e-7, 1.0 - 1e-7))
    return np.clip(out, -5.1993375821928165, 5.1993375821928165)


def _quantile_table(quantiles: DataFrame) -> np.ndarray:
    rows = quantiles.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "value"))), lambda s: s["value"]).alias("v")
    ).collect()
    by_name = {r["feature"]: r["v"] for r in rows}
    return np.array([by_name[name] for name in FEATURE_ORDER], dtype=float)


def quantile_normal(frame: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Features replaced by their normal scores."""
    table = _quantile_table(quantiles)
    names = list(FEATURE_ORDER)

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scored = pd.DataFrame(_normal_scores(pdf[names].to_numpy(dtype=float), table), columns=names)
            scored.insert(0, "address", pdf["address"].to_numpy())
            yield scored

    columns = ", ".join(f"{n} double" for n in names)
    return frame.select("address", *names).mapInPandas(transform, f"address string, {columns}")


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Expected depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * harmonic - 2.0 * (n - 1.0) / np.maximum(n, 1.0)))


def _grow(tree: int, points: np.ndarray, limit: int, seed: int) -> list[tuple]:
    """Nodes of one random tree over at most a subsample of points."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[tuple] = []
    todo = [(np.arange(len(points)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        block = points[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varied) == 0:
            nodes.append([tree, here, -1, 0.0, -1, -1, len(rows), depth])
            continue
        feature = int(rng.choice(varied))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = block[:, feature] <= threshold
        nodes.append([tree, here, feature, threshold, -1, -1, len(rows), depth])
        todo.append((rows[~left], depth + 1, here, 5))
        todo.append((rows[left], depth + 1, here, 4))
    return nodes


def tree_samples(frame: DataFrame, trees: int, subsample: int, seed: int) -> DataFrame:
    """(tree, rank, address, features): the lowest hash ranks per tree.

    A row offers itself to a tree only when its hash for that tree is below a threshold that
    leaves about four subsamples per tree, so candidates do not grow with the data.
    """
    rows = frame.count()
    cut = min(1.0, 4.0 * subsample / max(rows, 1))
    span = 1 << 52
    draw = lambda t: F.pmod(F.xxhash64("address", t, F.lit(seed)), F.lit(span))
    offers = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("draw"))),
        lambda s: s["draw"] < F.lit(int(cut * span)))
    offered = frame.withColumn("o", F.explode(offers)).select("o.tree", "o.draw", *frame.columns)
    order = W.partitionBy("tree").orderBy("draw", "address")
    return offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= subsample).drop("draw")


def fit_isolation_forest(scaled: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE,
                         seed: int = SEED) -> DataFrame:
    """Node table of the forest: one task per tree, each over one subsample."""
    names = list(FEATURE_ORDER)
    limit = max(1, math.ceil(math.log2(max(subsample, 2))))
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        grown = _grow(int(pdf["tree"].iloc[0]), pdf[names].to_numpy(dtype=float), limit, seed)
        return pd.DataFrame(grown, columns=columns)

    return tree_samples(scaled, trees, subsample, seed).groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def anomaly_scores(scaled: DataFrame, nodes: DataFrame, subsample: int, trees: int = TREES) -> DataFrame:
    """(address, anomaly_score) in 0..1; larger is more unusual.

    The forest is broadcast: it has at most ``trees`` times twice ``subsample`` nodes, set by the fit
    and not by the data; a larger node table is an error.
    """
    most = trees * 2 * max(subsample, 1)
    forest = nodes.limit(most + 1).toPandas()
    if len(forest) > most:
        raise ValueError(f"the node table has more than {most} rows, too many for {trees} trees over {subsample} points")
    walks = []
    for _, tree in forest.sort_values(["tree", "node"]).groupby("tree"):
        path = tree["depth"].to_numpy(dtype=float) + average_path(tree["size"].to_numpy())
        walks.append((tree["feature"].to_numpy(), tree["threshold"].to_numpy(),
                      np.stack([tree["left"].to_numpy(), tree["right"].to_numpy()]), path))
    shared = scaled.sparkSession.sparkContext.broadcast(walks)
    norm = max(float(average_path(subsample)), 1e-12)
    names = list(FEATURE_ORDER)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matrix = pdf[names].to_numpy(dtype=float)
            rows = np.arange(len(matrix))
            total = np.zeros(len(matrix))
            for feature, threshold, children, path in shared.value:
                at = np.zeros(len(matrix), dtype=np.int64)
                while True:
                    split = feature[at]
                    moving = split >= 0
                    if not moving.any():
                        break
                    right = (matrix[rows, np.maximum(split, 0)] > threshold[at]).astype(np.int64)
                    at = np.where(moving, children[right, at], at)
                total += path[at]
            mean = total / max(len(shared.value), 1)
            yield pd.DataFrame({"address": pdf["address"], "anomaly_score": np.power(2.0, -mean / norm)})

    return scaled.mapInPandas(score, "address string, anomaly_score double")


def reference_distribution(scores: DataFrame) -> DataFrame:
    """Histogram of the fitted scores, frozen with the model."""
    return scores.groupBy(F.col("anomaly_score").alias("score")).agg(F.count("*").alias("weight"))


def percentile_rank(scores: DataFrame, reference: DataFrame, value: str = "anomaly_score") -> DataFrame:
    """Add ``anomaly_percentile``: the midpoint rank of each score in the reference, 0-100.

    Reference and query values are merged into one histogram whose cumulative weight is taken
    over a range-sorted table, so neither side is broadcast or pulled into one task.
    """
    merged = (
        reference.select("score", "weight")
        .unionByName(scores.select(F.col(value).alias("score"), F.lit(0).cast("bigint").alias("weight")))
        .groupBy("score").agg(F.sum("weight").alias("weight"))
    )
    ranked = running_total(merged, ["score"], {"below": "weight"}, "percentile")
    size = reference.agg(F.sum("weight")).first()[0] or 0
    middle = (2 * F.col("below") + F.col("weight")) / 2.0 / F.lit(float(size)) * 100.0
    percentile = middle if size else F.lit(None).cast("double")
    return scores.join(
        ranked.select(F.col("score").alias(value), percentile.alias("anomaly_percentile")), value, "left")


def fit_model(frame: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> AnomalyModel:
    """Quantiles, forest and frozen reference of one feature population."""
    used = min(subsample, frame.count())
    quantiles = stage(feature_quantiles(frame), "quantiles")
    scaled = stage(quantile_normal(impute_constant(frame), quantiles), "scaled")
    nodes = stage(fit_isolation_forest(scaled, trees, used, seed), "forest")
    reference = stage(reference_distribution(anomaly_scores(scaled, nodes, used, trees)), "reference")
    return AnomalyModel(quantiles, nodes, reference, FEATURE_ORDER, used, trees)


def score_addresses(frame: DataFrame, model: AnomalyModel | ScoreTable | None) -> tuple[DataFrame, str, str | None]:
    """(scores, status, error). Without a usable model every address is unscored and rules go on."""
    empty = F.lit(None).cast("double")
    if isinstance(model, ScoreTable):
        return _with_reasons(frame, percentile_rank(model.scores, model.reference), "The score table has no score for this address."), "used", None
    if model is None or tuple(model.feature_order) != tuple(FEATURE_ORDER):
        error = "no model bundle" if model is None else "MODEL_SCHEMA_MISMATCH: retrain for the current features"
        unscored = frame.select("address", empty.alias("anomaly_score"), empty.alias("anomaly_percentile"),
                                F.lit("No model score is available for this subject.").alias("unscored_reason"))
        return unscored, "unavailable", error
    assert_feature_contract([c for c in frame.columns if c != "address"])
    finite = F.lit(True)
    for name in FEATURE_ORDER:
        value = F.col(name)
        finite = finite & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    usable = frame.where(finite)
    raw = stage(anomaly_scores(quantile_normal(usable, model.quantiles), model.nodes, model.subsample, model.trees), "scores")
    ranked = percentile_rank(raw, model.reference)
    return _with_reasons(frame, ranked, "A required feature was not finite; reported as unscored."), "used", None


def _with_reasons(frame: DataFrame, ranked: DataFrame, missing: str) -> DataFrame:
    return frame.select("address").join(ranked, "address", "left").select(
        "address", "anomaly_score", "anomaly_percentile", F.when(F.col("anomaly_score").isNull(), F.lit(missing)).alias("unscored_reason"))


def save_model_tables(model: AnomalyModel, folder: str) -> dict:
    """Write the model as Parquet tables and a manifest with content digests."""
    spark = model.nodes.sparkSession
    parts = {"quantiles": model.quantiles, "if_trees": model.nodes, "reference_scores": model.reference}
    digests = {}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        written = spark.read.parquet(f"{folder}/{name}")
        row = table_checksum(written).first()
        digests[name] = {"rows": row["rows"], "digest": str(row["digest"])}
    manifest = {
        "format": MODEL_FORMAT, "feature_schema": FEATURE_SCHEMA, "feature_order": list(model.feature_order),
        "subsample": model.subsample, "trees": model.trees, "seed": SEED,
        "score_direction": "higher_is_more_unusual", "tables": digests,
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode(
        "overwrite").text(f"{folder}/manifest")
    return manifest


def load_model_tables(spark: SparkSession, folder: str) -> AnomalyModel:
    """Read a model back; a wrong format or changed table is an error."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if manifest.get("format") != MODEL_FORMAT:
        raise ValueError(f"model format {manifest.get('format')!r}, expected {MODEL_FORMAT!r}")
    tables = {}
    for name, expected in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        row = table_checksum(tables[name]).first()
        if (row["rows"], str(row["digest"])) != (expected["rows"], expected["digest"]):
            raise ValueError(f"model table {name} does not match its manifest")
    return AnomalyModel(tables["quantiles"], tables["if_trees"], tables["reference_scores"],
                        tuple(manifest["feature_order"]), manifest["subsample"], manifest["trees"])
