"""Compare frozen predictions with labels. The only module that reads a truth file."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.prefix import running_total
from tallyscope.functions.staging import stage
from tallyscope.settings import SUSPICIOUS_PATTERNS

# The cut-offs reported for precision at k, and the ranking variants.
K_VALUES = (20, 50, 100)
VARIANTS = ("rules_only", "model_only", "combined")
TRUTH_COLUMNS = ("wallet_id", "is_suspicious", "pattern_type")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows (wallet_id, is_suspicious, pattern_type); the last row of an id counts."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in TRUTH_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"truth file lacks columns: {missing}")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select(*TRUTH_COLUMNS, place.alias("place")).groupBy("wallet_id").agg(
        F.max_by("is_suspicious", "place").alias("is_suspicious"),
        F.max_by("pattern_type", "place").alias("pattern_type"))


def joined(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Addresses on both sides with label, rule decision and the three ranking scores.

    A blank label counts as not suspicious.
    """
    named = F.array_union("patterns", "transaction_patterns")
    return predictions.join(truth.withColumnRenamed("wallet_id", "address"), "address").select(
        "address",
        F.coalesce(F.col("is_suspicious") == "1", F.lit(False)).alias("label"),
        "pattern_type",
        named.alias("found"),
        binary_prediction(named).alias("flagged"),
        "roles",
        "scored",
        F.when(binary_prediction(named), 1.0).otherwise(0.0).alias("rules_only"),
        F.coalesce("anomaly_percentile", F.lit(-1.0)).alias("model_only"),
        F.coalesce("review_priority", F.lit(0.0)).alias("combined"),
    )


def binary_prediction(found: Column) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(p) for p in SUSPICIOUS_PATTERNS]))


def join_coverage(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Sizes of both sides, of the join, and of what is on one side only."""
    left = predictions.select("address", "scored", F.lit(True).alias("p"))
    right = truth.select(F.col("wallet_id").alias("address"), F.lit(True).alias("t"))
    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    return left.join(right, "address", "full").agg(
        F.count("p").alias("addresses_in_predictions"),
        F.count("t").alias("addresses_in_ground_truth"),
        F.count_if(both).alias("joined"),
        F.count_if(F.col("t").isNull()).alias("in_predictions_only"),
        F.count_if(F.col("p").isNull()).alias("in_ground_truth_only"),
        F.count_if(both & ~F.col("scored")).alias("joined_but_unscored"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and rates of the rule decision; a rate without denominator is null."""
    cell = lambda flagged, label: F.count_if((F.col("flagged") == flagged) & (F.col("label") == label))
    df = rows.agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"),
                  cell(False, True).alias("fn"), cell(False, False).alias("tn"))
    df = df.withColumns({
        "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
        "recall": F.try_divide("tp", F.col("tp") + F.col("fn")),
        "false_positive_rate": F.try_divide("fp", F.col("fp") + F.col("tn")),
    })
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def ranking_variants(rows: DataFrame) -> DataFrame:
    """Long form per variant with the rank and the true positives up to and including each row.

    Rank and cumulative hits come from one range sort by (variant, score, address), so neither a
    variant nor a block of equal scores is one task.
    """
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).cast("double").alias("score")) for v in VARIANTS])
    long = rows.select("address", F.col("label").cast("int").alias("hit"), F.explode(cells).alias("c")).select(
        "address", "hit", "c.variant", "c.score")
    long = running_total(long, ["variant", F.desc("score"), "address"],
                         {"rows_before": F.lit(1).cast("bigint"), "hits_before": F.col("hit").cast("bigint")}, "ranked")
    bases = long.groupBy("variant").agg(F.min("rows_before").alias("row_base"), F.min("hits_before").alias("hit_base"))
    return long.join(F.broadcast(bases), "variant").select(
        "variant", "address", "score", "hit",
        (F.col("rows_before") - F.col("row_base") + 1).alias("rank"),
        (F.col("hits_before") - F.col("hit_base") + F.col("hit")).alias("hits"))


def average_precision(ranked: DataFrame) -> DataFrame:
    """(variant, pr_auc): mean precision at the positives; null without any."""
    return ranked.groupBy("variant").agg(
        F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))), F.sum("hit")).alias("pr_auc"))


def precision_at_k(ranked: DataFrame) -> DataFrame:
    """(variant, k, hits, denominator, precision) for the fixed cut-offs."""
    cut = F.explode(F.array(*[F.lit(k) for k in K_VALUES]))
    return (
        ranked.where(F.col("rank") <= max(K_VALUES)).select("variant", "rank", "hit", cut.alias("k"))
        .where("rank <= k").groupBy("variant", "k")
        .agg(F.sum("hit").alias("hits"), F.count("*").alias("denominator"), F.avg("hit").alias("precision"))
    )


def per_pattern(rows: DataFrame) -> DataFrame:
    """Support, labelled and flagged addresses and recall per truth pattern."""
    return rows.groupBy("pattern_type").agg(
        F.count("*").alias("support"),
        F.count_if("flagged").alias("flagged_by_rules"),
        F.count_if("label").alias("labelled_suspicious"),
        F.avg(F.col("flagged").cast("double")).alias("recall_within_pattern"))


def predicted_patterns(rows: DataFrame) -> DataFrame:
    """(pattern_type, found, n): what was predicted for each truth pattern."""
    return rows.select("pattern_type", F.explode("found").alias("found")).groupBy("pattern_type", "found").agg(
        F.count("*").alias("n"))


def per_role(rows: DataFrame) -> DataFrame:
    """(role, pattern_type, n)."""
    return rows.select(F.explode("roles").alias("role"), "pattern_type").groupBy("role", "pattern_type").agg(
        F.count("*").alias("n"))


def evaluate(predictions: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """All evaluation tables of a run."""
    rows = stage(joined(predictions, truth), "joined")
    ranked = stage(ranking_variants(rows), "ranking")
    return {
        "coverage": join_coverage(predictions, truth), "confusion": confusion(rows),
        "average_precision": average_precision(ranked), "precision_at_k": precision_at_k(ranked),
        "per_pattern": per_pattern(rows), "predicted_patterns": predicted_patterns(rows), "per_role": per_role(rows),
    }
