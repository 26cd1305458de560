"""Session settings the library relies on."""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: UTC instants and adaptive re-planning.

    Rows that arrive sorted by their keys are aggregated in that order, without a hash table. Shuffle files go
    when the query that wrote them ends, not when the driver next collects garbage.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def local_session(cores: int | str = 8, app: str = "tallyscope") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def side_by_side(spark: SparkSession, *branches: Callable[[], Any]) -> list[Any]:
    """Run independent pieces of a job at the same time; Spark interleaves their stages."""
    with ThreadPoolExecutor(max_workers=len(branches)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(b)) for b in branches]]
