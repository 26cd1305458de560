"""What several corpus operators share: table access, kept intermediates, bounded head words."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.staging import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and return a scan of it.

    The folder is ``<spark.checkpoint.dir>/<application id>/corpus/<label>-<random>``: one
    application's intermediates lie together and may be deleted when it has ended. A lost
    executor costs a re-read.
    """
    spark = df.sparkSession
    path = (f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/corpus/"
            f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables written by :func:`keep` that no plan reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def short_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Let Arrow batches hold at most ``rows`` rows: whole texts travel in them to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return spark


def fold(df: DataFrame, column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null ids give null."""
    return F.crc32(df[column].cast("string").cast("binary")) % parts


def by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut 0..len(sizes) into consecutive ranges whose sizes sum to about ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def head_floor(counts: DataFrame, count: str, most: int) -> int:
    """Smallest count such that at most ``most`` rows of ``counts`` have it or more.

    Counts are summarised by a logarithmic histogram (a few hundred rows whatever the input),
    so the rows above the floor can be collected or broadcast: there are ``most`` at most.
    """
    bins = (
        counts.select(F.floor(F.log2(count) * 16).cast("int").alias("bin"), F.col(count).alias("c"))
        .groupBy("bin").agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("bin")).collect()
    )
    held, floor = 0, None
    for b in bins:
        held += b["n"]
        if held > most:
            break
        floor = b["low"]
    return floor if floor is not None else (max((b["low"] for b in bins), default=0) + 1) * 2 + (1 << 62)
