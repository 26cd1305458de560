"""Cut lineage with Parquet tables in the cluster's shared checkpoint folder.

Iterative operators and multi-consumer intermediates are written once and read back. The
tables live on shared storage, so a lost executor costs a re-read and never a recompute of
the whole chain, and Spark sees real file sizes when it picks join strategies.
"""
from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Codec of tables that are written once to be read a few times.
CODEC = "zstd"

_WATCH = threading.local()
_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temp folder only on local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Materialise ``df`` and return a DataFrame that scans the written table, in ``spark`` if given."""
    spark = spark or df.sparkSession
    path = f"{checkpoint_root(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    for made in getattr(_WATCH, "lists", ()):
        made.append(staged)
    return staged


@contextlib.contextmanager
def staged_here() -> Iterator[list[DataFrame]]:
    """A list of the tables that this thread stages inside the block, to be released once nothing reads them."""
    lists = _WATCH.__dict__.setdefault("lists", [])
    made: list[DataFrame] = []
    lists.append(made)
    try:
        yield made
    finally:
        lists[:] = [m for m in lists if m is not made]


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no remaining plan reads."""
    for df in frames:
        path = _PATHS.pop(df, None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
