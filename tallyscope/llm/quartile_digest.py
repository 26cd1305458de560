"""Document fingerprints by quartile bucket digests.

Every window of five bytes gives six triplets that begin with its first byte; each is hashed to one
of 256 buckets. A bucket's count is coded by the quartile of all counts it falls in (two bits), so
the code says which triplets a text has more of than others, whatever its length. In front stand
the length on a logarithmic scale and the ratios of the quartiles. The difference of two digests
adds a step per bucket by how many quartiles its codes lie apart, and the steps between lengths and
ratios; it is bounded by what unrelated codes differ on average, where the likeness is 0.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import keep, short_batches, text_of

BUCKETS = 256
#: Offsets of the second and third byte of a window's triplets.
TRIPLETS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
WINDOW = 5
#: Cost of codes that lie 0, 1, 2 or 3 quartiles apart.
STEPS = (0, 1, 2, 6)
#: Difference from which the likeness is 0: the mean over two independent codes.
BOUND = BUCKETS * sum(STEPS[abs(a - b)] for a in range(4) for b in range(4)) // 16
#: A step of the length code is a tenth more bytes.
GROWTH = math.log(1.1)
_CHUNK = 1 << 20

_APART = np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3  # the four codes in a byte
_COST = np.array(STEPS)[np.abs(_APART[:, None, :] - _APART[None, :, :])].sum(2).astype(np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of all windows fall in each bucket; texts below five bytes have none."""
    counts = np.zeros(BUCKETS, np.int64)
    values = np.frombuffer(data, np.uint8)
    for at in range(0, len(values) - WINDOW + 1, _CHUNK):
        part = values[at:at + _CHUNK + WINDOW - 1].astype(np.uint32)
        n = len(part) - WINDOW + 1
        lead, middle, tail = part[:n] * np.uint32(0x9E3779B1), part * np.uint32(0x85EBCA77), part * np.uint32(0xC2B2AE3D)
        for salt, (i, j) in enumerate(TRIPLETS):
            mixed = lead + middle[i:i + n]
            mixed += tail[j:j + n]
            mixed += np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """Length code, two quartile ratios in a byte, and 64 bytes of bucket codes."""
    counts = bucket_counts(data)
    low, mid, high = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[
        [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > low).view(np.uint8) + (counts > mid) + (counts > high)).reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    ratios = (int(15 * low // high) << 4 | int(15 * mid // high)) if high else 0
    return bytes([min(int(math.log1p(len(data)) / GROWTH), 255), ratios]) + packed.tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Steps between two digests, 0 for equal ones."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    ratios = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return int(_COST[x[2:], y[2:]].sum()) + abs(a[0] - b[0]) + ratios


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, falling evenly to 0 at a difference of ``BOUND`` and staying there."""
    return 1 - min(difference(a, b), BOUND) / BOUND


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row; null texts count as empty, further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(v.as_buffer().to_pybytes()).hex() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def digest_likeness(a: str, b: str):
    """Column: likeness of two fingerprint columns as :func:`text_digests` writes them; null if one is null."""

    @F.pandas_udf(T.DoubleType())
    def compare(left, right):
        import pandas as pd

        return pd.Series([None if x is None or y is None else likeness(bytes.fromhex(x), bytes.fromhex(y))
                          for x, y in zip(left, right)], dtype="float64")

    return compare(a, b)


def with_half_of_next(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as many first characters of the following one, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_COMPARED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
#: What the first pass writes besides: the outer rows of its partitions, with their texts.
_PLACED = T.StructType([*_COMPARED.fields, T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()),
                        T.StructField("text", T.StringType())])
_PAIRS = 256


def _compared(doc_id: int | None, text: str, own: bytes, following: str, other: bytes) -> tuple:
    edited = with_half_of_next(text, following).encode()
    changed = digest(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, other))


def _batch(rows: list[tuple], schema: T.StructType, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.fieldNames())


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of an ordered partition with the next one; its first and last row also go out as edges."""
    part, before, rows = TaskContext.get().partitionId(), None, []
    nothing = (None,) * 6
    types = [*_TYPES, pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            own = digest(text.encode())
            if before is None:
                rows.append((doc_id, *nothing, part, "first", text))
            else:
                rows.append((*_compared(*before, text, own), None, None, None))
            before = (doc_id, text, own)
            if len(rows) >= _PAIRS:
                yield _batch(rows, _PLACED, types)
                rows = []
    if before is not None:
        rows.append((before[0], *nothing, part, "last", before[1]))
    yield _batch(rows, _PLACED, types)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(_compared(doc_id, text, digest(text.encode()), following, digest(following.encode())))
        yield _batch(rows, _COMPARED, _TYPES)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with half of the next one, and how near they are.

    Rows are in ascending doc_id, null ids first, equal ids by a hash of the text; the first follows
    the last, and a single row follows itself. Texts move once, by range of id; only the first and
    the last row of each partition are matched across partitions. Null texts count as empty; texts
    below five bytes have a digest of their length alone; repeated rows give a row each; further
    columns are ignored; an empty table gives no rows.
    """
    spark = short_batches(docs.sparkSession)
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "tie", "row")
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_walk, _PLACED),
                  "compared-texts")
    edges = placed.where("edge is not null")
    parts = [r["part"] for r in edges.where("edge = 'first'").select("part").orderBy("part").collect()]  # one number per partition
    if not parts:
        return placed.select(*_COMPARED.fieldNames())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    pairs = (
        edges.where("edge = 'last'").select("doc_id", "text", "part").join(follows, "part")
        .join(edges.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text")), "following")
        .select("doc_id", "text", "next_text")
    )
    return placed.where("edge is null").select(*_COMPARED.fieldNames()).unionByName(pairs.mapInArrow(_join_edges, _COMPARED))
