"""Near-duplicate classes by SimHash fingerprints, with candidates from pigeonring chains.

A 64-bit fingerprint is cut into a ring of segments. If two fingerprints differ in at most
``DISTANCE`` bits, then from some segment on every chain of l consecutive segments differs in at
most floor(l * DISTANCE / SEGMENTS) bits. With five segments and four bits that is 0, 1, 2, 3, 4:
the first segment is equal and the second differs in one bit at most. So each fingerprint is a
"home" under the values of its segments (i, i+1), and a "probe" under those and all values one bit
off in the second; every linked pair meets in some key of 26 bits. What meets there must keep the
longer chains' budgets before the whole distance is taken. Only distinct fingerprints are compared,
only classes leave a task (never its pairs), and keys with many homes or probes are cut into blocks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import keep, short_batches, text_of
from tallyscope.operators.components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (lowest bit, width) of the segments
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUDGETS = tuple((n + 1) * DISTANCE // len(SEGMENTS) for n in range(len(SEGMENTS)))
#: Rows of one side that meet in one block of a key, and candidate pairs compared at once.
BLOCK = 4096
PAIRS = 1 << 20
GATHER = 1 << 16
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the hashes of all word shingles; 0 without words.

    ``text`` is UTF-8; A-Z are lower-cased and words are split at ASCII white space, which is what
    the methods of ``bytes`` do.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) >= SHINGLE:
        starts, ends = starts[:len(words) - SHINGLE + 1], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        cuts = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts):
    import pandas as pd

    return pd.Series(np.array([fingerprint(t.encode()) for t in texts], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed 64-bit number; null texts count as empty."""
    short_batches(docs.sparkSession)
    return docs.withColumn(name, _fingerprints(text_of(docs)))


def _key(i: str = "i", flip: str = "flip") -> str:
    """SQL: number of the start segment, its value, and the next segment's value with a bit flipped."""
    return (f"(cast({i} as bigint) << 26) | ((shiftrightunsigned(fp, low) & mask) << 13)"
            f" | ((shiftrightunsigned(fp, next_low) & next_mask) ^ {flip})")


def _starts(flips: bool) -> list[tuple[int, int, int, int, int, int]]:
    found = []
    for i, (low, width) in enumerate(SEGMENTS):
        next_low, next_width = SEGMENTS[(i + 1) % len(SEGMENTS)]
        masks = (i, low, (1 << width) - 1, next_low, (1 << next_width) - 1)
        found += [(*masks, 0)] + [(*masks, 1 << b) for b in range(next_width) if flips]
    return found


def _emitted(fps: DataFrame, flips: bool) -> DataFrame:
    """One row per fingerprint and key it has as a home, or with ``flips`` as a probe."""
    entries = ", ".join(f"named_struct('i', {i}, 'low', {a}, 'mask', {m}L, 'next_low', {b}, 'next_mask', {n}L, 'flip', {f}L)"
                        for i, a, m, b, n, f in _starts(flips))
    return fps.select("fp", F.expr(f"inline(array({entries}))")).select(F.expr(_key()).alias("key"), "fp")


def _busy_keys(homes: DataFrame) -> DataFrame:
    """(key, home_blocks, probe_blocks) of keys with more rows of a side than one block holds.

    A key with many probes has a neighbour, or itself, with at least a fourteenth of them as
    homes, so only such heavy homes are looked at; the sum leaves out less than one block.
    """
    heavy = homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 14)
    around = heavy.select(
        "n", "key", F.explode(F.expr("concat(array(0L), transform(sequence(0, 12), b -> shiftleft(1L, b)))")).alias("flip"))
    return (
        around.groupBy(F.expr("key ^ flip").alias("key"))
        .agg(F.sum("n").alias("probes"), F.sum(F.when(F.col("flip") == 0, F.col("n")).otherwise(0)).alias("homes"))
        .where(F.col("probes") > BLOCK)
        .select("key", F.ceil(F.greatest("homes", F.lit(1)) / BLOCK).cast("int").alias("home_blocks"),
                F.ceil(F.col("probes") / BLOCK).cast("int").alias("probe_blocks"))
    )


def _classes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its class) for the classes that the links u-v make; roots left out."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[:len(u)], index[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _linked(left: np.ndarray, right: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pairs that keep the budgets of all chains from their start segment."""
    differ = left ^ right
    kept = np.flatnonzero(differ != 0)
    total = np.zeros(len(kept), np.int64)
    lows = np.array([s[0] for s in SEGMENTS], np.uint64)
    masks = np.array([(1 << s[1]) - 1 for s in SEGMENTS], np.uint64)
    for n in range(1, len(SEGMENTS)):  # the first segment is equal: it is part of the key
        segment = (start[kept] + n) % len(SEGMENTS)
        total += np.bitwise_count(differ[kept] >> lows[segment] & masks[segment])
        fits = total <= BUDGETS[n]
        kept, total = kept[fits], total[fits]
    return kept


def _compare(key: np.ndarray, cell: np.ndarray, home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes among rows sorted by key, cell and side (homes first); groups are complete."""
    edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    sizes = np.diff(np.r_[edge, len(key)])
    homes = np.add.reduceat(home.astype(np.int64), edge)
    busy = (homes > 0) & (sizes > homes)
    edge, homes, probes = edge[busy], homes[busy], (sizes - homes)[busy]
    found_u, found_v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    pairs = homes * probes
    at = 0
    while at < len(edge):
        upto = max(int(np.searchsorted(np.cumsum(pairs[at:]), PAIRS, side="right")), 1) + at
        if upto == at + 1 and pairs[at] > PAIRS:
            h = fp[edge[at]:edge[at] + homes[at]]
            p = fp[edge[at] + homes[at]:edge[at] + homes[at] + probes[at]]
            step = max(PAIRS // len(h), 1)
            blocks = [(np.repeat(h, len(q)), np.tile(q, len(h)), key[edge[at]]) for q in (p[s:s + step] for s in range(0, len(p), step))]
        else:
            n = pairs[at:upto]
            group = np.repeat(np.arange(at, upto), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left = edge[group] + inside // probes[group]
            right = edge[group] + homes[group] + inside % probes[group]
            blocks = [(fp[left], fp[right], key[left])]
        for left, right, of in blocks:
            start = np.broadcast_to(of >> 26, left.shape).astype(np.int64)
            kept = _linked(left, right, start)
            if len(kept):
                u, v = _classes(left[kept], right[kept])
                found_u.append(u)
                found_v.append(v)
        at = upto
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    return _classes(u, v) if len(u) else (u, v)


_LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the groups of a sorted partition, some ten thousand rows at a time.

    The last group of what was read may go on in the next batch and waits for it.
    """
    held: list[pa.RecordBatch] = []

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _compare(columns[0], columns[1], columns[2] == 0, columns[3].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def together() -> list[np.ndarray]:
        return [c.to_numpy() for c in pa.Table.from_batches(held).columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < GATHER:
            continue
        columns = together()
        key, cell = columns[0], columns[1]
        other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        if len(other):
            cut = int(other[-1]) + 1
            yield out([c[:cut] for c in columns])
            held = [pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()[0]]
    if held:
        yield out(together())


def near_classes(fingerprints: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint within ``DISTANCE`` bits of another one, by class.

    ``fingerprints`` has distinct, non-null values ``fp`` and is read several times.
    """
    homes = _emitted(fingerprints, flips=False)
    busy = keep(_busy_keys(homes), "busy-keys")
    spot = F.xxhash64("fp")
    one = F.lit(1)
    blocks = (F.coalesce("home_blocks", one), F.coalesce("probe_blocks", one))

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        own, other = blocks[side], blocks[1 - side]
        dealt_rows = rows.join(busy, "key", "left").select(
            "key", "fp", F.pmod(spot, own).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
        cell = F.expr("own * 100000L + other") if side == 0 else F.expr("other * 100000L + own")
        return dealt_rows.select("key", cell.alias("cell"), F.lit(side).alias("side"), "fp")

    rows = dealt(homes, 0).unionByName(dealt(_emitted(fingerprints, flips=True), 1))
    links = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "side").mapInArrow(_search, _LINKS)
    return connected_components(keep(links.distinct(), "near-links"), "u", "v").select(F.col("node").alias("fp"), "root")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null texts count as empty; texts without words share fingerprint zero and are one class with
    whatever lies near zero. ``component_id`` is the smallest doc_id of the class (null only if no
    member has one); repeated rows give a row each; further columns are ignored.
    """
    rows = keep(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp"),
                "fingerprints")
    least = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    near = keep(near_classes(least.select("fp")), "near-classes")
    classes = near.join(least, "fp").groupBy("root").agg(F.min("low").alias("component"))
    named = near.join(classes, "root").select("fp", "component")
    every = least.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id"))
    return rows.join(every, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays.

    Rows equal in doc_id count as copies if their texts are near; one of them stays. A null
    doc_id comes after all others.
    """
    rows = keep(with_fingerprint(docs, "_fp").withColumn("_row", F.monotonically_increasing_id()), "fingerprinted")
    light = rows.select(F.col("_fp").alias("fp"), F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    near = keep(near_classes(light.select("fp").distinct()), "near-classes")
    first = (
        light.groupBy("fp").agg(F.min(F.struct("none", "doc_id", "_row")).alias("first"))
        .join(near, "fp", "left").groupBy(F.coalesce("root", "fp").alias("class"))
        .agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    )
    return rows.join(first, "_row", "left_semi").select(*docs.columns)
