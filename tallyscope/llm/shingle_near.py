"""Near copies: the SimHash classes of op5 and MinHash bands, checked by the Jaccard similarity of five-word shingles.

Two texts are linked if their sets of shingles have a similarity of at least ``SIMILAR``. Texts of one
class of :func:`simhash_near.near_classes` meet, and so do sets that share all ``ROWS`` minima of one of
``BANDS`` bands; every pair that meets is compared exactly, so no link is wrong, and a pair at similarity
s meets in a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9999 at 0.80. The fingerprints alone do not
do this: at 0.8 about ten of 64 bits differ, and a radius that covers those has keys too short to tell
fingerprints apart.

Equal sets are one set. Groups of bands with the same members are compared once, only what meets
gets its text back, large groups are cut into pairs of blocks, and tasks emit classes, never pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm import simhash_near
from tallyscope.llm.common import keep, short_batches, text_of
from tallyscope.llm.simhash_near import _LINKS, _classes
from tallyscope.operators.components import connected_components

SHINGLE = 5
#: The similarity of a link as a fraction: 0.8.
SIMILAR = (4, 5)
BANDS = 32
ROWS = 6
#: Members of one side that meet in one cell of a group, and columns of a product.
BLOCK = 256
COLUMNS = 4096
_CHUNK = 1 << 13
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, also without words.

    A-Z are lower-cased and words are split at ASCII white space, as for the fingerprints of op5.
    """
    words = text.encode("utf-8", "replace").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= SHINGLE:
        return np.array([digest(joined)], np.uint64)
    starts, ends = np.r_[0, ends[:-1] + 1][:len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist()
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def band_keys(grams: np.ndarray) -> list[int]:
    """One signed 64-bit key a band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), _CHUNK):
        np.minimum(least, (grams[at:at + _CHUNK, None] * _FACTORS).min(0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


@F.pandas_udf(T.StructType([T.StructField("digest", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def _sets(texts):
    import pandas as pd

    digests, keys = [], []
    for text in texts:
        grams = shingles(text)
        digests.append(xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63))
        keys.append(band_keys(grams))
    return pd.DataFrame({"digest": digests, "keys": keys})


def similar_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets that are linked."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.concatenate(sets)
    _, column, seen = np.unique(order, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = seen[column] > 1  # the others are in no intersection
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        common += (held @ held.T).astype(np.int64)
    up, down = SIMILAR
    linked = common * (up + down) >= up * (sizes[:, None] + sizes[None, :])
    return np.nonzero(np.triu(linked, 1))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells of a partition sorted by group and cell; a cell may go on in the next batch."""
    at, names, sets = None, [], []

    def out() -> pa.RecordBatch:
        a, b = similar_pairs(sets)
        nodes = np.array(names, np.int64).view(np.uint64)
        u, v = _classes(nodes[a], nodes[b])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        for key, cell, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            if (key, cell) != at:
                if len(sets) > 1:
                    yield out()
                at, names, sets = (key, cell), [], []
            names.append(digest)
            sets.append(shingles(text.as_py()))
    if len(sets) > 1:
        yield out()


def similar_classes(sets: DataFrame, texts: DataFrame, near: DataFrame) -> DataFrame:
    """(digest, root) for every set linked to another one, by class.

    ``sets`` has distinct ``digest`` with ``keys`` and the ``row`` in ``texts`` (row, text) it stands for; ``near``
    has distinct (digest, key) of further groups whose members meet. They are read several times, texts once.
    """
    keys = sets.select("digest", F.explode("keys").alias("key")).unionByName(near)
    groups = (
        keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("members")).where("n > 1")
        .groupBy("members", "n").agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    groups = keep(groups, "near-groups")
    cells = (
        keys.join(groups, "key")
        .select("digest", "key", F.expr("cast(pmod(xxhash64(digest), blocks) as int)").alias("own"),
                F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("digest", "key", F.expr("least(own, other) * 10000000L + greatest(own, other)").alias("cell"))
    )
    rows = cells.join(sets.select("digest", "row"), "digest").join(texts, "row").select("key", "cell", "digest", "text")
    links = rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare, _LINKS)
    return connected_components(keep(links.distinct(), "near-links"), "u", "v").select(F.col("node").alias("digest"), "root")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays.

    Null texts count as empty; texts without words are one set. Rows equal in doc_id count as copies
    if their texts are near; one of them stays. A null doc_id comes after all others.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("id"), text_of(docs).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    rows = simhash_near.with_fingerprint(rows).withColumn("set", _sets("text"))
    rows = keep(rows.select("doc", "id", "fp", "set.digest", "set.keys", "row"), "shingled")
    found = keep(simhash_near.near_classes(rows.select("fp").distinct()), "near-fingerprints")
    of_class = F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp"))
    linked = keep(rows.select("fp", "digest").distinct().join(found, "fp", "left").select("digest", of_class.alias("key")).distinct(),
                  "near-sets")
    first = keep(
        rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")), "distinct-sets")
    one = rows.select("row", "digest", "keys").join(first.select(F.col("first.row").alias("row")), "row", "left_semi")
    text = F.coalesce(F.col("doc")["text"].cast("string"), F.lit(""))
    near = keep(similar_classes(one, rows.select("row", text.alias("text")), linked), "near-classes")
    stay = (
        first.join(near, "digest", "left").groupBy(F.coalesce("root", "digest").alias("class"))
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    )
    return rows.join(stay, "row", "left_semi").select("doc.*")
