"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns. Its name is the sum, over its turns, of 128-bit hashes
of (place, turn) in four lanes; sums make names computable for a conversation cut into blocks, so no
conversation has to fit in one task. Nodes are dealt to shards by range of their path, so a shard is
a piece of the trie in depth-first order.

Inside a shard nodes are sorted in reverse level order (Spark's external sort). Each node takes the
messages of its children from a priority queue that spills, adds its own part and sends the total
to its parent. Shard roots send theirs to a parent in another shard. Nodes that receive from other
shards (portals) are few, as they are ancestors of a shard's first node; the totals that arrive
there pass through each other by the same procedure, one level up: across shard roots. A second pass
over the shards starts from what their portals received.
"""
from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyscope.functions.prefix import dense_index
from tallyscope.llm.common import keep

LANES = ("l1", "l2", "l3", "l4")
#: Turn hashes of the first eight levels, two in a number: the order in which nodes are sharded.
TRAIL = ("t1", "t2", "t3", "t4")
#: Turns of a conversation whose names are summed in one window; further blocks start from the earlier ones' sums.
BLOCK = 4096
#: Nodes a shard should have at most and at least; in between there are as many shards as cores, twice.
LARGE, SMALL = 1 << 18, 1 << 12
#: Messages a queue holds in memory, and rows of one pickled block on disk.
HELD, SPILL_BLOCK = 1 << 18, 1 << 12
#: Ids joined before they are sent to the task that digests a node's list.
IDS = 1 << 12

_NO_IDS = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Smallest item first; beyond ``held`` items sorted runs go to unnamed files of the task.

    Like Spark's own spills the files lie in the executor's local folders, belong to one task
    attempt and vanish with it; a repeated attempt starts anew.
    """

    def __init__(self, held: int = HELD) -> None:
        self._held, self._heap, self._runs, self.spilled = held, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self._heap, item)
        if len(self._heap) > self._held:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self._heap.sort()
        for at in range(0, len(self._heap), SPILL_BLOCK):
            pickle.dump(self._heap[at:at + SPILL_BLOCK], file, pickle.HIGHEST_PROTOCOL)
        blocks, self._heap, self.spilled = -(-len(self._heap) // SPILL_BLOCK), [], self.spilled + 1
        file.seek(0)
        self._next_of(self._read(file, blocks), self.spilled)

    @staticmethod
    def _read(file, blocks: int) -> Iterator[tuple]:
        with file:
            for _ in range(blocks):
                yield from pickle.load(file)

    def _next_of(self, run: Iterator[tuple], number: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self._runs, (head, number, run))

    def take(self, place: tuple) -> list[tuple]:
        """All items whose first part is ``place``; nothing smaller may be left."""
        found = []
        while True:
            if self._runs and (not self._heap or self._runs[0][0] < self._heap[0]):
                if self._runs[0][0][0] != place:
                    return found
                item, number, run = heapq.heappop(self._runs)
                found.append(item)
                self._next_of(run, number)
            elif self._heap and self._heap[0][0] == place:
                found.append(heapq.heappop(self._heap))
            else:
                return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# ------------------------------------------------------------------ passes in reverse level order

_FLOW = ("shard", "depth", "key", "parent", "outer", "portal", "own", "more_children", "more_leaves", "more_saved")
_SENT = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("from", pa.binary()), ("children", pa.int64()),
                   ("leaves", pa.int64()), ("saved", pa.int64())])
_TOTALS = pa.schema([("key", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _time_forward(rows: Iterator[tuple], held: int, totals: bool) -> Iterator[tuple]:
    """Pass totals from each node to its parent; rows come by shard, deepest first, then by key.

    With ``totals`` the rows of all nodes come out. Without, what shard roots send to parents in
    other shards: their totals, and for each portal below them that it lies below that parent.
    """
    queue, current = SpillingQueue(held), None
    for shard, depth, key, parent, outer, portal, own, children, leaves, saved in rows:
        if shard != current:
            queue, current = SpillingQueue(held), shard
        below: list[bytes] = []
        for _, more_leaves, more_saved, portals in queue.take((-depth, key)):
            children += 1
            leaves += more_leaves
            saved += more_saved
            below = portals + below if len(below) < len(portals) else below + portals
        if not children:
            leaves = 1
        saved += own
        if totals:
            yield key, children, leaves, saved
        elif portal:
            below = [*below, key]
        if depth and not outer:
            queue.push(((1 - depth, parent), leaves, saved, [] if totals else below))
        elif depth and not totals:
            yield parent, depth - 1, None, 1, leaves, saved
            for t in below:
                yield parent, depth - 1, t, 0, 0, 0


def _pass(totals: bool, held: int):
    schema = _TOTALS if totals else _SENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(_time_forward(_rows(batches), held, totals), schema)

    return run


_ARRIVED = pa.schema([("key", pa.binary()), ("more_children", pa.int64()), ("more_leaves", pa.int64()), ("more_saved", pa.int64())])


def _across(held: int):
    """Totals that arrive at each portal, from other portals too; rows come deepest first."""

    def arrived(rows: Iterator[tuple]) -> Iterator[tuple]:
        queue = SpillingQueue(held)
        for key, depth, children, leaves, saved, up, up_depth in rows:
            for _, more_leaves, more_saved in queue.take((-depth, key)):
                leaves += more_leaves
                saved += more_saved
            yield key, children, leaves, saved
            if up is not None:
                queue.push(((-up_depth, up), leaves, saved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(arrived(_rows(batches)), _ARRIVED)

    return run


def _by_shard(nodes: DataFrame, shards: int) -> DataFrame:
    return nodes.select(*_FLOW).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("depth"), "key")


def subtree_totals(nodes: DataFrame, shards: int, held: int = HELD) -> DataFrame:
    """(key, n_children, n_leaves, saved_tokens) for the trie in ``nodes``.

    ``nodes`` has shard, depth, key, parent, own (the node's own part of the sum) and outer (its
    parent lies in another shard); the root has depth 0. It is read several times.

    A portal that received totals already counts the leaves below it, so a leaf in the shard is
    one only if nothing arrived from outside either.
    """
    zero = F.lit(0).cast("long")
    portals = nodes.where("outer").groupBy(F.col("parent").alias("key")).agg(F.lit(True).alias("portal"))
    flow = nodes.join(portals, "key", "left").withColumn("portal", F.coalesce("portal", F.lit(False)))
    # a portal without children in its shard is no leaf: nothing of its own counts in the first pass
    first = flow.withColumns({"more_children": F.col("portal").cast("long"), "more_leaves": zero, "more_saved": zero})
    sent = keep(_by_shard(first, shards).mapInArrow(_pass(False, held), T.StructType([
        T.StructField("key", T.BinaryType()), T.StructField("depth", T.LongType()), T.StructField("from", T.BinaryType()),
        T.StructField("children", T.LongType()), T.StructField("leaves", T.LongType()), T.StructField("saved", T.LongType())])),
        "trie-sent")
    ups = sent.where("from is not null").select(F.col("from").alias("key"), F.col("key").alias("up"), F.col("depth").alias("up_depth"))
    received = sent.where("from is null").groupBy("key", "depth").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    arrived = keep(
        received.join(ups, "key", "left").select("key", "depth", "children", "leaves", "saved", "up", "up_depth")
        .repartition(1).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(_across(held), T.StructType([
            T.StructField("key", T.BinaryType()), *[T.StructField(f"more_{c}", T.LongType()) for c in ("children", "leaves", "saved")]])),
        "trie-arrived")
    second = flow.join(arrived, "key", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("more_children", "more_leaves", "more_saved")})
    return _by_shard(second, shards).mapInArrow(_pass(True, held), T.StructType([
        T.StructField("key", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_children", "n_leaves", "saved_tokens")]]))


# ------------------------------------------------------------------ conversations to nodes

def _prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_bytes): turns without their texts; rows without a conv_id belong to none."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    ).where("conv_id is not null")


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, digest, n_bytes) and (conv_id, first, n): places in a global order, and each conversation's part of it.

    Turns are in ascending order, null first, equal ones by a hash of role and text.
    """
    turns = keep(dense_index(_prepared(conversations), ["conv_id", "turn", "digest", "row"], "at", "turns")
                 .select("conv_id", "at", "digest", "n_bytes"), "turns")
    sizes = keep(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")), "conversation-sizes")
    return turns, sizes


def plain_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, depth, digest, n_bytes, length) per turn, and (conv_id, length)."""
    turns, sizes = ordered_turns(conversations)
    path = turns.join(sizes, "conv_id").select(
        "conv_id", (F.col("at") - F.col("first") + 1).alias("depth"), "digest", "n_bytes", F.col("n").alias("length"))
    return path, sizes.select("conv_id", F.col("n").alias("length"))


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`plain_paths`, each conversation c beginning with turns of conversation c - c % 5.

    Its first h = crc32(c) % 9 turns are that one's first h (all it has, if fewer; none if it is
    absent), followed by its own from the one numbered h on.
    """
    turns, sizes = ordered_turns(conversations)
    base = F.expr("conv_id - conv_id % 5")
    heads = sizes.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.least("n", F.lit(8)).alias("base_n"))
    convs = keep(
        sizes.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9})
        .join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .select("conv_id", "first", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "conversations")
    place = F.col("at") - F.col("first")
    own = turns.join(convs, "conv_id").where(place >= F.col("h")).select(
        "conv_id", (F.col("taken") + place - F.col("h") + 1).alias("depth"), "digest", "n_bytes", "length")
    opening = turns.where("conv_id % 5 = 0").join(sizes, "conv_id").where(place < 8).select(
        F.col("conv_id").alias("base"), place.alias("place"), "digest", "n_bytes")
    begun = opening.join(convs, "base").where("place < taken").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "digest", "n_bytes", "length")
    return own.unionByName(begun), convs.select("conv_id", "length")


def _lanes() -> dict[str, Column]:
    low = F.lit(0xFFFFFFFF)
    one, two = F.xxhash64("depth", "digest"), F.xxhash64("digest", F.lit(1), "depth")
    lanes = {"l1": one.bitwiseAND(low), "l2": F.shiftrightunsigned(one, 32), "l3": two.bitwiseAND(low), "l4": F.shiftrightunsigned(two, 32)}
    mark = F.shiftrightunsigned(two, 34) + 1  # above 0, so a node comes after its parent
    for i, name in enumerate(TRAIL):
        lanes[name] = (F.when(F.col("depth") == 2 * i + 1, F.shiftleft(mark, 31))
                       .when(F.col("depth") == 2 * i + 2, mark).otherwise(F.lit(0).cast("long")))
    return lanes


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes)))


def _named(path: DataFrame) -> DataFrame:
    """Add to each turn the name of the node it leads to (sums of lanes and trail up to it)."""
    sums = (*LANES, *TRAIL)
    cut = path.withColumns(_lanes()).withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    cut = cut.withColumns({f"own_{c}": F.col(c) for c in LANES})
    inside = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        cut.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in sums])
        .select("conv_id", "block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"base_{c}") for c in sums])
        .where("block > 0")
    )
    run = cut.withColumns({c: F.sum(c).over(inside) for c in sums})
    return run.join(bases, ["conv_id", "block"], "left").withColumns(
        {c: F.col(c) + F.coalesce(f"base_{c}", F.lit(0)) for c in sums})


def _digested(key_ids: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's ids, ascending and joined by commas.

    Ids are sorted by range over all tasks and joined there; the task that digests a key gets a
    row for some thousand ids and holds one at a time (a digest itself is sequential).
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, ids, number = None, [], 0
            for key, conv_id in _rows(batches):
                if key != current or len(ids) == IDS:
                    if ids:
                        yield current, number, ",".join(ids).encode()
                    current, ids, number = key, [], number + 1
                ids.append(str(conv_id))
            if ids:
                yield current, number, ",".join(ids).encode()

        return _out(rows(), pa.schema([("key", pa.binary()), ("number", pa.int64()), ("ids", pa.binary())]), 100)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, state = None, None
            for key, _, _, ids in _rows(batches):
                if key != current:
                    if state is not None:
                        yield current, state.hexdigest()
                    current, state = key, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if state is not None:
                yield current, state.hexdigest()

        return _out(rows(), pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))

    lists = (
        key_ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInArrow(joined, "key binary, number long, ids binary")
        .select("key", F.spark_partition_id().alias("part"), "number", "ids")
    )
    return lists.repartition("key").sortWithinPartitions("key", "part", "number").mapInArrow(digests, "key binary, ends_sha256 string")


def _shards(nodes: int, cores: int) -> int:
    return max(min(nodes // SMALL, 2 * cores), -(-nodes // LARGE), 1)


def trie_nodes(path: DataFrame, convs: DataFrame, held: int = HELD, shards: int | None = None) -> DataFrame:
    """The trie of the conversations in ``path``, a row per node.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null for the
    root), n_convs (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens
    (over the subtree, members but one times the bytes of the last text), ends_sha256 (digest of
    the ids of members that end here).
    """
    spark = path.sparkSession
    run = keep(_named(path).select(
        "conv_id", "depth", "n_bytes", (F.col("depth") == F.col("length")).alias("end"),
        _key(F.col("depth"), [F.col(c) for c in LANES]).alias("key"),
        _key(F.col("depth") - 1, [F.col(c) - F.col(f"own_{c}") for c in LANES]).alias("parent"), *TRAIL), "trie-turns")
    root_key = _key(F.lit(0), [F.lit(0)] * len(LANES))
    ended = F.when(F.col("end"), F.col("conv_id"))
    counts = (F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count(ended).alias("n_ends"), F.min(ended).alias("an_end"))
    zero = F.lit(0).cast("long")
    root = (
        convs.withColumn("end", F.col("length") == 0).agg(*counts).where("n_convs > 0")
        .select(root_key.alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("n_bytes"),
                *[zero.alias(c) for c in TRAIL], "conv_id", "n_convs", "n_ends", "an_end")
    )
    nodes = keep(
        run.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"),
                               *[F.first(c).alias(c) for c in TRAIL], *counts).unionByName(root), "trie-nodes")
    shards = shards or _shards(nodes.count(), spark.sparkContext.defaultParallelism)
    dealt = keep(nodes.repartitionByRange(shards, *TRAIL, "conv_id", "depth").drop(*TRAIL)
                 .withColumn("shard", F.spark_partition_id()), "trie-shards")
    above = dealt.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("shard").alias("parent_shard"))
    linked = keep(
        dealt.join(above, "parent", "left").withColumns({
            "outer": F.coalesce(F.col("parent_shard") != F.col("shard"), F.lit(False)),
            "own": (F.col("n_convs") - 1) * F.col("n_bytes")}).drop("parent_shard"), "trie-linked")
    totals = subtree_totals(linked, shards, held)
    ends = run.where("end").select("key", "conv_id").unionByName(
        convs.where("length = 0").select(root_key.alias("key"), "conv_id"))
    several = _digested(ends.join(linked.where("n_ends > 1").select("key"), "key", "left_semi"))
    alone = F.when(F.col("n_ends") == 1, F.sha2(F.col("an_end").cast("string"), 256)).otherwise(F.lit(_NO_IDS))
    return linked.join(totals, "key").join(several, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", alone).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations as they are; see :func:`trie_nodes`.

    Null roles and texts count as empty; rows without a conv_id belong to no conversation; repeated
    rows are repeated turns; an empty table has no nodes; further columns are ignored.
    """
    return trie_nodes(*plain_paths(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations that begin with turns of their group's first one; see :func:`rebuilt_paths`."""
    return trie_nodes(*rebuilt_paths(conversations))
