"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Tokens are made once per distinct white-space-free chunk and task, documents longer than a
sequence are cut into full pieces, and what has to be planned is only how many pieces there are of
each length: a table of at most ``capacity`` rows whatever the corpus. The plan fills a bin
greedily with the largest lengths that fit, then takes out the bin's smallest member if two
unplaced pieces fill the widened gap more tightly, and repeats the finished bin as often as its
lengths last. Pieces find their place by rank among the pieces of their length; ranks come from a
place inside their partition plus one offset per (length, partition), so a length shared by a third
of all pieces is spread over many tasks.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tallyscope.llm.common import keep, short_batches, text_of

CAPACITY = 4096
#: Chunks, and pre-tokens, a task remembers (the first ones it meets); bounds memory only.
REMEMBERED = 150_000
#: How the public vocabulary splits lower-case text, for characters below U+0300.
#: Its special strings begin with "<|".
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]"
           r"|(?:[^\t-\r \x85\xa0\w]|_)+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes take the letters from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkIds:
    """Token ids of a text as little-endian 32-bit bytes, remembering chunks between white space.

    The vocabulary drops white space and never joins characters across it, so the ids of a text
    are the ids of its chunks in order. A chunk of characters below U+0300, which are in normal
    form already, is lower-cased and split, and its pre-tokens go to the tokenizer's merge model.
    Other chunks, and those with a special string, go through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._merge = self._tokenizer.model.tokenize
        self._match = re.compile(PATTERN).findall
        self._letters = _byte_letters()
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self._letters)
        ids = [token.id for token in self._merge(spelt)]
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self._pieces) < REMEMBERED:
            self._pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if (chunk.isascii() or max(chunk) < "\u0300") and "<|" not in chunk:
            known = self._pieces.get
            got = b"".join([known(p) or self._piece(p) for p in self._match(chunk.lower())])
        else:
            ids = self._tokenizer.encode(chunk, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self._chunks) < REMEMBERED:
            self._chunks[chunk] = got
        return got

    def of(self, text: str) -> bytes:
        chunks = _split(text)
        got = list(map(self._chunks.get, chunks))
        if None in got:
            got = [self._chunk(c) if g is None else g for c, g in zip(chunks, got)]
        return b"".join(got)


def _split(text: str) -> list[str]:
    """Cut at white space; Python also counts four separators that the vocabulary does not."""
    if any(mark in text for mark in "\x1c\x1d\x1e\x1f"):
        return [c for c in re.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if c]
    return text.split()


_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


def _cut(tokenizer_path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkIds(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        width = 4 * capacity
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(docs, texts):
                ids = ids_of.of(text.as_py()) + end
                for piece, low in enumerate(range(0, len(ids), width)):
                    part = ids[low:low + width]
                    for column, value in zip(rows, (doc, piece, low // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=_PIECES.fieldNames())

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end id, cut at ``capacity``."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
        _cut(tokenizer_path, end_id, capacity), _PIECES)


def _largest(left: np.ndarray, most: int) -> int:
    """Largest length up to ``most`` that is left, 0 if none."""
    found = np.flatnonzero(left[1:most + 1])
    return int(found[-1]) + 1 if len(found) else 0


def _best_two(left: np.ndarray, gap: int) -> tuple[int, int]:
    """Two lengths with the largest sum up to ``gap``; the more even pair on a tie."""
    lengths = np.flatnonzero(left[:gap]).astype(np.int64)
    if not len(lengths):
        return 0, 0
    at = np.searchsorted(lengths, gap - lengths, side="right") - 1
    alone = (at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2)
    at = np.where(alone, at - 1, at)
    usable = (at >= 0) & (lengths[at] <= lengths)
    if not usable.any():
        return 0, 0
    a, b = lengths[usable], lengths[at[usable]]
    best = np.lexsort((a - b, -(a + b)))[0]
    return int(a[best]), int(b[best])


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (member lengths, number of such bins) covering ``counts`` exactly.

    The largest length left opens a bin; the largest that fits the gap is added until none does.
    Then the smallest added member gives way to the two unplaced lengths with the largest sum
    that fits its gap, as long as that leaves less room. The finished bin is repeated until one
    of its lengths would run out, so each step uses up a length or leaves less of it than a bin
    takes, and the number of steps depends on the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan = []
    while True:
        first = _largest(left, capacity)
        if not first:
            return plan
        members, gap = [first], capacity - first
        left[first] -= 1
        while gap and (fit := _largest(left, gap)):
            take = min(int(left[fit]), gap // fit)
            members += [fit] * take
            left[fit] -= take
            gap -= fit * take
        while gap and len(members) > 1:
            smallest = members[-1]
            a, b = _best_two(left, gap + smallest)
            if a + b <= smallest:
                break
            left[smallest] += 1
            left[[a]] -= 1
            left[[b]] -= 1
            gap += smallest - a - b
            members = sorted(members[:-1] + [a, b], reverse=True)
        lengths, uses = np.unique(members, return_counts=True)
        again = int((left[lengths] // uses).min())
        left[lengths] -= again * uses
        plan.append((members, 1 + again))


_SLOTS = T.StructType([
    T.StructField("length", T.LongType()), T.StructField("first_rank", T.LongType()),
    T.StructField("next_rank", T.LongType()), T.StructField("first_sequence", T.LongType()),
    T.StructField("per_sequence", T.LongType()), T.StructField("base_offset", T.LongType()),
])


def plan_slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, ...]]:
    """For each length and bin shape: which ranks of the length go there, and where they lie."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for members, times in plan:
        offset = 0
        lengths, uses = np.unique(members, return_counts=True)
        for length, n in zip(lengths[::-1].tolist(), uses[::-1].tolist()):
            first = used.get(length, 0)
            used[length] = first + n * times
            slots.append((length, first, first + n * times, sequence, n, offset))
            offset += length * n
        sequence += times
    return slots


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Rows may repeat; ties take any of the equal places. An empty table stays empty. Ranks restart
    in every length: the rows are kept with their number inside their (length-sorted) partition,
    and only counts by length and partition are shuffled to find the offsets. All ranks of one
    length in one bin shape are one slot; slots are cut at multiples of ``cell`` ranks and joined
    on (length, cell), so a frequent length is many join keys.
    """
    spark = pieces.sparkSession
    placed = keep(pieces.sortWithinPartitions("length").withColumn("_row", F.monotonically_increasing_id()),
                  "pieces")
    part = F.shiftright("_row", 33)
    runs = placed.groupBy("length", part.alias("_part")).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first"))
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan_slots(plan_bins(counts, capacity))
    total = max(sum(counts.values()), 1)
    cell = max(total // 100_000, 1)
    cut = spark.createDataFrame(slots, _SLOTS).select("*", F.explode(F.sequence(
        F.expr(f"first_rank div {cell}"), F.expr(f"(next_rank - 1) div {cell}"))).alias("_cell"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = runs.select(F.col("length"), "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = (
        placed.withColumn("_part", part).join(base, ["length", "_part"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - F.col("_first"))
        .withColumn("_cell", F.expr(f"_rank div {cell}"))
    )
    rank = F.col("_rank") - F.col("first_rank")
    return (
        ranked.join(cut, ["length", "_cell"])
        .where("_rank >= first_rank and _rank < next_rank")
        .select(*pieces.columns,
                (F.col("first_sequence") + F.expr("(_rank - first_rank) div per_sequence")).alias("sequence_id"),
                (F.col("base_offset") + (rank % F.col("per_sequence")) * F.col("length")).alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document (null text: empty) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Empty texts
    are one piece with the end id alone; null ids, repeated rows and further columns are
    accepted, and repeated rows are packed as often as they occur.
    """
    return pack_pieces(cut_documents(docs, tokenizer_path, end_id, capacity), capacity)
