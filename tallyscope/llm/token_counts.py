"""Tokens per document from one count per distinct pre-token.

A byte-level vocabulary never merges across pre-tokens, so a document's token count is the sum
over its pre-tokens of their piece counts. Pre-tokens are counted over the corpus, the pieces of
each distinct one are counted once by the tokenizer, and documents only carry (pre-token,
frequency) pairs; no token ids are built. The most frequent pre-tokens, a bounded number, are
broadcast; all others are joined by a shuffle, which by construction holds no frequent key.
"""
from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import head_floor, keep, short_batches, text_of

#: Fixed value: the special string of the public byte-level vocabulary.
SPECIAL = "<|endoftext|>"
#: Characters below this one are classed by the tables here; texts with others go to the tokenizer's own splitter.
PLAIN = 0x500


def _letters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


#: Fixed value: the white space of the vocabulary's pattern below ``PLAIN``.
_SPACE = r"\t-\r \x85\xa0"
#: Fixed value: the vocabulary's pre-token pattern, its character classes written out.
PATTERN = (rf"'(?:[stmd]|re|ve|ll)| ?[{_letters('L')}]+| ?[{_letters('N')}]+| ?[^{_SPACE}{_letters('L')}{_letters('N')}]+"
           rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Pre-tokens that are broadcast at most (about 20 MB), whatever the corpus.
HEAD = 200_000
#: Pre-tokens a task counts before it sends them on; bounds memory only.
REMEMBERED = 500_000
LIMIT = 512


class PreTokens:
    """Pre-token frequencies of texts, split by one compiled pattern with written-out character classes."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self._match = re.compile(PATTERN).findall
        self._own = Tokenizer.from_file(tokenizer_path).pre_tokenizer

    def _split(self, text: str) -> list[str]:
        if text.isascii() or ord(max(text)) < PLAIN:
            return self._match(text)
        return [text[a:b] for _, (a, b) in self._own.pre_tokenize_str(text)]

    def add(self, text: str, counts: Counter) -> None:
        """Add the frequencies of a text to ``counts``."""
        if SPECIAL not in text:
            counts.update(self._split(text))
            return
        parts = text.split(SPECIAL)
        counts[SPECIAL] += len(parts) - 1
        for part in parts:
            counts.update(self._split(part))


_COUNTS = T.StructType([T.StructField("pre", T.StringType()), T.StructField("n", T.LongType())])


def _counted(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pre", "n"])


def _count(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = PreTokens(tokenizer_path), Counter()
        for batch in batches:
            for text in batch.column(0):
                split.add(text.as_py(), total)
                if len(total) > REMEMBERED:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    return run


_PIECES = T.StructType([*_COUNTS.fields, T.StructField("pieces", T.LongType())])


def _pieces(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            pre = batch.column(0).to_pylist()
            counts: list[int] = []
            for at in range(0, len(pre), 1024):
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(pre[at:at + 1024], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["pre", "n", "pieces"])

    return run


_DOCS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("known", T.LongType()),
    T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("freq", T.ArrayType(T.LongType())),
])


def _per_document(tokenizer_path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = PreTokens(tokenizer_path), head.value
        for batch in batches:
            n_bytes, known, rare, freq = [], [], [], []
            for value in batch.column(2):
                total, names, times, counts = 0, [], [], Counter()
                split.add(value.as_py(), counts)
                for piece, n in counts.items():
                    got = pieces.get(piece)
                    if got is None:
                        names.append(piece)
                        times.append(n)
                    else:
                        total += n * got
                n_bytes.append(value.as_buffer().size)
                known.append(total)
                rare.append(names)
                freq.append(times)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()),
                pa.array(rare, pa.list_(pa.string())), pa.array(freq, pa.list_(pa.int64()))], names=_DOCS.fieldNames())

    return run


def pre_token_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(pre, n, pieces): distinct pre-tokens of all texts, how often they occur, their token count."""
    counts = docs.select(text_of(docs).alias("text")).mapInArrow(_count(tokenizer_path), _COUNTS)
    return counts.groupBy("pre").agg(F.sum("n").alias("n")).mapInArrow(_pieces(tokenizer_path), _PIECES)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Null texts count as empty: no bytes, no tokens. Repeated rows and null ids give a row each;
    further columns are ignored; an empty table gives no rows.
    """
    spark = short_batches(docs.sparkSession)
    pieces = keep(pre_token_pieces(docs, tokenizer_path), "pre-tokens")
    floor = head_floor(pieces, "n", HEAD)
    top = pieces.where(F.col("n") >= floor).select("pre", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top["pre"].to_pylist(), top["pieces"].to_pylist())))
    rows = keep(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                    text_of(docs).alias("text")).mapInArrow(_per_document(tokenizer_path, head), _DOCS), "rare-pre-tokens")
    rest = (
        rows.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "freq")).alias("p"))
        .select("row", F.col("p.rare").alias("pre"), F.col("p.freq").alias("freq"))
        .join(pieces.where(F.col("n") < floor).select("pre", "pieces"), "pre")
        .groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    )
    tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.drop("rare", "freq").join(rest, "row", "left").select(
        "doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
