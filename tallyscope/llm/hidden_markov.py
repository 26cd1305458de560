"""A hidden Markov language model trained by distributed Baum-Welch, scored exactly.

Words of the training part are counted over the corpus. The most frequent ones, a bounded number,
are symbols of their own; the end of a text is another; all other words are one "rare" symbol that
spells out the word by its smoothed share among rare words. Every round of Baum-Welch runs the
scaled forward and backward recursions over all training texts in their partitions and adds up
expected counts by symbol with a shuffle; the model, a table of bounded size, goes back to the
tasks. The score of a text is the exact log-likelihood from the scaled forward recursion, plus the
spelling of its rare words, whose counts are joined by a shuffle.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import fold, head_floor, keep, short_batches, text_of

#: Frequent words with a symbol of their own at most, hidden states, rounds over the corpus.
SYMBOLS = 50_000
STATES = 6
ROUNDS = 3
#: Prior weight of the corpus-wide word shares in each state's emissions.
PULL = 200.0
#: Distinct words a task counts before it sends them on; tokens worked on side by side.
REMEMBERED = 250_000
AT_ONCE = 300_000
END = ""

_COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\t to \\r, A-Z in lower case; ``bytes`` does just that."""
    return text.lower().split()


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        total[b""] += batch.num_rows
        for text in batch.column(0):
            total.update(words(text.as_buffer().to_pybytes()))
            if len(total) > REMEMBERED:
                yield _counted(total)
                total.clear()
    yield _counted(total)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of the tokens of a ``text`` column; the empty word is the end of a text."""
    return texts.select("text").mapInArrow(_count, _COUNTS).groupBy("word").agg(F.sum("n").alias("c"))


_ENCODED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("symbols", T.BinaryType()),
    T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("freq", T.ArrayType(T.LongType())),
])


class _Numbers(dict):
    """Symbol of a word; words without one are rare."""

    def __init__(self, frequent: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.rare = len(frequent)

    def __missing__(self, word: bytes) -> int:
        return self.rare


def _encode(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers(frequent.value)
        for batch in batches:
            n_tokens, symbols, rare, freq = [], [], [], []
            for text in batch.column(3):
                found = words(text.as_buffer().to_pybytes())
                ids = np.fromiter(map(number.__getitem__, found), np.uint16, len(found))
                others = Counter([found[i] for i in np.flatnonzero(ids == number.rare).tolist()])
                n_tokens.append(len(found) + 1)
                symbols.append(ids.tobytes())
                rare.append(list(others))
                freq.append(list(others.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(n_tokens, pa.int64()),
                pa.array(symbols, pa.binary()), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                pa.array(freq, pa.list_(pa.int64()))], names=_ENCODED.fieldNames())

    return run


@dataclass
class Hmm:
    """Start, transition and emission probabilities; emissions are stored by symbol."""
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def _packed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: symbols by time, where each time begins, how many go on, order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    going = len(texts) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), side="right")
    begin = np.cumsum(going) - going
    out = np.empty(sizes.sum(), np.int64)
    flat = np.concatenate([texts[i] for i in order])
    ranked = sizes[order]
    time = np.arange(len(flat)) - np.repeat(np.cumsum(ranked) - ranked, ranked)
    out[begin[time] + np.repeat(np.arange(len(texts)), ranked)] = flat
    return out, begin, going, order


def forward(model: Hmm, texts: list[np.ndarray], keep_all: bool = False) -> tuple:
    """Scaled forward recursion over several sequences at once.

    Returns the natural log-likelihood of each and, if wanted, what the backward recursion needs.
    """
    symbols, begin, going, order = _packed(texts)
    seen = model.emit[symbols]
    logs = np.zeros(len(texts))
    scale = np.empty(len(symbols))
    alpha = np.empty_like(seen) if keep_all else None
    now = model.start * seen[:going[0]]
    for t in range(len(begin)):
        low, n = begin[t], going[t]
        if t:
            now = (now[:n] @ model.step) * seen[low:low + n]
        total = now.sum(1)
        now /= total[:, None]
        scale[low:low + n] = total
        logs[:n] += np.log(total)
        if keep_all:
            seen[low:low + n] /= total[:, None]
            alpha[low:low + n] = now
    out = np.empty(len(texts))
    out[order] = logs
    return (out, symbols, begin, going, seen, alpha) if keep_all else (out,)


def expected(model: Hmm, texts: list[np.ndarray], by_symbol: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> None:
    """Add the expected counts of the sequences (forward-backward) to the three tables."""
    _, symbols, begin, going, seen, alpha = forward(model, texts, keep_all=True)
    last = np.ones((going[-1], len(model.start)))
    for t in range(len(begin) - 1, 0, -1):
        low, n, before = begin[t], going[t], begin[t - 1]
        ahead = seen[low:low + n] * last
        steps += alpha[before:before + n].T @ ahead * model.step
        alpha[low:low + n] *= last
        last = np.ones((going[t - 1], len(model.start)))
        last[:n] = ahead @ model.step.T
    alpha[:going[0]] *= last
    starts += alpha[:going[0]].sum(0)
    for k in range(len(model.start)):
        by_symbol[:, k] += np.bincount(symbols, alpha[:, k], len(by_symbol))


def _expected_schema(states: int) -> T.StructType:
    return T.StructType([T.StructField("symbol", T.IntegerType())] + [T.StructField(f"s{k}", T.DoubleType()) for k in range(states)])


def _groups(batches: Iterator[pa.RecordBatch], column: int, end: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Symbol sequences (the end added) by about ``AT_ONCE`` tokens, with the rows they come from."""
    rows, texts, total = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.frombuffer(batch.column(column)[i].as_buffer() or b"", np.uint16)
            texts.append(np.append(ids, np.uint16(end)).astype(np.int32))
            rows.append([c[i].as_py() for j, c in enumerate(batch.columns) if j != column])
            total += len(texts[-1])
            if total > AT_ONCE:
                yield rows, texts
                rows, texts, total = [], [], 0
    if texts:
        yield rows, texts


def _round(model, end: int):
    """One task's expected counts: rows by symbol, -1-k for transitions from state k, -1-K for starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Hmm(*model.value)
        k = len(hmm.start)
        by_symbol, steps, starts = np.zeros_like(hmm.emit), np.zeros((k, k)), np.zeros(k)
        for _, texts in _groups(batches, 0, end):
            expected(hmm, texts, by_symbol, steps, starts)
        used = np.flatnonzero(by_symbol.any(1))
        table = np.concatenate([by_symbol[used], steps, starts[None]])
        names = np.concatenate([used, -1 - np.arange(k + 1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), *[pa.array(table[:, j]) for j in range(k)]],
            names=_expected_schema(k).fieldNames())

    return run


def _first(states: int, end: int, symbols: int):
    """Counts for the first model: each text wholly in the state of its most frequent symbol.

    Symbols are numbered by frequency, so texts that share a language or kind share that symbol,
    and the numbers of common ones spread over the states.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_symbol, steps, starts = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states)
        for _, texts in _groups(batches, 0, end):
            for ids in texts:
                counts = np.bincount(ids[ids < end - 1]) if len(ids) > 1 else np.zeros(0)
                k = int(counts.argmax()) % states if len(counts) else 0
                by_symbol[:, k] += np.bincount(ids, minlength=symbols)
                steps[k, k] += len(ids) - 1
                starts[k] += 1
        used = np.flatnonzero(by_symbol.any(1))
        table = np.concatenate([by_symbol[used], steps, starts[None]])
        names = np.concatenate([used, -1 - np.arange(states + 1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), *[pa.array(table[:, j]) for j in range(states)]],
            names=_expected_schema(states).fieldNames())

    return run


def _model(totals: pa.Table, states: int, symbols: int, shares: np.ndarray) -> Hmm:
    """Probabilities from expected counts; emissions lean towards the corpus-wide shares."""
    names = totals["symbol"].to_numpy()
    table = np.stack([totals[f"s{k}"].to_numpy() for k in range(states)], axis=1)
    emit, steps, starts = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states)
    emit[names[names >= 0]] = table[names >= 0]
    for name, row in zip(names[names < 0], table[names < 0]):
        if -1 - name < states:
            steps[-1 - name] = row
        else:
            starts = row
    steps += 1.0 + 0.05 * steps.sum(1, keepdims=True) / states
    starts = starts + 1.0
    emit += PULL * shares[:, None]
    return Hmm(starts / starts.sum(), steps / steps.sum(1, keepdims=True), emit / emit.sum(0))


def _score(model, logs, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, base_log = Hmm(*model.value), logs.value
        for rows, texts in _groups(batches, 4, end):
            value = forward(hmm, texts)[0] / np.log(10)
            base = [float(base_log[ids].sum()) for ids in texts]
            known = [int(len(ids) - (ids == end - 1).sum()) for ids in texts]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()),
                pa.array(columns[3], pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(value)],
                names=_SCORED.fieldNames())

    return run


_SCORED = T.StructType([
    *_ENCODED.fields[:4], T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])


def scored_texts(docs: DataFrame, parts: int = 5, held_out: int = 1, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Score every whole text by a model that has learnt from those outside the held-out part.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word shares) and score
    (the model's), both log10. Null texts are empty: one token, the end. Null ids are never held
    out. Repeated rows give a row each; further columns are ignored; with nothing to learn from,
    all words are unknown and both scores still are probabilities.
    """
    spark = short_batches(docs.sparkSession)
    out = F.coalesce(fold(docs, "doc_id", parts) == held_out, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text_of(docs).alias("text"))
    counts = keep(word_counts(source.where(~F.col("held_out"))), "words")
    floor = head_floor(counts, "c", SYMBOLS)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                       F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    top = counts.where((F.col("c") >= floor) & (F.col("word") != END)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    frequent, often = [w.encode() for w in top["word"].to_pylist()], top["c"].to_numpy()
    rare, end = len(frequent), len(frequent) + 1
    n, v = total["n"], total["v"]
    rare_mass = n - int(often.sum()) - total["ends"]
    rare_kinds = v - len(frequent) - (1 if total["ends"] else 0)
    symbols = end + 1
    encoded = keep(
        source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
        .mapInArrow(_encode(spark.sparkContext.broadcast(frequent)), _ENCODED).sortWithinPartitions("n_tokens"), "encoded")
    shares = np.concatenate([often, [rare_mass, total["ends"]]]) + 0.5
    shares = shares / shares.sum()
    learning = encoded.where(~F.col("held_out")).select("symbols")
    schema = _expected_schema(states)
    adding = [F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]
    work = _first(states, end, symbols)
    for _ in range(rounds + 1):
        model = _model(learning.mapInArrow(work, schema).groupBy("symbol").agg(*adding).toArrow(), states, symbols, shares)
        shared = spark.sparkContext.broadcast((model.start, model.step, model.emit))
        work = _round(shared, end)
    half = n + 0.5 * (v + 1)
    base_log = np.log10((np.concatenate([often, [0, total["ends"]]]) + 0.5) / half)
    base_log[rare] = 0.0
    logs = spark.sparkContext.broadcast(base_log)
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "symbols").mapInArrow(_score(shared, logs, end), _SCORED)
    count = F.coalesce("c", F.lit(0)) + 0.5
    spelt = (
        encoded.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "freq")).alias("r"))
        .select("row", F.col("r.rare").alias("word"), F.col("r.freq").alias("freq"))
        .join(counts.where(F.col("c") < floor), "word", "left")
        .groupBy("row").agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("freq")).otherwise(0)).alias("more"),
            F.sum(F.col("freq") * F.log10(count / half)).alias("base_rare"),
            F.sum(F.col("freq") * F.log10(count / (rare_mass + 0.5 * (rare_kinds + 1)))).alias("spelling"))
    )
    zero = F.lit(0)
    ends = 0 if total["ends"] else 1
    return scored.join(spelt, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") - ends + F.coalesce("more", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        (F.col("value") + F.coalesce("spelling", F.lit(0.0))).alias("score"))
