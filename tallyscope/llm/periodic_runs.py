"""Periodic runs of words, by recompression.

The words of a few megabytes of texts are one sequence, a unique separator after each text. Rounds
alternate: a block round gives every maximal block of one symbol a name for (symbol, times), a pair
round splits the symbols in two sides and names every pair that steps from the left to the right
side. Blocks and pairs depend on neighbours only, so equal stretches are named alike except at
their ends, and the names are a run-length grammar of logarithmic height.

How far two places agree is read from the grammar: climb while both places begin equal names, hop
over equal symbols (over whole blocks at once), and walk down where they differ. A run of period q
and length 3q or more holds two neighbouring multiples of q that agree for q words; only such pairs
on the grids of all periods (harmonic in number) are extended to both sides.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import by_size, short_batches, text_of

#: A run has at least this many words and repeats its period this often.
LEAST = 24
TIMES = 3
#: Bytes of texts whose words form one sequence; a longer text is one alone.
TOGETHER = 4 << 20
#: Pairs of places extended at once, which bounds memory only.
QUERIES = 1 << 18
_ROUNDS = 96


def _sides(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A side for each symbol, the same wherever it occurs, another split every round."""
    with np.errstate(over="ignore"):
        mixed = (symbols.astype(np.uint64) + np.uint64(turn << 32)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(63)).astype(bool)


class Grammar:
    """Run-length grammar over ``words``; symbols from ``bars`` on are separators, each unique.

    The sequence must begin and end with a separator. All levels lie behind each other in flat
    arrays, level 0 first, so a place is one number. ``up`` is the name a symbol became part of
    (-1 on the top level), ``first`` and ``last`` say whether it begins or ends it, ``left`` and
    ``right`` are a name's outer symbols one level down, ``ahead`` and ``behind`` count the equal
    symbols from a place to the end or the beginning of its block.
    """

    def __init__(self, words: np.ndarray, bars: int) -> None:
        self.size = len(words)
        level = words.astype(np.int64)
        fresh = int(level.max()) + 1
        names = {k: [] for k in ("symbol", "up", "first", "last", "ahead", "behind")}
        outer_left, outer_right = [np.full(len(level), -1)], [np.full(len(level), -1)]
        top = bars_seen = int((level >= bars).sum())
        upper, base = fresh, 0
        for turn in range(_ROUNDS):
            if len(level) <= top + bars_seen:
                break
            bar = (level >= bars) & (level < upper)
            if turn % 2 == 0:
                starts = np.r_[True, level[1:] != level[:-1]]
                named = "block"
            else:
                right = _sides(level, turn)
                joined = np.r_[False, ~right[:-1] & right[1:] & ~bar[:-1] & ~bar[1:]]
                starts = ~joined
                named = "pair"
            at = np.flatnonzero(starts)
            if len(at) == len(level):
                continue
            sizes = np.diff(np.r_[at, len(level)])
            above = level[at]
            many = np.flatnonzero(sizes > 1)
            head = above[many]
            other = sizes[many] if named == "block" else level[at[many] + 1]
            codes = pd.factorize(head * (fresh + self.size + 1) + other)[0]
            above[many] = fresh + codes
            fresh += int(codes.max()) + 1
            group = np.cumsum(starts) - 1
            ends = at + sizes - 1
            names["symbol"].append(level)
            names["up"].append(base + len(level) + group)
            names["first"].append(starts)
            last = np.zeros(len(level), bool)
            last[ends] = True
            names["last"].append(last)
            place = np.arange(len(level))
            if named == "block":
                names["ahead"].append(ends[group] - place + 1)
                names["behind"].append(place - at[group] + 1)
            else:
                names["ahead"].append(np.ones(len(level), np.int64))
                names["behind"].append(names["ahead"][-1])
            outer_left.append(base + at)
            outer_right.append(base + ends)
            base += len(level)
            level = above
        names["symbol"].append(level)
        names["up"].append(np.full(len(level), -1))
        for k in ("first", "last"):
            names[k].append(np.zeros(len(level), bool))
        for k in ("ahead", "behind"):
            names[k].append(np.ones(len(level), np.int64))
        flat = {k: np.concatenate(v) for k, v in names.items()}
        self.symbol, self.up = flat["symbol"], flat["up"]
        self.first, self.last = flat["first"], flat["last"]
        self.ahead, self.behind = flat["ahead"], flat["behind"]
        self.left, self.right = np.concatenate(outer_left), np.concatenate(outer_right)

    def _agree(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """Level-0 places, walking from x and y in direction ``step``, of x's first difference."""
        edge, down, block = (self.first, self.left, self.ahead) if step > 0 else (self.last, self.right, self.behind)
        out = np.empty(len(x), np.int64)
        live, a, b = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
        climbing = np.ones(len(x), bool)
        while len(live):
            above_a, above_b = self.up[a], self.up[b]
            rise = climbing & edge[a] & edge[b] & (above_a >= 0) & (self.symbol[above_a] == self.symbol[above_b])
            same = ~rise & (self.symbol[a] == self.symbol[b])
            differ = ~rise & ~same
            hop = np.where(same, np.minimum(block[a], block[b]), 0) * step
            ground = differ & (a < self.size)
            out[live[ground]] = a[ground]
            sink = differ & ~ground
            a = np.where(rise, above_a, np.where(sink, down[a], a + hop))
            b = np.where(rise, above_b, np.where(sink, down[b], b + hop))
            climbing &= ~differ
            if ground.any():
                on = ~ground
                live, a, b, climbing = live[on], a[on], b[on], climbing[on]
        return out

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y on are equal."""
        return self._agree(x, y, 1) - x

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x and before y are equal."""
        return x - 1 - self._agree(x - 1, y - 1, -1)


def _grid(words: np.ndarray, ends: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x = k*p and periods p in [low, high) whose first two words agree p words on, inside one text."""
    found_x, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(words)

    def add(x: np.ndarray, p: np.ndarray) -> None:
        fits = x + 2 * p <= ends[x]
        x, p = x[fits], p[fits]
        close = (p == 1) | (words[x + 1] == words[x + 1 + p])
        found_x.append(x[close])
        found_p.append(p[close])

    if high - low <= n // low:  # few periods with many multiples each
        for p in range(low, high):
            x = np.flatnonzero(words[:n - p:p] == words[p::p]) * p
            if len(x):
                add(x, np.full(len(x), p))
    else:
        for k in range(n // low + 1):
            p = np.arange(low, min(high, (n - 1) // (k + 1) + 1))
            p = p[words[k * p] == words[(k + 1) * p]]
            if len(p):
                add(k * p, p)
    return np.concatenate(found_x), np.concatenate(found_p)


def runs_in(words: np.ndarray, bars: int) -> np.ndarray:
    """(start, end, smallest period) of all runs in a sequence as :class:`Grammar` takes it, by start and period."""
    bar = np.flatnonzero(words >= bars)
    sizes = np.diff(bar) - 1
    most = int(sizes.max(initial=0)) // TIMES
    if not most or sizes.max() < LEAST:
        return np.zeros((0, 3), np.int64)
    ends = bar[np.minimum(np.searchsorted(bar, np.arange(len(words)), side="left"), len(bar) - 1)]
    grammar, found = None, []
    covered, period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    low = 1
    while low <= most:
        high = min(2 * low, most + 1)
        x, p = _grid(words, ends, low, high)
        # a multiple of a known run's period inside that run is the same run again
        known = (covered[x] >= x + 2 * p) & (p % period[x] == 0)
        x, p = x[~known], p[~known]
        if len(x) and grammar is None:
            grammar = Grammar(words, bars)
        new = []
        for at in range(0, len(x), QUERIES):
            here, q = x[at:at + QUERIES], p[at:at + QUERIES]
            after = grammar.forward(here, here + q)
            long = after >= q
            here, q, after = here[long], q[long], after[long]
            start = here - grammar.backward(here, here + q)
            end = here + q + after
            fits = (here - start < q) & (end - start >= np.maximum(TIMES * q, LEAST))
            new.append(np.stack([start[fits], end[fits], q[fits]], 1))
        low = high
        if new:
            new = np.concatenate(new)
            found.append(new)
            for s, e, q in new[::-1].tolist():
                covered[s:e], period[s:e] = e, q
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    alone = np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)]  # smallest period of each stretch
    every = every[alone]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def text_runs(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """For each UTF-8 text its runs as (start, length, period) and the words kept, joined by a space.

    Words are what lies between ASCII white space, which is what ``bytes.split`` gives.
    """
    ids = _Ids()
    split = [t.split() for t in texts]
    places = np.cumsum([0] + [len(w) + 1 for w in split]) + 1
    words = np.empty(int(places[-1]), np.int64)
    for at, own in zip(places.tolist(), split):
        words[at:at + len(own)] = np.fromiter(map(ids.__getitem__, own), np.int64, len(own))
    bars = len(ids)
    words[places - 1] = bars + np.arange(len(places))
    every = runs_in(words, bars)
    owner = np.searchsorted(places, every[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs, kept = [], []
    for i, own in enumerate(split):
        here = every[cuts[i]:cuts[i + 1]]
        start = here[:, 0] - places[i]
        runs.append(np.stack([start, here[:, 1] - here[:, 0], here[:, 2]], 1))
        if len(here):
            stay = np.ones(len(own), bool)
            for s, length, q in runs[-1].tolist():
                stay[s + q:s + length] = False
            own = compress(own, stay.tolist())
        kept.append(b" ".join(own))
    return runs, kept


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
                     T.StructField("collapsed", T.StringType())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [v.as_buffer().to_pybytes() for v in batch.column(1)]
        for a, b in by_size([len(t) for t in texts], TOGETHER):
            runs, kept = text_runs(texts[a:b])
            offsets = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
            columns = np.concatenate(runs).T
            items = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, items), pa.array(kept, pa.binary()).cast(pa.string())],
                names=RUNS.fieldNames())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for every row.

    ``runs`` holds (start, length, period) of every run by start and period: a stretch of at least
    ``LEAST`` words and ``TIMES`` periods, with its smallest period, that no neighbouring word
    extends. ``collapsed`` is the text without the words that any run repeats after its first
    period, joined by a space. Null texts and texts without words have no runs and an empty
    ``collapsed``; repeated rows and null ids give a row each; further columns are ignored.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_search, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by crc32 of the id, ends in a repeated stretch of its own words.

    With h the crc32 and g = h div 10, texts with h % 10 = 0 and n > 0 words repeat, from word
    a = g % n on, the p = 1 + (n - a) div (3 + g % 8) words there. A null id changes nothing.
    """
    h = F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary"))
    words = F.expr(r"filter(split(_text, '[\\x20\\x09-\\x0D]+'), w -> w != '')")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("_text"), (h % 10 == 0).alias("_turn"),
                        F.expr("crc32(cast(cast(doc_id as bigint) as string)) div 10").alias("_g"))
    cut = plain.withColumn("_words", F.when(F.col("_turn"), words)).withColumn("_n", F.size("_words"))
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    cut = cut.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    again = F.expr("""concat(slice(_words, 1, _a),
        slice(flatten(array_repeat(slice(_words, _a + 1, _p), int(ceil((_n - _a) / _p)))), 1, _n - _a))""")
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("_text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document of :func:`with_planted_runs`: number of runs, the run with the greatest exponent, digests of runs and kept words."""
    found = periodic_runs(with_planted_runs(docs))
    best = F.expr("""array_sort(runs, (a, b) -> case
        when a.length * b.period > b.length * a.period then -1 when a.length * b.period < b.length * a.period then 1
        when a.start < b.start then -1 when a.start > b.start then 1
        when a.period < b.period then -1 when a.period > b.period then 1 else 0 end)""")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    top = F.get(best, F.lit(0))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, top).alias("_top"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", *[F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
