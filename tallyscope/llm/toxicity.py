"""Toxicity from bags of character n-grams: averaged embeddings under a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a passage of a few words is the
mean of its words, and a softmax on that mean gives the probability of the toxic label. Embeddings
and softmax are trained together in numpy. Labels are per document while the offending words are
few, so a document scores as its most toxic passage, and training follows suit: the first passes
spread a document's label over all its passages, later ones put it on the highest-scoring one and
hold all passages of clean documents down. A misspelt word shares most n-grams with the known one.

The fit uses a bounded sample of labelled documents (``SAMPLE`` per label and ``SAMPLE_BYTES`` of
whole texts) and runs in a task, so the driver meets neither texts nor embeddings; scoring covers
every whole text and needs one number per n-gram bucket.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyscope.llm.common import fold, short_batches, text_of

SAMPLE = (3000, 2000)
SAMPLE_BYTES = 40 << 20
#: Bytes of a text that the fit still takes.
LONGEST_TEXT = 1 << 20
BUCKETS = 1 << 17
DIMENSION = 8
GRAMS = (3, 4, 5)
PASSAGE = 5
THRESHOLD = 0.7
#: Words a task remembers (about the first it meets); bounds memory only.
REMEMBERED = 200_000
#: Distinct words of a mini-batch whose n-grams are gathered at once; bounds memory only.
WORDS = 20_000
_EDGES = ".,;:!?\"'()[]{}<>*_#|-…«»„“”"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of ``<word>`` and the whole word, flat, and how many each has."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = ends[owner] - np.arange(len(data))
    prime = np.uint64(0x100000001B3)
    found, owners = [], []
    rolling = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[:len(data) - n + 1] = data[n - 1:]
        rolling = (rolling ^ shifted) * prime
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            found.append(rolling[at] ^ rolling[at] >> np.uint64(29))
            owners.append(owner[at])
    starts = ends - sizes
    total = np.cumsum(data * (np.arange(len(data)).astype(np.uint64) - np.repeat(starts, sizes).astype(np.uint64) + np.uint64(7)) ** np.uint64(3) * prime)
    whole = total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(raw) else np.zeros(0, np.uint64)
    found.append(whole * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))
    owners.append(np.arange(len(raw)))
    bucket, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(raw))


def _grams_of(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`grams` of many words in small steps and narrow integers."""
    parts = [grams(words[at:at + at_once]) for at in range(0, len(words), at_once)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0].astype(np.int32) for p in parts]), np.concatenate([p[1] for p in parts])


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


@dataclass
class Model:
    """What scoring needs: the softmax logit each bucket's vector adds, the bias, the logit without words."""
    weights: np.ndarray
    bias: float
    empty: float

    def words(self, words: list[str]) -> np.ndarray:
        """Logit of each word: the mean over its n-grams."""
        if not words:
            return np.zeros(0)
        buckets, n = grams(words)
        return np.add.reduceat(self.weights[buckets], np.cumsum(n) - n) / n


class Scorer:
    def __init__(self, model: Model) -> None:
        self._model, self._known, self._rest = model, {}, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Probability of the toxic label for whole texts: that of the most toxic passage."""
        split = [t.split() for t in texts]
        known = self._known
        new = list({w for words in split for w in words if w not in known})
        self._rest = {}
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            (known if len(known) < REMEMBERED else self._rest).update(
                zip(part, self._model.words([bare(w) for w in part]).tolist()))
        top = np.array([self._top(words) if words else self._model.empty - self._model.bias for words in split])
        return 1 / (1 + np.exp(-np.clip(top + self._model.bias, -30, 30)))

    def _top(self, words: list[str]) -> float:
        known = self._known.get
        rest = self._rest
        logits = np.fromiter((rest[w] if (s := known(w)) is None else s for w in words), np.float64, len(words))
        whole = len(logits) // PASSAGE * PASSAGE
        best = logits[:whole].reshape(-1, PASSAGE).mean(1).max() if whole else -np.inf
        return float(max(best, logits[whole:].mean()) if whole < len(logits) else best)


def _passages(texts: list[str], ids: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word numbers of each text and the passage each belongs to; new words get the next number."""
    out = []
    for text in texts:
        words = [bare(w) for w in text.split()]
        numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        out.append((numbers, np.arange(len(words), dtype=np.int32) // PASSAGE))
    return out


def _summed(values: np.ndarray, times: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values``, each repeated ``times``, added up by ``index``; one column at a time."""
    return np.stack([np.bincount(index, np.repeat(column, times), size) for column in values.T], axis=1)


def _word_sums(vectors: np.ndarray, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each word's n-gram vectors, for ``WORDS`` words at a time."""
    ends = np.r_[starts[1:], len(gram)]
    return np.concatenate([
        np.add.reduceat(vectors[gram[starts[at]:ends[min(at + WORDS, len(starts)) - 1]]], starts[at:at + WORDS] - starts[at], axis=0)
        for at in range(0, len(starts), WORDS)])


def fit(texts: list[str], labels: list[int], rounds: int = 6, steps: int = 400, batch: int = 64, rate: float = 0.5, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly, then calibrate on a fifth of the sample kept apart.

    There are at least ``rounds`` passes over the sample and ``steps`` mini-batches.

    Without both labels there is nothing to tell apart: the model then returns the share of toxic
    labels (0.5 of no labels) for every text.
    """
    target = np.asarray(labels, np.float64)
    share = min(max(float(target.mean()) if len(target) else 0.5, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    if not len(target) or target.min() == target.max():
        return Model(np.zeros(BUCKETS), prior, prior)
    apart = np.arange(len(target)) % 5 == 4
    if len(np.unique(target[apart])) < 2 or len(np.unique(target[~apart])) < 2:
        apart[:] = False
    rounds = max(rounds, -(-steps // -(-int((~apart).sum()) // batch)))
    model = _trained([t for t, a in zip(texts, apart) if not a], target[~apart], rounds, batch, rate, seed)
    model.empty = min(prior, 0.0)
    if not apart.any():
        return model
    chance = Scorer(model)([t for t, a in zip(texts, apart) if a])
    scale, shift = _calibration(np.log(chance / (1 - chance)), target[apart])
    return Model(model.weights * scale, model.bias * scale + shift, model.empty)


def _calibration(logits: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logit by penalised logistic regression; they only take confidence away."""
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    w, pull = np.array([1.0, 0.0]), np.array([1e-2, 1e-2])
    start = w.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + pull * (w - start)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        w = np.array([min(max(w[0], 0.05), 1.0), min(w[1], 0.0)])
    return float(w[0]), float(w[1])


def _trained(texts: list[str], target: np.ndarray, rounds: int, batch: int, rate: float, seed: int) -> Model:
    """Mini-batches with adaptive steps over documents cut into passages."""
    ids: dict[str, int] = {}
    docs = _passages(texts, ids)
    buckets, n = _grams_of(list(ids))
    begin = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    softmax = rng.normal(0, 0.1, (DIMENSION, 2))
    bias = np.zeros(2)
    grown, grown_s, grown_b = np.full(BUCKETS, 1e-6), np.full(softmax.shape, 1e-6), np.full(2, 1e-6)
    number = np.zeros(BUCKETS, np.int64)
    for turn in range(rounds):
        order = rng.permutation(len(docs))
        for low in range(0, len(order), batch):
            chosen = [i for i in order[low:low + batch] if len(docs[i][0])]
            if not chosen:
                continue
            words = np.concatenate([docs[i][0] for i in chosen])
            used = np.flatnonzero(np.bincount(words, minlength=len(n)))
            word = np.searchsorted(used, words)
            count = n[used]
            starts = np.cumsum(count) - count
            gram = buckets[np.repeat(begin[used] - starts, count) + np.arange(count.sum())]
            touched = np.flatnonzero(np.bincount(gram, minlength=BUCKETS))
            number[touched] = np.arange(len(touched))
            where = number[gram]
            word_vec = _word_sums(vectors, gram, starts) / count[:, None]
            sizes = [int(docs[i][1][-1]) + 1 for i in chosen]
            first = np.cumsum(sizes) - sizes
            passage = np.concatenate([docs[i][1] + f for i, f in zip(chosen, first)])
            cut = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            length = np.diff(np.r_[cut, len(passage)])
            mean = np.stack([np.add.reduceat(column[word], cut) for column in word_vec.T], axis=1) / length[:, None]
            logits = mean @ softmax + bias
            chance = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
            doc = np.repeat(np.arange(len(chosen)), sizes)
            label = target[np.asarray(chosen)]
            if turn < max(2, rounds // 3):
                weight = (1 / np.asarray(sizes, np.float64))[doc]
            else:
                peak = np.maximum.reduceat(chance, first)[doc]
                weight = np.where(chance >= peak, 1.0, np.where(label[doc] == 0, 0.02, 0.0))
            weight = weight * np.where(label[doc] == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())) / len(chosen)
            slope = (weight * (chance - label[doc]))[:, None] * np.array([[-1.0, 1.0]])
            to_softmax, to_bias = mean.T @ slope, slope.sum(0)
            to_passage = slope @ softmax.T / length[:, None]
            to_word = _summed(to_passage, length, word, len(used))
            total = _summed(to_word / count[:, None], count, where, len(touched))
            grown[touched] += (total ** 2).mean(1)
            vectors[touched] -= rate * total / np.sqrt(grown[touched])[:, None]
            grown_s += to_softmax ** 2
            softmax -= 0.2 * rate * to_softmax / np.sqrt(grown_s)
            grown_b += to_bias ** 2
            bias -= 0.2 * rate * to_bias / np.sqrt(grown_b)
    return Model(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, text, toxic) of the fit, whole texts: rows outside the held-out part, by order of a hash.

    Takes at most ``SAMPLE`` clean and toxic documents and ``SAMPLE_BYTES`` of text, dealt to the two
    in the same proportion; a text above ``LONGEST_TEXT`` bytes is passed over and the next one taken.
    A document id that occurs more than once gives its smallest text. Null labels are left out; a document labelled more than once is toxic if one label says so.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(labels, "doc_id", parts) != held_out))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    picked = None
    for value, most in enumerate(SAMPLE):
        part = known.where(F.col("toxic") == value).orderBy("place", "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    short = F.octet_length("text") <= LONGEST_TEXT
    texts = (
        docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")).where(short).join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    )
    upto = W.partitionBy("toxic").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    share = F.when(F.col("toxic") == 1, SAMPLE[1] / sum(SAMPLE)).otherwise(SAMPLE[0] / sum(SAMPLE))
    return texts.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= SAMPLE_BYTES * share).select(
        "doc_id", "text", "toxic")


def training_sample(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1) -> tuple[list[str], list[int]]:
    """Texts and labels of :func:`training_rows`, by doc_id."""
    got = training_rows(docs, labels, parts, held_out).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return got["text"].to_pylist(), got["toxic"].to_pylist()


_MODEL = T.StructType([
    T.StructField("weights", T.BinaryType()), T.StructField("bias", T.DoubleType()), T.StructField("empty", T.DoubleType())])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a partition's texts and labels, one row."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    model = fit(texts, labels)
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.empty])], names=_MODEL.fieldNames())


def fitted_model(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1) -> Model:
    """:func:`fit` on :func:`training_rows`, in a task that the bounded sample is brought to; the model is 1 MB."""
    short_batches(docs.sparkSession)
    rows = training_rows(docs, labels, parts, held_out).repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    got = rows.mapInArrow(_fitted, _MODEL).first()
    return fit([], []) if got is None else Model(np.frombuffer(got["weights"]), got["bias"], got["empty"])


def score_column(spark, model: Model):
    """A column function: probability of the toxic label of a text column without nulls."""
    shared = short_batches(spark).sparkContext.broadcast((model.weights, model.bias, model.empty))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*shared.value))
        for texts in batches:
            values = texts.tolist()
            yield pd.Series(np.concatenate([scorer(values[i:i + 512]) for i in range(0, len(values), 512)]) if values else np.zeros(0))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null texts count as empty; texts without words get the share of toxic labels, at most 0.5. Repeated rows and null ids
    (never held out) give a row each; further columns are ignored; without labels every score is 0.5.
    """
    score = score_column(docs.sparkSession, fitted_model(docs, labels, parts, held_out))
    out = F.coalesce(fold(docs, "doc_id", parts) == held_out, F.lit(False))
    return docs.select("doc_id", out.alias("held_out"), score(text_of(docs)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    score = score_column(docs.sparkSession, fitted_model(docs, labels))
    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), score(text_of(docs)).alias("score"))
    return scored.where(F.col("score") < threshold).select("doc.*")
