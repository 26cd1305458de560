"""Token counts, fingerprints, media, language model and toxicity against direct computation."""
from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tallyscope.llm import hidden_markov, jpeg_media, shingle_near, simhash_near, token_counts, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string, row long, fp long, score double"


def _rows(texts):
    return [(i, t, "clash", i, 1, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "The", "of", "naïve", "foo.bar", "it's", "x" * 30, "数据", "12,5", "é́", "\x1c", "end"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return made + [None, "", " ", "\n\n a  b\t\tc ", "<|endoftext|>x <|endoftext|>", "a b c d e " * 3000, made[0], made[0], made[1] + " z"]


def test_token_counts(spark, texts):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = _rows(texts) + [(None, "no id", "", 0, 0, 0.0)]
    got = Counter(map(tuple, token_counts.token_counts(spark.createDataFrame(rows, DOCS), BYTES).collect()))
    want = Counter()
    for doc, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want[doc, len((text or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), BYTES).count() == 0


def test_token_counts_without_a_head(spark, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD", 2)
    test_token_counts(spark, texts)


def test_pre_tokens_follow_the_splitter():
    tokenizer = Tokenizer.from_file(BYTES)
    split = token_counts.PreTokens(BYTES)
    for low in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}b " for c in range(low, low + 64))
        counts = Counter()
        split.add(text, counts)
        assert counts == Counter(text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text))


def _fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows):
    prints = {t: _fingerprint(t or "") for _, t, *_ in rows}
    values = sorted(set(prints.values()))
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                group[root(b)] = root(a)
    low = {}
    for doc, text, *_ in rows:
        r = root(prints[text])
        if doc is not None:
            low[r] = min(low.get(r, doc), doc)
    return Counter((doc, f"{prints[t]:016x}", low.get(root(prints[t]))) for doc, t, *_ in rows)


def _near_rows():
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(25)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 12)):
            copy = list(words)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    return _rows(texts + [None, "", "one", "ONE", "a b c", " "] + texts[:5]) + [(None, texts[0], "", 0, 0, 0.0)]


@pytest.mark.parametrize("block", [4096, 14])
def test_near_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_near, "BLOCK", block)
    rows = _near_rows()
    df = spark.createDataFrame(rows, DOCS)
    want = _components(rows)
    assert Counter(map(tuple, simhash_near.near_components(df).collect())) == want
    kept = simhash_near.one_per_class(df).collect()
    assert len(kept) == len({c for _, _, c in want})
    assert {r.doc_id for r in kept} == {c for _, _, c in want}
    assert kept[0].__fields__ == df.columns


def test_near_components_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash_near.near_components(empty).count() == 0
    assert simhash_near.one_per_class(empty).count() == 0


def test_chain_filter_loses_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b ^= 1 << int(bit)
        left, right = np.full(5, a, np.uint64), np.full(5, b, np.uint64)
        starts = np.arange(5)
        equal = np.array([((a ^ b) >> low & (1 << width) - 1) == 0 for low, width in simhash_near.SEGMENTS])
        kept = simhash_near._linked(left, right, starts)
        assert any(equal[k] for k in kept)


def _five(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


@pytest.mark.parametrize("block", [256, 3])
def test_near_copies_of_the_pipeline(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_near, "BLOCK", block)
    rows = _near_rows()
    # a different text under the same dominating shingles: near fingerprints, no copy
    rows += [(9000 + i, "la " * 400 + " ".join(f"{name}{k}" for k in range(40)), "", 0, 0, 0.0) for i, name in enumerate("xy")]
    sets = {r[1]: _five(r[1]) for r in rows}
    texts = list(sets)
    group = {t: t for t in texts}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[root(b)] = root(a)
    low = {}
    for doc, text, *_ in rows:
        if doc is not None:
            low[root(text)] = min(low.get(root(text), doc), doc)
    df = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(low.values())
    assert {9000, 9001} <= set(low.values()) and kept[0].__fields__ == df.columns
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_near_copies_meet_in_simhash_classes(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    near, other = [*words[:399], "changed"], [f"o{i}" for i in range(400)]
    sets = spark.createDataFrame([(i, [], i) for i in range(3)], "digest long, keys array<long>, row long")
    texts = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, near, other))], "row long, text string")
    together = spark.createDataFrame([(0, 7), (1, 7), (2, 7)], "digest long, key long")
    assert sorted(map(tuple, shingle_near.similar_classes(sets, texts, together).collect())) == [(0, 0), (1, 0)]
    seen, classes = [], simhash_near.near_classes
    monkeypatch.setattr(simhash_near, "near_classes", lambda fps: seen.append(fps.count()) or classes(fps))
    df = spark.createDataFrame(_rows([" ".join(t) for t in (words, near, other, other)]), DOCS)
    assert corpus_pipeline.drop_near_copies(spark, df, "").count() == 2
    assert len(seen) == 1 and seen[0] in (2, 3)


def test_stored_texts(spark, texts):
    rows = _rows(texts + ["ÿ" * 300_000])
    for r in jpeg_media.stored_texts(spark.createDataFrame(rows, DOCS)).collect():
        raw = (rows[r.doc_id][1] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = jpeg_media.encode_payloads([payload])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert jpeg_media.stored_texts(spark.createDataFrame([], DOCS)).count() == 0


def _colour_jpeg(rng, width, height, interval):
    """A three-component image with 2x2 luminance sampling and random AC values, and its luminance DC levels."""
    lengths, symbols = (0, 0, 0, 0, 0, 0, 0, 255, 1, *[0] * 7), bytes(range(256))
    table = {s: (code, n) for s, code, n in jpeg_media._codes(lengths, symbols)}
    units_x, units_y = -(-width // 16), -(-height // 16)
    bits, out, levels = "", b"", np.zeros((units_y * 2, units_x * 2), int)
    predicted = [0, 0, 0]

    def put(symbol, value=0, size=0):
        code, n = table[symbol]
        text = f"{code:0{n}b}"
        if size:
            text += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"
        return text

    count = 0
    for y in range(units_y):
        for x in range(units_x):
            for block, c in enumerate((0, 0, 0, 0, 1, 2)):
                level = int(rng.integers(-60, 60))
                if c == 0:
                    levels[2 * y + block // 2, 2 * x + block % 2] = level
                diff = level - predicted[c]
                predicted[c] = level
                bits += put(abs(diff).bit_length(), diff, abs(diff).bit_length())
                k = 1
                while k < 64 and rng.random() < 0.7:
                    run = int(rng.integers(0, 18))
                    if run > 15:
                        bits += put(0xF0)
                        k += 16
                        continue
                    if k + run > 63:
                        break
                    value = int(rng.integers(1, 30)) * (1 if rng.random() < 0.5 else -1)
                    bits += put(run << 4 | abs(value).bit_length(), value, abs(value).bit_length())
                    k += run + 1
                if k < 64:
                    bits += put(0)
            count += 1
            if interval and count % interval == 0 and count < units_x * units_y:
                bits += "1" * (-len(bits) % 8)
                out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + bytes((0xFF, 0xD0 + (count // interval - 1) % 8))
                bits, predicted = "", [0, 0, 0]
    bits += "1" * (-len(bits) % 8)
    out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg_media._segment
    return levels[:-(-height // 8), :-(-width // 8)], b"".join((
        b"\xff\xd8", seg(0xE0, b"JFIF\0"), seg(0xDB, bytes([0, 4]) + bytes([1] * 63) + bytes([1, 9]) + bytes([1] * 63)),
        seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])),
        seg(0xC4, bytes([0, *lengths]) + symbols), seg(0xC4, bytes([0x10, *lengths]) + symbols),
        seg(0xDD, interval.to_bytes(2, "big")) if interval else b"",
        seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), out, b"\xff\xd9"))


@pytest.mark.parametrize("interval", [0, 3])
def test_colour_images_with_detail(spark, interval):
    rng = np.random.default_rng(4)
    made = [_colour_jpeg(rng, w, h, interval) for w, h in ((40, 24), (17, 50), (8, 8))]
    rows = [(i, bytearray(image)) for i, (_, image) in enumerate(made)]
    rows += [(10, None), (11, bytearray(b"")), (12, bytearray(b"GIF89a")), (13, bytearray(made[0][1][:200])), (14, bytearray(b"\xff\xd8\xff\xd9"))]
    got = {r.key: r for r in jpeg_media.image_features(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()}
    for i, (levels, _) in enumerate(made):
        want = np.clip(np.floor_divide(levels * 4 + 4, 8) + 128, 0, 255).astype(np.uint8)
        assert got[i].thumbnail == want.tobytes() and got[i].problem is None
    assert all(got[i].width is None and got[i].problem for i in range(10, 15))


def _forward(model, ids):
    p = model.start * model.emit[ids[0]]
    for i in ids[1:]:
        p = (p @ model.step) * model.emit[i]
    return math.log(p.sum())


def test_forward_and_expected_counts():
    rng = np.random.default_rng(1)
    model = hidden_markov.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T.copy())
    seqs = [rng.integers(0, 7, n) for n in (1, 5, 2, 9, 5)]
    assert np.allclose(hidden_markov.forward(model, seqs)[0], [_forward(model, s) for s in seqs])
    by_symbol, steps, starts = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3)
    hidden_markov.expected(model, seqs, by_symbol, steps, starts)
    want_symbol, want_steps, want_starts = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3)
    for s in seqs:  # all paths
        paths = np.array(np.meshgrid(*[range(3)] * len(s), indexing="ij")).reshape(len(s), -1).T
        w = np.array([model.start[p[0]] * np.prod(model.emit[s, p]) * np.prod(model.step[p[:-1], p[1:]]) for p in paths])
        w /= w.sum()
        for p, v in zip(paths, w):
            want_starts[p[0]] += v
            np.add.at(want_symbol, (s, p), v)
            np.add.at(want_steps, (p[:-1], p[1:]), v)
    assert np.allclose(by_symbol, want_symbol) and np.allclose(steps, want_steps) and np.allclose(starts, want_starts)


@pytest.mark.parametrize("symbols", [50_000, 3])
def test_language_model(spark, texts, monkeypatch, symbols):
    monkeypatch.setattr(hidden_markov, "SYMBOLS", symbols)
    rows = _rows(texts) + [(None, "No id", "", 0, 0, 0.0)]
    got = hidden_markov.scored_texts(spark.createDataFrame(rows, DOCS)).collect()
    counts, held = Counter(), {}
    for doc, text, *_ in rows:
        held[doc] = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
        if not held[doc]:
            counts.update([*(text or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    by_doc = {doc: (text or "").encode().lower().split() + [b""] for doc, text, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = by_doc[r.doc_id]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert hidden_markov.scored_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_model_is_a_distribution(spark):
    """Probabilities of all texts of up to two words (unknown ones as one) stay below one, and nearly add up with length."""
    rows = [(i, t) for i, t in enumerate(["a b a", "b b", "a", "c a b", "a b", "b"] * 4)]
    seen = {r.doc_id: r for r in hidden_markov.scored_texts(spark.createDataFrame(rows, "doc_id long, text string"), parts=1, held_out=1).collect()}
    one = {rows[d][1]: 10 ** r.score for d, r in seen.items()}
    assert sum(one.values()) < 1


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("lo", "me", "ta", "ri", "so") for b in ("ran", "lim", "dor", "kes", "pun", "vil")]
    bad = ["scoundrelly", "nastypants", "vilewretch"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            word = rng.choice(bad)
            if i % 8 == 0:
                at = rng.randrange(2, len(word) - 2)
                word = word[:at] + word[at + 1:]
            words[rng.randrange(len(words))] = word
        rows.append((i, " ".join(words), "", 0, 0, 0.1))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "", 0, 0, 0.0), (2001, "", "", 0, 0, 0.0), (None, "loran melim", "", 0, 0, 0.0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, marks).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in tested) / len(tested)
    assert right > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (2000, 2001, None))
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_toxicity_is_not_fitted_in_the_driver(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["sea", "sky", "Baum", "vile"]) for _ in range(rng.randint(1, 30)))) for i in range(90)] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.training_sample(docs, marks))
    want = dict(zip((i for i, _ in rows), toxicity.Scorer(model)([t or "" for _, t in rows]).tolist()))
    driver, trained = os.getpid(), toxicity._trained

    def elsewhere(*args):
        assert os.getpid() != driver
        return trained(*args)

    monkeypatch.setattr(toxicity, "_trained", elsewhere)
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, marks).collect()} == want
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, marks).collect()} == {i for i, s in want.items() if s < toxicity.THRESHOLD}


def test_words_are_summed_in_steps(monkeypatch):
    texts = [" ".join(f"w{i * k % 23}" for k in range(1, 20)) for i in range(30)]
    whole = toxicity.fit(texts, [i % 2 for i in range(30)])
    monkeypatch.setattr(toxicity, "WORDS", 3)
    parts = toxicity.fit(texts, [i % 2 for i in range(30)])
    assert (whole.weights == parts.weights).all() and whole.bias == parts.bias
