"""Periodic runs, conversation tries and quartile digests against direct computation."""
from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyscope.llm import periodic_runs, prefix_trie, quartile_digest

DOCS = "doc_id long, text string, runs string, _text string, collapsed int"


def _plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Runs by comparing every word with the word each period later."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i - start + q
                if length >= max(24, 3 * q):
                    found.setdefault((start, length), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def _noisy(rng: random.Random) -> str:
    parts = []
    for _ in range(rng.randint(0, 6)):
        alphabet = [f"w{k}" for k in range(rng.choice([1, 2, 3, 50]))]
        unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 40))]
        times = rng.choice([1, 2, 3, 3, 5, 12])
        parts += (unit * times)[:rng.randint(1, len(unit) * times)]
    return rng.choice([" ", "\n", " \t"]).join(parts)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_plain_comparison(seed):
    rng = random.Random(seed)
    texts = [_noisy(rng) for _ in range(60)] + ["", "  ", "a " * 500, "a b " * 200, "a\x1c b\xa0 " * 30]
    runs, kept = periodic_runs.text_runs([t.encode() for t in texts])
    for text, got, rest in zip(texts, runs, kept):
        words = text.encode().split()
        want = _plain_runs(words)
        assert [tuple(r) for r in got.tolist()] == want
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert rest == b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_long_repeats_and_fibonacci_words():
    a, b = "x", "x y"
    while len(b) < 20000:
        a, b = b, b + " " + a
    texts = [b.encode(), b"z " * 30000, (" ".join(map(str, range(7000))) + " ").encode() * 3]
    runs, _ = periodic_runs.text_runs(texts)
    assert runs[1].tolist() == [[0, 30000, 1]]
    assert runs[2].tolist() == [[0, 21000, 7000]]
    words = np.array([1 if w == b"x" else 2 for w in texts[0].split()])
    for s, n, q in runs[0].tolist():
        assert (words[s:s + n - q] == words[s + q:s + n]).all()
        assert s == 0 or words[s - 1] != words[s + q - 1]
        assert s + n == len(words) or words[s + n] != words[s + n - q]
    assert [tuple(r) for r in periodic_runs.text_runs([b[:3999].encode()])[0][0].tolist()] == _plain_runs(b[:3999].split())


def _plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digests_of_documents(spark):
    rng = random.Random(3)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0 or i % 37 == 0]
    rows = [(i, " ".join(rng.choice("a b c d é ee") for _ in range(rng.randint(0, 90))), "x", "y", 3) for i in ids]
    rows += [(None, "u v " * 40, "x", "y", 3), (ids[0], None, None, None, None), rows[5], rows[5], (7, "", "", "", 1), (10**12, "k " * 26, "", "", 1)]
    got = periodic_runs.run_digests(spark.createDataFrame(rows, DOCS)).collect()
    want = [_plain_digest(r[0], r[1]) for r in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 60
    assert periodic_runs.run_digests(spark.createDataFrame([], DOCS)).count() == 0


def _plain_bucket_counts(data: bytes) -> list[int]:
    counts, mask = [0] * quartile_digest.BUCKETS, 0xFFFFFFFF
    for at in range(len(data) - 4):
        for salt, (i, j) in enumerate(quartile_digest.TRIPLETS):
            h = (data[at] * 0x9E3779B1 + data[at + i] * 0x85EBCA77 + data[at + j] * 0xC2B2AE3D + salt * 0x27D4EB2F) & mask
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & mask
            counts[h >> 24] += 1
    return counts


def _plain_code(data: bytes) -> list[int]:
    counts = _plain_bucket_counts(data)
    ordered = sorted(counts)
    cuts = [ordered[len(ordered) * k // 4 - 1] for k in (1, 2, 3)]
    return [sum(c > cut for cut in cuts) for c in counts]


@pytest.mark.parametrize("length", [0, 3, 4, 5, 6, 40, 700, (1 << 20) + 9])
def test_digest_equals_plain_counting(length):
    data = random.Random(length).randbytes(length) if length < 9000 else b"ab c" * (length // 4) + b"z"
    if length < 9000:
        assert quartile_digest.bucket_counts(data).tolist() == _plain_bucket_counts(data)
        codes = [byte >> shift & 3 for byte in quartile_digest.digest(data)[2:] for shift in (6, 4, 2, 0)]
        assert codes == _plain_code(data)
    assert quartile_digest.bucket_counts(data).sum() == max(len(data) - 4, 0) * 6


def test_differences_are_bounded_and_symmetric():
    rng = random.Random(1)
    made = [quartile_digest.digest(rng.randbytes(rng.randint(0, 3000))) for _ in range(30)]
    for a in made:
        assert quartile_digest.difference(a, a) == 0 and quartile_digest.likeness(a, a) == 1
        for b in made:
            codes = [[byte >> s & 3 for byte in d[2:] for s in (6, 4, 2, 0)] for d in (a, b)]
            steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(*codes))
            rest = abs(a[0] - b[0]) + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
            assert quartile_digest.difference(a, b) == quartile_digest.difference(b, a) == steps + rest
            assert 0 <= quartile_digest.likeness(a, b) <= 1


def _plain_compared(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed, other = (quartile_digest.digest(t.encode()) for t in (text, edited, following))
        yield (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), changed.hex(),
               quartile_digest.likeness(own, changed), quartile_digest.likeness(own, other))


CLASHING = "doc_id long, text string, part int, edge string, tie string, fingerprint int"


@pytest.mark.parametrize("n", [1, 2, 300])
def test_texts_compared_with_the_next(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 % 1009, "".join(rng.choice("ab é\U0001f600z ") for _ in range(rng.randint(0, 400)))) for i in range(n)]
    if n > 2:
        rows += [(5000, None), (None, "no id"), (6000, ""), (7000, "long " * 40000), (8000, rows[3][1]), (8001, rows[3][1])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "first", "t", 2) for r in rows], CLASHING).repartition(5)
    got = quartile_digest.compared_with_next(frame).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, _plain_compared(rows)))


def test_repeated_ids_digests_and_empty_table(spark):
    rows = [(1, "same text here"), (1, "same text here"), (2, "other text of it")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.asDict() for r in quartile_digest.compared_with_next(frame).collect()]
    assert len(got) == 3 and sorted(r["near_next"] == 1.0 for r in got) == [False, False, True]
    alone = {r.fingerprint for r in quartile_digest.text_digests(frame).collect()}
    assert {r["fingerprint"] for r in got} == alone
    both = frame.withColumn("f", frame.text).limit(0)
    assert quartile_digest.compared_with_next(both).count() == 0
    pairs = quartile_digest.text_digests(frame).selectExpr("fingerprint a", "if(doc_id = 1, fingerprint, null) b")
    assert sorted(r[0] or 0 for r in pairs.select(quartile_digest.digest_likeness("a", "b")).collect()) == [0, 1, 1]


def _plain_trie(rows, rebuilt=True):
    own = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        convs[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[n] for n in below) or 1
        own_part = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_part + sum(saved[n] for n in below)
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(node))
        yield (min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children.get(node, [])),
               leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string, key string, shard string, depth int"


def _talks(rng: random.Random, n: int, words: int) -> list[tuple]:
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            said = "hi" if turn < 2 and rng.random() < 0.6 else f"é{rng.randrange(words)}"
            rows.append((c, turn if turn else rng.choice([None, 0]), ["user", None, "bot"][turn % 3], said if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("shards, held, words", [(1, 1 << 18, 2), (7, 1 << 18, 2), (16, 2, 1), (5, 1, 40)])
def test_trie_equals_plain_computation(spark, shards, held, words):
    rng = random.Random(shards)
    rows = _talks(rng, 150, words) + [(None, 1, "a", "b"), (9001, 5, "user", "tail"), (9004, 5, "user", "tail")]
    rows += [(20000, t, "r", "same") for t in range(60)] + [(20005, t, "r", "same") for t in range(45)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "k", "s", 1) for r in rows], TURNS).repartition(3)
    for rebuilt, paths in ((True, prefix_trie.rebuilt_paths), (False, prefix_trie.plain_paths))[:2 if held == 2 else 1]:
        got = [tuple(r) for r in prefix_trie.trie_nodes(*paths(frame), held=held, shards=shards).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, _plain_trie(rows, rebuilt)))


def test_long_conversations_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, t, "r", f"{t // 7}") for c in range(0, 40, 5) for t in range(30 + c)] + [(c, 0, "r", "x") for c in (1, 2, 3, 4)]
    frame = spark.createDataFrame([(*r, "k", "s", 1) for r in rows], TURNS)
    got = [tuple(r) for r in prefix_trie.trie_nodes(*prefix_trie.rebuilt_paths(frame), shards=4).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _plain_trie(rows)))


def test_empty_conversations(spark):
    frame = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_trie(frame).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", 1)], TURNS)).count() == 0


def test_spilling_queue_keeps_order():
    rng = random.Random(2)
    items = [((-rng.randrange(50), rng.randbytes(1)), rng.randrange(9), 0, []) for _ in range(5000)]
    queue = prefix_trie.SpillingQueue(64)
    for item in items:
        queue.push(item)
    assert queue.spilled > 10
    got = [x for place in sorted({i[0] for i in items}) for x in queue.take(place)]
    assert got == sorted(items) and queue.take((0, b"")) == []
