"""Periodic runs and longest common extensions against plain loops, and the whole query against a plain one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import periodic_runs, queries


def plain_runs(words):
    best = {}
    for q in range(1, len(words) // 3 + 1):
        x = 0
        while x + q < len(words):
            y = x
            while y + q < len(words) and words[y] == words[y + q]:
                y += 1
            if y - x + q >= max(24, 3 * q):
                best.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def sequences(seed):
    rng = random.Random(seed)
    for _ in range(8):
        n, letters = rng.randrange(500), rng.choice([1, 2, 3, 50])
        some = [rng.randrange(letters) for _ in range(n)]
        p = rng.randrange(1, 90)
        yield rng.choice([some, [some[i % p % n] for i in range(n)], some[: n // 3] + (some[:p] * 200)[: n // 2] + some[n // 3 :], some[:200] * 3])


@pytest.mark.parametrize("seed", range(12))
def test_runs_and_extensions_equal_plain_loops(seed, monkeypatch):
    if seed % 3 == 0:
        monkeypatch.setattr(periodic_runs, "PAIRS", 50)  # many steps
    if seed % 4 == 1:
        monkeypatch.setattr(periodic_runs, "mix", lambda x: x % np.uint64(5))  # hashes that collide
    texts = sorted(sequences(seed), key=len, reverse=True)
    made = periodic_runs._Slice(np.array([x for t in texts for x in t], dtype=np.int64), np.array([len(t) for t in texts]))
    got = [[] for _ in texts]
    for s, e, q in zip(*made.runs(), strict=True):
        t = int(np.searchsorted(made.starts, s, side="right")) - 1
        got[t].append((int(s - made.starts[t]), int(e - s), int(q)))
    assert got == [plain_runs(t) for t in texts]
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(made.w), (2, 400))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, periodic_runs.Extensions(made.w).of(i, j), strict=True):
        k = 0
        while max(a, b) + k < len(made.w) and made.w[a + k] == made.w[b + k]:
            k += 1
        assert n == k


def test_the_cover_meets_every_difference():
    assert periodic_runs.SHIFTS.min() == 0 and periodic_runs.SHIFTS.max() < periodic_runs.COVER_SIZE


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_the_query_equals_a_plain_one(spark, odd_docs, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bé", "c\x1f", "d\x85e", " "]) for _ in range(rng.randrange(120))) for _ in range(400)]
    rows = [*enumerate(texts), (3, "x " * 300), (5000, "\tab\r\nab " * 40), (None, "y " * 30), (-7, "a b\x0b" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.filter("doc_id is null or doc_id != 7"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert got == want and sum(r[1] for r in got) > 10


def test_a_long_text_with_one_period(spark, odd_docs):
    row = periodic_runs.find_runs(odd_docs.filter("doc_id = 7")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 60_000, 977)] and row["collapsed"].split() == [f"word{i}" for i in range(977)]
