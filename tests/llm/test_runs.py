"""Periodic runs: against every stretch and period tried one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import runs


def brute(words):
    """Every period q: stretches of words equal to the word q later; a period that a smaller one divides is not the smallest."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                own = words[i : i + length]
                if all(any(own[k] != own[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, many=400):
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        few = [b"w%d" % k for k in range(rng.choice([1, 2, 3, 5, 40]))]
        words: list[bytes] = []
        while len(words) < rng.choice([0, 5, 30, 120]):
            root = rng.choices(few, k=rng.choice([1, 1, 2, 3, 5, 9]))
            words += root * rng.choice([1, 1, 3, 4, 5, 8]) + root[: rng.randrange(len(root) + 1)]
            if rng.random() < 0.4:
                words = words * rng.choice([2, 4])
            if rng.random() < 0.3:
                words.append(b"x%d" % rng.randrange(9))
        out.append(words[:600])
    return out


def test_all_runs():
    own = texts(3)
    found = runs.runs_of(own)
    assert sum(map(len, found)) > 500
    for words, got in zip(own, found):
        assert got == brute(words), words


def test_scan_without_the_sieve():
    for words in texts(4, 150):
        number = {}
        flat = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        assert runs.Scan(flat).runs() == brute(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_few_words(numbers):
    words = [b"%d" % x for x in numbers]
    assert runs.runs_of([words, [], words]) == [brute(words), [], brute(words)]


def test_collisions_cost_no_result(monkeypatch):
    monkeypatch.setattr(runs.Scan, "_equal", lambda self, i, j, n: True if n % 3 else self.words[i : i + n] == self.words[j : j + n])
    for words in texts(5, 120):
        assert runs.runs_of([words])[0] == brute(words)


def test_long_texts():
    """Of 300,000 words each: one word, a Fibonacci word, a long period, and many repeated passages."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300_000:
        a, b = b, b + a
    rng = random.Random(6)
    root = [b"%d" % rng.randrange(50) for _ in range(60_000)]
    passage = [b"%d" % rng.randrange(10**6) for _ in range(300)]
    mixed = [w for k in range(900) for w in [*passage, b"s%d" % k]]
    found = runs.runs_of([[b"a"] * 300_000, b[:300_000], root * 5, mixed])
    assert found[0] == [(0, 300_000, 1)]
    assert (0, 300_000, 60_000) in found[2]
    assert found[3] == []
    assert found[1] == []  # no exponent above 3.62 in a Fibonacci word


def want(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = brute(words)
    drop = {k for s, n, q in own for k in range(s + q, s + n)}
    best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = "".join(f"{s},{n},{q}\n" for s, n, q in own)
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    return (doc_id, len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    own = [(k, " ".join(x.decode() for x in t)) for k, t in enumerate(texts(7, 120))]
    own += [(k, " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(40)))) for k in range(200, 400)]
    return [*own, (500, None), (501, ""), (502, " \t\r\n\x0b\x0c"), (503, "é\xa0é é\xa0é é é é é é é"), (None, "a a a a a a a"), (7, own[7][1]), (-5, "x " * 40)]


def test_query(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int")
    found = runs.digest(runs.find_runs(docs, runs.plant))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    assert runs.digest(runs.find_runs(docs.where("false"), runs.plant)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so it goes on and on and on and on and on now")], "doc_id long, text string")
    row = runs.find_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(3, 9, 2)] and row["collapsed"] == "so it goes on and now"
