"""Suffix-array dedup against brute force over all strings of the length."""

import hashlib
import random

import numpy as np
import pytest

from specloom.llm import blocks, suffix


def brute(rows, length=50):
    first = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], float("inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < (float("inf") if doc is None else doc):
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "é", "délta", "x", "long-long-word", "zz\n"]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        rows.append((rng.randint(0, 100) * 3 + k % 3, " ".join(parts)))
    rows += [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "b" + "a" * 400 + "c"), (None, passages[0] * 2), (None, passages[0] * 2), (6, rows[0][1]), (6, rows[0][1]), (700, " ".join(p for p in passages * 40))]
    return rows


@pytest.mark.parametrize("block_bytes,hot", [(2000, 10**9), (2000, 3), (1 << 23, 10**9)])
def test_against_brute_force(spark, monkeypatch, block_bytes, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(blocks.pack, "__defaults__", (block_bytes,))
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as block", "1 as spans").repartition(3)
    got = sorted((tuple(r) for r in suffix.digest(suffix.find_repeats(docs)).collect()), key=str)
    assert got == brute(rows)


def test_removal_keeps_whole_characters(spark):
    rows = corpus(2, 40)
    docs = spark.createDataFrame([(d, t, "en", 0) for d, t in rows], "doc_id long, text string, lang string, n_chars int")
    out = suffix.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    spans = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix.find_repeats(docs).collect()}
    for (d, t), s in zip(rows, [spans[d, len((t or "").encode())] for d, t in rows]):
        own = [len(r["text"].encode()) for r in out.where(f"doc_id <=> {'null' if d is None else d}").collect() if r["text"] is not None]
        assert t is None or any(len(t.encode()) - s - 8 * 3 <= n <= len(t.encode()) - s for n in own)


def test_empty(spark):
    assert suffix.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_orders_like_sorted():
    rng = random.Random(7)
    for shallow in (0, 8, 16, 32, 64):
        rows = np.array([[rng.choice(b"ab") if rng.random() < 0.1 else 97 for _ in range(20)] for _ in range(300)], np.uint8)
        group = np.array([rng.randint(0, 2) for _ in rows])
        order, new = suffix.deep_shallow(rows, group, shallow)
        keys = [(group[i], rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        assert [k == 0 or keys[k] != keys[k - 1] for k in range(300)] == new.tolist()


def test_blind_trie():
    rng = random.Random(8)
    strings = [bytes(rng.choices(b"abc", k=6)) for _ in range(200)]
    found = [[strings[i] for i in g] for g in suffix.BlindTrie(strings).order()]
    assert [s for g in found for s in g] == sorted(strings) and all(len({*g}) == 1 for g in found)


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for n, values, groups in ((0, 3, 1), (1, 2, 1), (3000, 2, 3), (3000, 200, 40), (3000, 1, 1)):
        words, group = rng.integers(0, values, (n, 3)).astype(np.uint64), rng.integers(0, groups, n)
        order, new = suffix.multikey_quicksort(words, group)
        rows = [(int(group[k]), *words[k].tolist()) for k in order]
        assert rows == sorted(rows) and new.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(n)]


def test_places_and_windows_are_copied_by_slices():
    """Documents of places by their ends' counts, empty ones too; windows of contexts as slices of the rows."""
    ends = np.array([0, 3, 3, 7, 7, 12])
    for at in range(12):
        for n in range(1, 13 - at):
            assert suffix.documents_at(ends, at, n).tolist() == np.searchsorted(ends, at + np.arange(n), side="right").tolist()
    rows = np.random.default_rng(5).integers(0, 250, (40, 102)).astype(np.uint8)
    rows[:, -2] = np.arange(50, 90)
    of, _, strings = suffix.windows_of(rows, 50)
    start = np.arange(len(of)) - np.searchsorted(of, of)
    assert [s.tobytes() for s in strings] == [rows[r, k : k + 50].tobytes() for r, k in zip(of.tolist(), start.tolist())]
    assert suffix.windows_of(rows[:0], 50)[2].shape == (0, 50)
