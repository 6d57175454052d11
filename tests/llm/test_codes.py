"""Vector codes: the codes, errors and codebooks of a plain Lloyd in whole numbers."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from specloom.llm import codes


def brute(rows):
    """(vec_id, embedding, label) to the contract's rows."""
    kept = [(k, v, lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    order = [r for r in order if len(r[1]) == size]
    whole = lambda v: [math.floor(Fraction(x) * 1024) for x in v]
    q = size // 4
    cut = lambda v: [tuple(v[p * q : p * q + q]) for p in range(4)]
    books = [[cut(whole(v))[p] for _, v, _ in order[:256]] for p in range(4)]
    parts = [cut(whole(v)) for _, v, _ in kept]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), k) for k, e in enumerate(books[p])) for p in range(4)] for x in parts]

    for _ in range(4):
        found = assign()
        for p in range(4):
            of = defaultdict(list)
            for x, f in zip(parts, found):
                of[f[p][1]].append(x[p])
            for k, own in of.items():
                books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] += e
    text = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    fit = lambda e: e if e < 1 << 63 else None
    bad = {lab for (_, _, lab), e in zip(kept, errors) if fit(e) is None}
    return [(k, "".join(f"{c:02x}" for _, c in f), fit(e), None if lab in bad else fit(labels[lab]), text) for (k, _, lab), f, e in zip(kept, found, errors)]


def check(spark, rows, kind="float"):
    df = spark.createDataFrame([(k, v, lab, "x") for k, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(3)
    found = codes.vector_codes(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def vectors(n, size, seed, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (12, size))
    out = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, size))
    return (np.round(out * 20) / 20 if ties else out).astype(np.float32).tolist()


def test_many(spark):
    rng = random.Random(1)
    check(spark, [(3 * k - 500, v, rng.choice([None, 1, 2, 3])) for k, v in enumerate(vectors(700, 16, 2))])


def test_ties_and_repeats(spark):
    """Few different parts: most entries are equal or equally far, so ties decide."""
    own = vectors(400, 8, 3, ties=True)
    rows = [(k, [round(x) for x in v] if k % 2 else v, k % 5) for k, v in enumerate(own)]
    rows = [(k, [float(x) for x in v], lab) for k, v, lab in rows]
    check(spark, rows + rows[:50] + [(None, own[0], None), (None, own[1], 2)] + [(10**6, own[7], 1)] * 60)


def test_odd_rows(spark):
    rows = [(k, v, 1) for k, v in enumerate(vectors(30, 8, 4))]
    rows += [(100, None, 1), (101, [0.1] * 7 + [None], 1), (102, [0.1] * 7 + [float("nan")], 1), (103, [float("inf")] + [0.0] * 7, None), (104, [0.5] * 4, 1), (105, [], None)]
    got = check(spark, rows)
    assert len(got) == 30
    assert check(spark, []) == []
    assert check(spark, [(1, None, 2)]) == []
    assert [r[1:4] for r in check(spark, [(1, [], 2), (2, [], None)])] == [("00000000", 0, 0)] * 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components(spark, kind):
    rows = [(k, v, k % 3) for k, v in enumerate(vectors(60, 8, 5))]
    rows[7] = (7, [1e30, -1e30, 0.0, 5.0, 2.5e6, -3e7, 0.25, 1e12], 0)
    rows[8] = (8, [1e9] * 8, 1)
    rows = [(k, np.array(v, np.float32).astype(float).tolist(), lab) for k, v, lab in rows]
    check(spark, rows, kind)


def test_uneven_parts(spark):
    """Six components: parts of 2, 2, 1 and 1."""
    rows = [(k, v[:6], 1) for k, v in enumerate(vectors(300, 8, 9))]
    found = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert [len(b[0]) for b in found.books] == [2, 2, 1, 1] and found.codes.count() == 300


def test_bounds_save_distances_and_hold():
    """Over rounds of moving entries: bounds stay bounds, results are the full search's, with a fraction of its distances."""
    rng = np.random.default_rng(6)
    x = np.floor(np.array(vectors(3000, 8, 7)) * 1024).astype(np.int64)
    entries = x[:64].copy()
    state, took = None, []
    for _ in range(6):
        book = codes.Book([tuple(e) for e in entries.tolist()], np.zeros(64) if state is None else moved)
        book.prepare()
        full = ((x[:, None] - entries[None]) ** 2).sum(2)
        if state is None:
            entry, own, upper, lower = book.first(x)
        else:
            entry, own, upper, lower, n = book.later(x, entry, upper, codes.unpack_bounds(*codes.pack_bounds(lower)))
            took.append(n)
        state = True
        assert (entry == full.argmin(1)).all()
        assert (upper >= np.sqrt(full[np.arange(3000), entry])).all() and (lower <= np.sqrt(full)).all()
        assert (codes.unpack_bounds(*codes.pack_bounds(lower)) <= lower).all()
        new = np.array([x[entry == k].sum(0) // max(1, (entry == k).sum()) if (entry == k).any() else entries[k] for k in range(64)]) + rng.integers(-1, 2, entries.shape)
        moved = np.array([codes._moved(tuple(a), tuple(b)) for a, b in zip(entries.tolist(), new.tolist())])
        entries = new
    assert max(took) < 0.5 * 3000 * 64 and took[-1] < 0.2 * 3000 * 64, took


def test_vectors_come_back(spark):
    rows = [(k, v, 1) for k, v in enumerate(vectors(300, 8, 8))]
    found = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    back = {r["vec_id"]: r["vector"] for r in found.vectors().collect()}
    assert len(back) == 300 and all(np.abs(np.array(back[k]) - np.array(v)).max() < 0.3 for k, v, _ in rows)
