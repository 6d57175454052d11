"""SimHash: fingerprints, the covering code, links and components against brute force."""

import random

import numpy as np
import xxhash

from specloom.llm import simhash
from specloom.llm.components import connected_components


def brute_fp(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    own = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); component of each."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "été", "x", "long-word", "12"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    near = [b + rng.choice(["", " tail", "\n", "!"]) for b in base for _ in range(2)]
    return [None, "", " \t\n", "A", "a", "a b", *base, *near, "w " * 40000]


def test_against_brute_force(spark):
    own = [(k * 7 % 1000, t, "e") for k, t in enumerate(texts())] + [(None, "a", "e"), (3, "a b", "e"), (3, "a b", "e")]
    docs = spark.createDataFrame(own, "doc_id long, text string, fp string")
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    rows = [(d, brute_fp(t)) for d, t, _ in own]
    want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_components(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_the_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    home = simhash.homes(words)
    assert (simhash.syndromes(home) == 0).all() and np.bitwise_count(home ^ words).max() <= 3
    assert len(np.unique(simhash.syndromes(simhash.errors(3)[0]))) == 2048
    rows, near = simhash.around(words, 5)
    assert (simhash.syndromes(near) == 0).all() and np.bitwise_count(near ^ words[rows]).max() <= 5


def test_every_link_is_found(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)} | {0, 1, 3, (1 << 64) - 1}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 2}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1001 + k) for k in range(30)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1031))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c d", 7), (1, "e f g h", 8), (2, "a b c d", 9), (None, "a b c d", 1), (3, None, 2), (3, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").selectExpr("*", "1 as _own", "2 as _twice", "3 as _all", "4 as fp", "5 as _root")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=str) == sorted([(1, "a b c d", 7), (1, "e f g h", 8), (None, "a b c d", 1), (3, None, 2)], key=str)


def test_heavy_fingerprints_are_spread(spark, monkeypatch):
    from specloom.llm import common

    rows = [(k, "same words again" if k % 3 else f"text number {k % 50} here", "e") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = sorted(map(str, map(tuple, simhash.digest(simhash.near_duplicates(docs)).collect())))
    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    assert sorted(map(str, map(tuple, simhash.digest(simhash.near_duplicates(docs)).collect()))) == want
