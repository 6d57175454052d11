"""Merkle fingerprints against a plain version."""

import hashlib
import re

from pyspark.sql import functions as F

from specloom.llm import merkle

ROWS = [(5, "Line one.\nLine two is longer than a block of thirty-two.\n\nEnd"), (3, None), (2, ""), (9, "a"), (7, "é\U0001f600x" * 50), (4, "same"), (4, "same"), (1, "w " * 60000), (None, "no id"), (6, "Line one.\nLine two is longer than a block of thirty-two.\n\nEnd!")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    """Sections as (hash, paragraphs), paragraphs as (hash, blocks)."""
    parts, own = [], []
    paragraphs = [(sha(p), [hashlib.md5(p[k : k + 32].encode()).hexdigest()[:8] for k in range(0, len(p), 32)]) for p in text.split("\n")]
    for k, (h, b) in enumerate(paragraphs):
        own.append((h, b))
        if h[-1] in "0123" or k == len(paragraphs) - 1:
            parts.append((sha(" ".join(h for h, _ in own)), own))
            own = []
    return parts


def fingerprint(text):
    parts = tree(text)
    line = lambda own: ";".join(f"{h[:8]}({' '.join(b)})" for h, b in own)
    return sha(" ".join(h for h, _ in parts)) + ":" + "".join(f"{h[:8]}[{line(own)}]" for h, own in parts)


def near(a, b):
    """By the texts: what is alike at the level where it is found."""
    x, y = tree(a), tree(b)
    if [h for h, _ in x] == [h for h, _ in y]:
        return 1.0
    distinct = lambda rows: list({r[0]: r for r in rows}.values())
    only = lambda rows, others: [r for r in distinct(rows) if r[0] not in {o[0] for o in others}]
    both = lambda rows, others: [r for r in distinct(rows) if r[0] in {o[0] for o in others}]
    n = sum(len(blocks) for _, blocks in distinct([p for _, own in both(x, y) for p in own]))
    p, q = ([p for _, own in only(s, t) for p in own] for s, t in ((x, y), (y, x)))
    n += sum(len(blocks) for _, blocks in both(p, q))
    u, v = ({b for _, blocks in only(s, t) for b in blocks} for s, t in ((p, q), (q, p)))
    total = 2 * n + len(u) + len(v)
    return 2.0 * (n + len(u & v)) / total if total else 0.0


def test_against_a_plain_version(spark):
    own = sorted([(d, t or "") for d, t in ROWS], key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (d, t) in enumerate(own):
        other = own[(k + 1) % len(own)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + other[:h]
        fp, ed = fingerprint(t), fingerprint(edited)
        want.append((d, len(t), sha(edited), fp, ed, near(t, edited), near(t, other)))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "'x' as next_text")
    old = merkle.RANGE_BYTES
    try:
        for merkle.RANGE_BYTES in (1 << 20, 64, 8):
            got = merkle.fingerprint_edits(docs).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    finally:
        merkle.RANGE_BYTES = old
    assert merkle.fingerprint_edits(docs.limit(0)).count() == 0
    only = merkle.fingerprint_edits(docs.where("doc_id = 9")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0


def test_edits_are_located(spark):
    text = "\n".join(f"paragraph {k}" for k in range(40))
    other = text.replace("paragraph 17", "paragraph seventeen")
    rows = merkle.trees(spark.createDataFrame([(1, text), (2, other), (3, text)], "doc_id long, text string"))
    a, b, c = (rows.where(F.col("doc_id") == k).select(F.col("root").alias(f"r{k}"), F.col("sections").alias(f"s{k}")) for k in (1, 2, 3))
    row = a.crossJoin(b).crossJoin(c).select(merkle.locate_edits(F.col("s1"), F.col("s2")).alias("at"), merkle.locate_edits(F.col("s1"), F.col("s3")).alias("none"), "r1", "r2", "r3").first()
    assert row["at"] == [17] and row["none"] == [] and row["r1"] == row["r3"] != row["r2"]


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = merkle.fingerprint_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_any_doc_id(spark, monkeypatch):
    """Wide gaps, the ends of long, many rows of one doc_id and of none."""
    monkeypatch.setattr(merkle, "RANGE_BYTES", 16)
    for ids in ([-8 * 10**18, 8 * 10**18], [-(1 << 63), (1 << 63) - 1, 0, 5], [7] * 30 + [None] * 30 + [9, 3] + list(range(100, 140))):
        rows = [(d, f"text {k}\nof {d}") for k, d in enumerate(ids)]
        own = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
        want = sorted(str((d, sha(t[: len(t) - len(t) // 2] + own[(k + 1) % len(own)][1][: len(t) // 2]))) for k, (d, t) in enumerate(own))
        got = merkle.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "edited_sha256").collect()
        assert sorted(str(tuple(r)) for r in got) == want
