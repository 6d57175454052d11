"""Chat formatting: exact round trips, paths and ranks against brute force."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text() | st.sampled_from(["user", "assistant", 'a"b']), st.text() | st.sampled_from(["</turn>\n", '<turn role="assistant">\n', "\\l\\\\<", chat.HOSTILE]))))
def test_round_trip(turns):
    formatted, mask = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def brute(nodes, top):
    by = {}
    for tree, node, parent, role, text, score in sorted(nodes, key=lambda r: (r[3] or "", r[4] or "")):
        if node is not None:
            by.setdefault((tree or "", node), (parent, role or "", text or "", score or 0.0))
    for (tree, node), (parent, *rest) in list(by.items()):
        if parent is not None and ((tree, parent) not in by or parent == node):
            by[tree, node] = (None, *rest)
    parents = {(tree, v[0]) for (tree, _), v in by.items() if v[0] is not None}
    found = {}
    for tree, node in by:
        if (tree, node) not in parents:
            path, at = [], node
            while at is not None:
                path.append(at)
                at = by[tree, at][0]
            found.setdefault(tree, []).append((-sum(by[tree, n][3] for n in path), -len(path), node, path[::-1]))
    return {(t, k + 1): [by[t, n][1:3] for n in p[3]] for t, ps in found.items() for k, p in enumerate(sorted(ps)[:top])}


def test_paths_against_brute_force(spark):
    rng = random.Random(6)
    nodes = []
    for tree in ["a", "b", None, "deep"]:
        n = 70 if tree == "deep" else 25
        for k in range(n):
            parent = None if k == 0 else k - 1 if tree == "deep" and k < 60 else rng.randrange(k)
            nodes.append((tree, k, parent, rng.choice(["user", "assistant", None]), rng.choice([f"t{k}", "", None]), float(rng.randint(0, 9))))
    nodes += [("a", 3, 1, "user", "again", 1.0), ("b", 99, 1234, "user", "orphan", 50.0), ("c", 1, 2, "x", "cycle", 1.0), ("c", 2, 1, "x", "cycle", 1.0), ("d", 5, 5, "x", "own", 1.0), ("d", None, 5, "x", "none", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double").selectExpr("*", "1 as leaf", "2 as rank")
    for top in (1, 3):
        got = {(r["tree"], r["rank"]): [(t["role"], t["text"]) for t in r["turns"]] for r in chat.paths(df, top).collect()}
        assert got == brute([r for r in nodes if r[0] != "c"], top)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", 'say "<b>"\\'), (1, 2, "assistant", None), (2, 5, None, "x"), (None, 0, "user", "no id"), (3, 0, "assistant", "y" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tree")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digest(chat.format_paths(chat.paths(chat.conversations_as_trees(df)))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, r, t in sorted((k, r or "", t or "") for c, k, r, t in rows if c == conv)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[conv] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.format_turns(turns)[0]))
    assert chat.digest(chat.format_paths(chat.paths(chat.conversations_as_trees(df.limit(0))))).count() == 0
