"""Decontamination against brute force on word lists."""

import re

from specloom.llm import decontaminate as d

BENCH = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short Item!"), (3, ""), (4, None), (5, "café 42"), (1, "One two three four five six seven eight nine ten eleven"), (None, "no id at all")]
DOCS = [
    (1, "x ONE two, three-four five six seven eight nine ten ELEVEN y"),
    (2, "one two three four five six seven eight nine"),
    (3, None), (4, ""), (5, "a short item b short item"), (6, "café 42 " * 500), (7, "cafés 42"), (None, "No id, at all"), (5, "a short item b short item"),
    (8, "short one two three four five six seven eight nine ten item"),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text):
    own, hit, items = words(text), set(), set()
    for item, t in BENCH:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for p in range(len(own) - m + 1):
                if own[p : p + m] == w[k : k + m]:
                    hit |= set(range(p, p + m))
                    items.add("null" if item is None else str(item))
    return len(own), len(hit), len(items), d.sha256_of_items(list(items)), bool(hit)


def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as hits", "'x' as items"), spark.createDataFrame(BENCH, "item_id long, text string").selectExpr("*", "2 as doc_id")


def test_against_brute_force(spark):
    docs, bench = tables(spark)
    for block in (1, 1000):
        rows = d.digest(d.find_contamination(docs, bench, block_windows=block)).collect()
        assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str((i, *brute(t))) for i, t in DOCS)


def test_removal_leaves_no_hit(spark):
    docs, bench = tables(spark)
    for block in (1, 1000):
        out = d.remove_contamination(docs, bench, block_windows=block)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == len(DOCS) and all(brute(r["text"])[1] == 0 for r in rows)
        assert [r["text"] for r in rows if r["doc_id"] in (2, 3, 4, 7)] == [DOCS[1][1], None, "", "cafés 42"]
    assert {r["doc_id"] for r in d.remove_contamination(docs, bench, whole=True).collect()} == {2, 3, 4, 7}


def test_what_a_later_block_brings_together_is_cut(spark):
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["left right", "in between", "far left right away"])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a left in between right b"), (2, "a left in in between between right b"), (3, "a far left right away b"), (4, None), (5, "a")], "doc_id long, text string")
    for block in (1, 2, 1000):
        got = {r["doc_id"]: r["text"] and r["text"].split() for r in d.remove_contamination(docs, bench, block_windows=block).collect()}
        assert got == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"], 4: None, 5: ["a"]}
        assert {r["doc_id"] for r in d.remove_contamination(docs, bench, whole=True, block_windows=block).collect()} == {4, 5}


def test_columns_of_any_name_pass_several_blocks(spark):
    bench = spark.createDataFrame([(k, " ".join(f"{c}{i}" for i in range(12))) for k, c in enumerate("abcd")], "item_id long, text string")
    texts = ["x " + " ".join(f"b{i}" for i in range(12)) + " y", "clean", None]
    docs = spark.createDataFrame([(k, t, 7, 8, [1], "r", "m") for k, t in enumerate(texts)], "doc_id long, text string, _hits int, hits int, items array<int>, row string, more string")
    for block in (3, 1000):
        rows = {r["doc_id"]: r for r in d.remove_contamination(docs, bench, block_windows=block).collect()}
        assert rows[0].__fields__ == docs.columns and rows[0]["text"].split() == ["x", "y"] and rows[1]["text"] == "clean" and rows[2]["text"] is None
        assert all((r["_hits"], r["hits"], r["items"], r["row"], r["more"]) == (7, 8, [1], "r", "m") for r in rows.values())
        assert {r["doc_id"] for r in d.remove_contamination(docs, bench, whole=True, block_windows=block).collect()} == {1, 2}
        assert [r["contaminated"] for r in d.digest(d.find_contamination(docs.select("doc_id", "text"), bench, block_windows=block)).orderBy("doc_id").collect()] == [True, False, False]


def test_empty_tables(spark):
    docs, bench = tables(spark)
    assert d.digest(d.find_contamination(docs.limit(0), bench)).count() == 0
    assert not any(r["contaminated"] for r in d.digest(d.find_contamination(docs, bench.limit(0))).collect())
    assert d.remove_contamination(docs, bench.limit(0)).count() == len(DOCS)


def test_the_size_of_blocks_changes_nothing(spark):
    """An item that is cut out brings another together, whichever blocks they are in; an item longer than a block is dealt to several."""
    item = lambda c: " ".join(f"{c}{k}" for k in range(10))
    long = " ".join(f"w{k * k % 97}x{k}" for k in range(400))
    bench = spark.createDataFrame([("A", item("a")), ("L", long), ("B", item("b"))], "item_id string, text string").coalesce(1)
    a = item("a").split()
    texts = [" ".join([*a[:5], *item("b").split(), *a[5:]]), " ".join(long.split()[100:130]), f"x {long} y", "w " * 100_000 + item("a"), " ".join(long.split()[100:109])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {block: sorted(map(tuple, d.digest(d.find_contamination(docs, bench, block_windows=block)).collect())) for block in (150, 100_000)}
    assert len({str(f) for f in found.values()}) == 1 and [r[2] for r in found[150]] == [10, 30, 400, 10, 0]
    for block in (150, 100_000):
        cut = {r["doc_id"]: (r["text"] or "").split() for r in d.remove_contamination(docs, bench, block_windows=block).collect()}
        assert cut == {0: [], 1: [], 2: ["x", "y"], 3: ["w"] * 100_000, 4: texts[4].split()}
