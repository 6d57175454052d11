"""Near-duplicates by Jaccard similarity against brute force."""

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pyarrow as pa
from specloom.llm import common, jaccard, simhash
from specloom.llm.components import connected_components


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_firsts(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not every or Fraction(shared, every) >= Fraction(4, 5):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    quoted = " ".join(rng.choices(vocabulary, k=14))
    texts = [None, "", " ", "one", "One", "a b c d e", "a b c d e f"]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    for k in range(30):
        base = rng.choices(vocabulary, k=rng.randint(6, 120))
        texts += [f"{quoted} " * (k % 2) + edited(base, e) for e in (0, 0, 1, 1, 2, 3)] + [" ".join(base + base[:9])]
    crowd = rng.choices(vocabulary, k=130)
    texts += [edited(crowd, e % 6) for e in range(90)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts))


def test_the_stage_drops_near_copies(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == brute_firsts(rows) and len(kept) < len(rows) / 2
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_large_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rows = near_copies()
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_firsts(rows)


def test_exactly_four_fifths(spark):
    words = [f"u{k}" for k in range(13)]
    rows = [(1, " ".join(words[:12])), (2, " ".join(words[:13])), (3, " ".join(words[:9])), (4, "x y z t q r s"), (5, "x y z t q r")]
    assert len(brute_set(rows[2][1])) * 8 == len(brute_set(rows[0][1])) * 5
    assert sorted(r["doc_id"] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3, 4, 5]
    rows = [(1, " ".join(words[:9])), (2, " ".join(words[:8])), (3, " ".join(words[:13])), (4, " ".join(f"v{k}" for k in range(12)))]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_firsts(rows) == [1, 3, 4]


def test_each_group_keeps_a_row_where_ids_repeat(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(3, one), (5, one), (5, two), (7, two), (9, three), (9, three), (9, one), (11, three + " end"), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (jaccard.keep_one, simhash.keep_one):
        got = keep(docs.where("doc_id is null or doc_id <> 11")).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, two), (3, one), (5, two), (9, three)]
    got = jaccard.keep_one(docs.where("doc_id is not null").union(spark.createDataFrame([(9, "z z")], docs.schema)))
    assert sorted(map(tuple, got.collect())) == [(3, one), (5, two), (9, three), (9, "z z")]


def test_the_stage_goes_through_simhash(spark, monkeypatch):
    """Fingerprints of the sets, anchors and components give pairs, which are compared; the shingles find the rest without those."""
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked, compared = [], []
    real, similar = simhash.links, jaccard.similar
    monkeypatch.setattr(simhash, "links", lambda distinct: linked.append(distinct.count()) or real(distinct))
    monkeypatch.setattr(jaccard, "similar", lambda pairs, *a: compared.append({tuple(r) for r in pairs.collect()}) or similar(pairs, *a))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_firsts(rows)
    sets = {d: jaccard.Sets([(t or "").encode()]) for d, t in rows}
    prints = {int(s.node[0]): int(simhash.majorities(s.hash, s.size).view(np.int64)[0]) for s in sets.values() if s.size[0]}
    assert linked == [len({*prints.values()})]
    near = {(a, b) for a in prints for b in prints if a != b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert near and {n for pair in near for n in pair} == {n for pair in compared[0] for n in pair}
    assert not {frozenset(p) for p in compared[0] & near} & {frozenset(p) for p in compared[1]}


def test_many_distinct_shingles_leave_common_ones_last(spark):
    """Cells tell a shingle of many texts from those of one text where there are more shingles than 2**18 by far."""
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 20_000_000, np.uint64)
    cells = np.bincount(jaccard._cell(hashes), minlength=jaccard.CELLS)
    assert np.mean(cells > 40) < 0.001


def test_workers_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100] * 10})
    assert sum(b.num_rows for b in common.slices(iter([batch, batch]), most=300)) == 20 and given == [1]


def test_jobs_and_tasks_follow_the_work(spark):
    """However many partitions shuffles have: the bitmap of the needed nodes is one query, and few links make tables of few parts."""
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 90, 3)] + [(1, 5)], "a long, b long")
    nodes = spark.range(50).selectExpr("shiftleft(id, 40) as node")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        spark.sparkContext.setJobGroup("marks", "marks")
        marks = jaccard._marks(nodes)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert np.unpackbits(marks).sum() == 50 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("marks")) <= 2
        found = connected_components(links)
        assert found._jdf.queryExecution().toRdd().getNumPartitions() <= 16
        assert {tuple(r) for r in found.collect()} == {(k + j, k) for k in range(0, 90, 3) for j in (0, 1)} | {(5, 0)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
