"""What tasks hold and send is bounded by the text they have."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from specloom.llm import blocks, maxent, suffix
from specloom.llm.common import BATCH_BYTES
from specloom.llm.wordstream import Words


def test_sums_and_words_are_bounded(spark):
    """Arrays of their whole size come from as many tasks as the text asks for; what words hold for each byte is for a part alone."""
    docs = spark.range(600).selectExpr("id as doc_id", "concat('some words ', id) as text").repartition(60)
    (found,) = maxent._sums(docs, lambda texts: [np.array([1.0])])
    assert 0 < found[0] <= maxent.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(400)).encode() for _ in range(1500)] + [b"x" * 700_000, b"", b" y"]
    Words(texts[:1])
    tracemalloc.start()
    whole = Words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))
    assert whole.hash.tolist() == [h for t in texts for h in Words([t]).hash.tolist()]


def peak(run) -> int:
    tracemalloc.start()
    run()
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found


def test_repeats_are_bounded():
    """What finds and marks a block's repeats holds some times the block's bytes, also where most of it repeats."""
    rng = random.Random(3)
    filler = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [filler(400) for _ in range(400)]
    texts = [f"{rng.choice(passages)}{filler(300)}{rng.choice(passages)}" for _ in range(2500)]
    size = sum(map(len, texts))
    block = suffix.Anchored(pa.table({"doc_id": pa.array(range(len(texts))), "text": texts}), suffix.LENGTH)
    keys, n, _ = block.keys()
    told = {0: blocks.squeeze(keys[n > 1], np.zeros(int((n > 1).sum()), np.uint8))}
    assert peak(lambda: suffix.Contexts(block, told, suffix.LENGTH).covered({}, 1)) < 14 * size

    many = np.random.default_rng(3)
    rows = many.integers(97, 105, (60_000, 2 * suffix.LENGTH + 2)).astype(np.uint8)
    rows[:, -2:] = 80, 30
    keys, ids = np.sort(many.integers(0, 1 << 63, len(rows)).astype(np.uint64)), np.arange(len(rows))
    assert peak(lambda: suffix.earlier_windows(rows, keys, ids, suffix.LENGTH)) < 700 * len(rows)


def test_stages_take_small_batches(spark, monkeypatch):
    """Python workers of a stage get their rows some megabytes at a time."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(name, None) is None or int(spark.conf.get(name).rstrip("b")) == BATCH_BYTES
    monkeypatch.setattr(corpus_pipeline.jaccard, "keep_one", lambda docs, **_: docs.mapInArrow(sizes, "n long"))
    docs = spark.range(8000, numPartitions=1).selectExpr("id as doc_id", "repeat('a few words ', 100) as text")
    found = [r["n"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()]
    assert sum(found) > 8_000_000 and max(found) < 1.1 * BATCH_BYTES
