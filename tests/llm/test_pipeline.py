"""The pipeline's stages on a small corpus, each against brute force over its own input."""

import numpy as np
import pytest

import corpus_pipeline
from specloom.llm import packing, toxicity

from .test_decontaminate import words
from .test_models import corpus
from .test_simhash import brute_components, brute_fp
from .test_suffix import brute as brute_repeats


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, lang, f"s{d % 3}", len(t)) for d, t, lang, _ in corpus(120, 4)]
    rows += [(1000 + k, rows[k][1], "xx", "copy", rows[k][4]) for k in range(5)]
    rows += [(2000 + k, f"{rows[k][1]} {rows[40][1]}", "xx", "passage", 0) for k in range(6, 10)]
    bench = " ".join(f"item{k}" for k in range(14))
    rows += [(3000, f"ka lo {bench} mi ne", "xx", "leak", 0), (3001, None, None, None, None), (3002, "", "xx", "empty", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(d, 1, x) for d, _, _, x in corpus(120, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{home}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, home).write.parquet(f"{home}/{name}")
        out[name] = ([tuple(r) for r in docs.select("doc_id", "text").collect()], spark.read.parquet(f"{home}/{name}"), docs)
        docs = out[name][1]
    return home, out


def test_stages(spark, stages):
    home, out = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(out[n][1].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])

    before, after, docs = out["toxicity"]
    net, shift = toxicity.learn(docs, spark.read.parquet(f"{home}/labels.parquet"))
    score = toxicity.probability(net, shift, [(t or "").encode() for _, t in before])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for (d, _), s in zip(before, score) if s < 0.5)
    truth = {d: x for d, _, _, x in corpus(120, 4)}
    assert np.mean([(d in {r["doc_id"] for r in after.collect()}) != bool(truth[d]) for d, _ in before if d in truth]) > 0.9

    before, after, _ = out["simhash_near_dedup"]
    firsts = {*brute_components([(d, brute_fp(t)) for d, t in before])}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(firsts)

    before, after, _ = out["suffix_array_dedup"]
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in after.collect()}
    assert all(n - gone - 3 * spans * 2 <= sizes[d] <= n - gone for d, n, gone, spans, _ in brute_repeats(before)) and sum(r[2] for r in brute_repeats(before)) > 0

    before, after, _ = out["decontamination"]
    assert all("item3" not in words(r["text"]) for r in after.collect()) and {r["doc_id"]: r["text"] for r in after.collect()}[3000].split() == ["ka", "lo", "mi", "ne"]
    assert sum(t == dict(before)[d] for d, t in [(r["doc_id"], r["text"]) for r in after.collect()]) == len(before) - 1

    before, after, _ = out["best_fit_packing"]
    tokens = packing.Words(packing.default_tokenizer())
    assert after.agg({"length": "sum"}).first()[0] == sum(len(tokens.ids([t or ""])[0]) // 4 + 1 for _, t in before)


def test_run(spark, stages):
    home, out = stages
    assert corpus_pipeline.run(spark, home).count() == out["best_fit_packing"][1].count()
