"""The trained models: held-out accuracy, defined cases, and counts against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from specloom.llm import langid, maxent, toxicity

SYLLABLES = {"xx": "ka lo mi ne ru".split(), "yy": "sch ung ber ein ßt".split(), "zz": "tion eau que ré ç".split()}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "moron", "trash"]))
        rows.append((k, " ".join(words), lang, toxic))
    return rows


ODD = [(1000, None, None, None), (1001, "", "xx", 1), (1002, "123 !?", None, 0), (1003, "ka lo mi " * 30000, "xx", None), (None, "ka lo mi ne", "xx", 1), (5, "ka lo", "xx", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, lang) for d, t, lang, _ in corpus() + ODD], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "true as held_out").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, x) for d, _, _, x in corpus() + ODD], "doc_id long, toxic int").selectExpr("*", "1 as text")


def fold(d, n):
    return None if d is None else zlib.crc32(str(d).encode()) % n


def test_toxicity(docs, labels):
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(corpus()) + len(ODD)
    truth = {d: x for d, _, _, x in corpus()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in toxicity.toxicity(docs.limit(5), labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_absent_documents_teach_nothing(spark, docs, labels):
    """A shard of a corpus with the labels of all of it learns what it learns from its own."""
    absent = spark.range(10_000, 60_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic", "1 as text")
    own, more = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).where("doc_id is not null").collect()} for x in (labels, labels.union(absent)))
    assert own == more and len(set(own.values())) > 10


def test_gradients():
    texts = [b"one two three four five idiot", b"", b"six seven"]
    net, x = toxicity.Network(3), toxicity.Inputs(texts)
    pick, y, weight = np.arange(len(x.of)), np.array([1, 0, 0], np.float32), np.ones(3, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradients(x, pick, y, weight)
    rng = np.random.default_rng(1)
    for name, value in net.p.items():
        spots = np.argwhere(np.abs(g[name]) > np.abs(g[name]).max() / 3)
        at = tuple(spots[rng.integers(len(spots))])
        old, loss = value[at], []
        for d in (1e-2, -1e-2):
            value[at] = old + d
            loss.append(net.gradients(x, pick, y, weight)[1])
        value[at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - g[name][at]) < 3e-3 + 0.05 * abs(g[name][at]), name


def test_windows_cover_the_text():
    x = toxicity.Inputs([b"w " * n for n in (0, 1, 24, 25, 36, 37, 100)])
    for k, n in enumerate((0, 1, 24, 25, 36, 37, 100)):
        own = x.of == k
        base = sum((0, 1, 24, 25, 36, 37, 100)[:k])
        covered = {i for a, b in zip(x.at[own], x.end[own]) for i in range(a - base, b - base)}
        assert covered == set(range(n)) and own.sum() >= 1


def test_language(docs):
    rows = langid.identify_languages(docs).collect()
    truth = {d: lang for d, _, lang, _ in corpus()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    for r in rows:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.identify_languages(docs.where("lang = 'xx' and length(text) > 0")).collect()} == {"xx"}
    assert langid.identify_languages(docs.limit(0)).count() == 0


def test_codewords():
    for n in (1, 2, 3, 4, 5, 9):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code.tolist()}) == n
    assert langid.codewords(4).shape == (4, 7)


def test_language_model(docs):
    rows = maxent.score_documents(docs).collect()
    own = [(d, t) for d, t, _, _ in corpus() + ODD]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    counts = Counter(w for d, t in own if fold(d, 7) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, fold(d, 7) == 2, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for d, t in own), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), key=str) == want
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert maxent.score_documents(docs.limit(0)).count() == 0


def test_the_model_is_a_distribution(docs):
    model = maxent.train(docs.select("doc_id", "text"), 2)
    t = maxent.Tokens([b"ka lo mi ne", b"new words here"])
    assert np.allclose(model.probs(t.features()).sum(axis=1), 1, atol=1e-4)


def test_words_with_structure_have_hashes_of_their_own():
    """Thue-Morse words cancel in any polynomial hash modulo a power of two."""
    from specloom.llm.wordstream import Words

    word = b"a"
    for _ in range(13):
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        got = Words([word + b" " + other + b" " + word]).hash
        assert got[0] != got[1] and got[0] == got[2]
        word += other
    rng = random.Random(1)
    words = {bytes(rng.choices(b"ab", k=rng.randint(1, 9000))) for _ in range(400)}
    assert len(np.unique(Words([b" ".join(sorted(words))]).hash)) == len(words)


def test_texts_without_a_letter_have_no_language(spark):
    rows = [(k, t, "xx") for k, t in enumerate(["ka lo mi ne", "½ ①", "²", "١٢٣ _", "ª", "字", "́", "Ⅷ"])]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k for k, v in got.items() if v == ("und", 0.0)} == {1, 2, 3, 6, 7}


def test_samples_are_bounded(spark, monkeypatch):
    """Many rows of one doc_id, and very long texts, reach the driver once or not at all."""
    rows = [(1, f"ka lo {k}", "xx", 1) for k in range(500)] + [(k, "ka lo mi ne", "yy", k % 2) for k in range(2, 200)] + [(7, "ka " * 60_000, "xx", 1)]
    docs, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(d, x) for d, _, _, x in rows], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda of, x: seen.update(langs=of))
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.update(rows=rows))
    monkeypatch.setattr(toxicity, "calibrate", lambda net, rows: 0.0)
    langid.learn(docs, 20)
    assert Counter(seen["langs"])["yy"] == 20 and Counter(seen["langs"])["xx"] <= 2
    toxicity.learn(docs, labels, 20)
    assert Counter(t for t, _ in seen["rows"]) == {0: 20, 1: 20} and max(len(t) for _, t in seen["rows"]) < 1 << 17


def plain_score(net, text):
    """The worst window of a text, word by word and state by state."""
    p, sig = net.p, lambda v: 1 / (1 + np.exp(-v))
    x = toxicity.Inputs([text])
    inputs = []
    for w in range(len(x.word)):
        grams = x.gram[x.first[w] : x.first[w] + x.size[w]]
        inputs.append(np.concatenate([p["word"][x.word[w]], sum((p["gram"][g] for g in grams), np.zeros(toxicity.EMBED)) / math.sqrt(x.size[w])]))
    h, best = toxicity.HIDDEN, -math.inf
    for at in range(max(1, len(inputs) - toxicity.WINDOW + 1)):
        own = inputs[at : at + toxicity.WINDOW]
        both = []
        for d, order in (("f", own), ("b", own[::-1])):
            state, out = np.zeros(h), []
            for v in order:
                g, r = v @ p[f"x{d}"] + p[f"c{d}"], state @ p[f"h{d}"]
                z, q = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                state = state + z * (np.tanh(g[2 * h :] + q * r[2 * h :]) - state)
                out.append(state)
            both.append(out if d == "f" else out[::-1])
        states = [np.concatenate(pair) for pair in zip(*both)]
        weight = np.array([math.exp(np.tanh(s @ p["a"] + p["ac"]) @ p["v"]) for s in states])
        pooled = sum((w * s for w, s in zip(weight / weight.sum(), states)), np.zeros(2 * h)) if states else np.zeros(2 * h)
        best = max(best, float(pooled @ p["u"] + p["uc"][0]))
        if at + toxicity.WINDOW >= len(inputs):
            break
    return best


def test_the_network_against_a_plain_one():
    rng = random.Random(6)
    texts = [" ".join(rng.choices("ka lo mi Idiot ne été x".split(), k=n)).encode() for n in (0, 1, 5, 23, 24, 25, 30, 31, 60, 137)]
    net = toxicity.Network(4)
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=2e-4)


def test_decoding_against_a_plain_one():
    rng = np.random.default_rng(2)
    langs = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    code = langid.codewords(len(langs))
    coder = langid.Coder(langs, code, rng.standard_normal((langid.BUCKETS, code.shape[1])).astype(np.float32), rng.standard_normal(code.shape[1]).astype(np.float32), rng.random(code.shape[1]))
    texts = [b"ka lo mi", b"x", b"", "été".encode() * 50]
    best, score, unsure = coder.predict(langid.features(texts))
    for k, t in enumerate(texts):
        grams = [0] * langid.BUCKETS
        low = t.lower()
        for a, b in zip(low, low[1:]):
            grams[((a * 257 + b) * 2654435761 % 2**32) >> 21] += 1
        for a, b, c in zip(low, low[1:], low[2:]):
            grams[(((a * 257 + b) * 263 + c + 7919) * 2654435761 % 2**32) >> 21] += 1
        x = [math.sqrt(g / max(1, sum(grams))) for g in grams]
        bits = [sum(v * w for v, w in zip(x, coder.weights[:, j].tolist())) + float(coder.bias[j]) for j in range(code.shape[1])]
        cost = [sum(trust * math.log1p(math.exp(-c * f)) for trust, c, f in zip(coder.trust, row, bits)) for row in code]
        likely = [math.exp(-c) for c in cost]
        wrong = sum((f > 0) != (c > 0) for f, c in zip(bits, code[int(np.argmin(cost))]))
        distance = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert best[k] == int(np.argmin(cost)) and abs(score[k] - max(likely) / sum(likely)) < 1e-3
        assert unsure[k] == (score[k] < langid.AMBIGUOUS or wrong >= distance / 2)


def test_scores_against_a_plain_model(docs, monkeypatch):
    """Each token's P(class | history) * P(word | class), from the model's own weights and plain counts."""
    kept = {}
    real = maxent.train
    monkeypatch.setattr(maxent, "train", lambda *a: kept.setdefault("model", real(*a)))
    rows = maxent.score_documents(docs, 2).collect()
    m = kept["model"]
    texts = [(d, (t or "").encode()) for d, t, _, _ in corpus() + ODD if t is None or len(t) < 5000]
    counts, kind_of = Counter(), {}
    for d, t in [(d, (t or "").encode()) for d, t, _, _ in corpus() + ODD]:
        tokens = maxent.Tokens([t])
        keys, kinds = tokens.key.tolist(), m.classes(tokens).tolist()
        kind_of.update(zip(keys, kinds))
        if fold(d, 7) != 2:
            counts.update(keys)
    of_class, words_of = Counter(), Counter()
    for key, n in counts.items():
        of_class[kind_of[key]] += n
        words_of[kind_of[key]] += 1
    want = []
    for d, t in texts:
        tokens = maxent.Tokens([t])
        x, score = tokens.features(), 0.0
        for i, (key, kind) in enumerate(zip(tokens.key.tolist(), m.classes(tokens).tolist())):
            z = [float(m.bias[c]) + sum(float(m.weights[f][x[f][i]][c]) for f in range(maxent.FEATURES)) for c in range(maxent.CLASSES)]
            score += math.log10(math.exp(z[kind]) / sum(map(math.exp, z)))
            end = kind == maxent.END_CLASS
            score += math.log10((counts[key] + 1) / (of_class[kind] + 1 if end else of_class[kind] + words_of[kind] + 1))
        want.append((str(d), fold(d, 7) == 2, round(min(score, 0.0), 2)))
    sizes = {len(t.split()) + 1 for _, t in texts}
    got = [(str(r["doc_id"]), r["held_out"], round(r["score"], 2)) for r in rows if r["n_tokens"] <= max(sizes)]
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.02 for a, b in zip(sorted(got), sorted(want)))


def test_sums_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(maxent, "ADD_PARTS", 2)
    rows = spark.createDataFrame([(k, "x" * k) for k in range(50)], "doc_id long, text string").repartition(9)
    (got,) = maxent._sums(rows, lambda texts: [np.bincount([len(t) % 7 for t in texts], minlength=300_000).astype(float)])
    assert got.tolist() == np.bincount([k % 7 for k in range(50)], minlength=300_000).tolist()


def test_class_scores_work_in_the_room_they_are_given():
    """Chunk after chunk needs no arrays of its own, and gives what it gives alone."""
    rng = np.random.default_rng(3)
    model = maxent.Model(np.zeros(maxent.WORD_BUCKETS, np.int64), np.zeros(maxent.TAIL_BUCKETS, np.int64), rng.standard_normal(maxent.CLASSES).astype(np.float32), rng.standard_normal((maxent.FEATURES, maxent.ROWS, maxent.CLASSES)).astype(np.float32))
    features, kind, room = rng.integers(0, maxent.ROWS, (maxent.FEATURES, 50)).astype(np.uint16), rng.integers(0, maxent.CLASSES, 50), np.empty((2, 20, maxent.CLASSES), np.float32)
    z = sum(model.weights[f].astype(float)[features[f]] for f in range(maxent.FEATURES)) + model.bias
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    for k in range(0, 50, 20):
        x = features[:, k : k + 20]
        p = model.probs(x, room)
        assert np.shares_memory(p, room) and np.array_equal(p, model.probs(x)) and np.allclose(p, want[k : k + 20], rtol=1e-4)
        assert np.allclose(model.log_prob_of(x, kind[k : k + 20], room), np.log(want[np.arange(k, min(50, k + 20)), kind[k : k + 20]]), rtol=1e-4)


def test_training_inputs_are_joined_from_parts(monkeypatch):
    """What training holds of all texts is the same read part by part."""
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 60)
    texts = [b"", b"one", b" two  three ", b"a b c d e f g h i j k l", b"x" * 90, b"", "é ü".encode()] * 3
    whole, parts = toxicity.Inputs(texts), toxicity.Inputs.joined(texts)
    assert len(toxicity._parts(texts)) > 3
    for name in ("first", "size", "gram", "word", "counts", "windows", "at", "end", "of"):
        assert getattr(whole, name).tolist() == getattr(parts, name).tolist()
    value = np.random.default_rng(3).normal(size=len(whole.word))
    assert toxicity.window_maxima(value, whole.at, whole.end).tolist() == [value[a:b].max() if b > a else 0 for a, b in zip(whole.at.tolist(), whole.end.tolist())]
    assert toxicity.Inputs.joined([]).at.tolist() == []


def test_expectations_add_up_without_an_index_for_each_class(monkeypatch):
    """Rows of histories are added in pairs of classes, exactly as one by one; distinct keys are those of a sort."""
    rng = np.random.default_rng(8)
    rows, values = rng.integers(0, 9, (maxent.FEATURES, 70)), rng.random((70, maxent.CLASSES), np.float32)
    sums = np.ones((maxent.FEATURES, 9 * maxent.CLASSES))
    monkeypatch.setattr(np, "bincount", None)
    maxent.add_rows(sums, rows.astype(np.uint16), values)
    want = np.ones((maxent.FEATURES, 9, maxent.CLASSES))
    for f in range(maxent.FEATURES):
        for row, value in zip(rows[f].tolist(), values.astype(float)):
            want[f, row] += value
    assert sums.tolist() == want.reshape(sums.shape).tolist()
    for keys in (np.zeros(0, np.uint64), np.array([2**64 - 1, 0, 7, 0, 2**63], np.uint64), rng.integers(0, 50, 400).astype(np.uint64)):
        found, place, of = maxent.distinct(keys)
        assert found.tolist() == np.unique(keys).tolist() and found[of].tolist() == keys.tolist() and keys[place].tolist() == found.tolist()


def test_words_are_hashed_place_by_place(monkeypatch):
    """Short words need no place for each of their bytes; hashes are the sums of the bytes' values all the same."""
    from specloom.llm import wordstream

    asked, real = [], wordstream.byte_values
    monkeypatch.setattr(wordstream, "byte_values", lambda data, within: asked.append(len(data)) or real(data, within))
    texts = [b"", b" To be\tOR not  ", b"a" * 23 + b" " + b"b" * 24 + b" " + b"c" * 25, bytes(range(256)), b"d" * 9000]
    found = wordstream.Words(texts)
    words = [w for t in texts for w in re.split(rb"[\x20\x09-\x0D]+", t.lower()) if w]
    assert sum(asked) < sum(len(w) for w in words if len(w) > 24)
    assert found.doc.tolist() == [1] * 4 + [2] * 3 + [3] * 3 + [4] and found.counts.tolist() == [0, 4, 3, 3, 1]
    assert found.hash.tolist() == [int(wordstream.mix(np.array([(real(np.frombuffer(w, np.uint8), np.arange(len(w))).sum() + np.uint64(len(w)))], np.uint64))[0]) for w in words]
