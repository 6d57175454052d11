"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are an embedding of its hash and the embeddings of its character 4-grams (of
bytes, with the white space around it as its borders). Two gated recurrent units read
a window of words in both directions; attention weighs their states; a logistic unit scores the
window. A text is scored in all its overlapping windows of `WINDOW` words, one beginning at each
word; its score is that of its worst window.

Training is on the driver, on a bounded sample of labelled rows: at most `SAMPLE` documents of
each label, those of the least hash of doc_id among the documents that are there, of at most
`SAMPLE_TEXT` bytes each and `SAMPLE_BYTES` a label together (longer ones are scored like any other,
but not drawn). Embeddings start with one coordinate at the log-odds of a toxic document given the word or gram, and noise in the others. A label is of a document, so
of a toxic one only the worst windows are examples, at first by those log-odds, then by the network
itself; of the clean ones all windows can be, and the worst are drawn more often.

Cases: null, empty and wordless texts have one window without words, and its score; labels that are
null or of unknown documents teach nothing; without both labels every score is the share of toxic
rows, or 0; held-out rows (crc32(doc_id as text) mod 5 is 0; null doc_ids are not) are not learned
from; of rows with one doc_id one is learned from; repeated rows are scored alike; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import documents, draw, give_back, raw_texts, slices
from .wordstream import WHITE, Words

FOLD, HELD_OUT = 5, 0
SAMPLE, SAMPLE_TEXT, SAMPLE_BYTES = 900, 1 << 17, 12 << 20
WINDOW = 10
WORDS, GRAMS, EMBED, HIDDEN = 1 << 13, 1 << 14, 8, 8
STEPS = (250, 150, 150)
BATCH = 128
TRAIN_BYTES = 1 << 19


def held_out() -> Column:
    return common.held_out(FOLD, HELD_OUT)


class Inputs:
    """Of many texts: each word's bucket, its 4-grams' buckets (flat, with where each word's begin), and the windows."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, gap=3)
        data = np.where(WHITE[words.data], 0x20, words.data).astype(np.uint32)
        gram = np.zeros(len(data), np.int32)
        four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
        four = (four ^ four >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        gram[1:-2] = (four ^ four >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(32 - 14)
        size = words.end - words.start
        self.first = np.cumsum(size) - size
        self.size = size
        self.gram = gram[~WHITE[words.data]]
        self.word = ((words.hash >> np.uint64(33)) & np.uint64(WORDS - 1)).astype(np.int32)
        self.counts = n = words.counts
        self.windows = np.maximum(1, n - WINDOW + 1)
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), self.windows)
        k = np.arange(self.windows.sum()) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.at = begin[of] + k
        self.end = np.minimum(begin[of] + n[of], self.at + WINDOW)
        self.of = of

    @classmethod
    def joined(cls, texts: list[bytes]) -> Inputs:
        """The same, read some texts at a time: what is worked out for each byte is held for a part alone."""
        parts = [cls(p) for p in _parts(texts)] or [cls([])]
        before = lambda of: (np.cumsum([0, *map(of, parts[:-1])])).tolist()
        words, grams, docs = before(lambda x: len(x.word)), before(lambda x: len(x.gram)), before(lambda x: len(x.counts))
        out = cls.__new__(cls)
        for name, ahead in (("first", grams), ("size", None), ("gram", None), ("word", None), ("counts", None), ("windows", None), ("at", words), ("end", words), ("of", docs)):
            setattr(out, name, np.concatenate([(getattr(x, name) + k).astype(np.int32) for x, k in zip(parts, ahead or [0] * len(parts))]))  # of a bounded sample
        return out


def _parts(texts: list[bytes]) -> list[list[bytes]]:
    """Of about `TRAIN_BYTES` each."""
    cuts = np.cumsum([len(t) for t in texts]) // TRAIN_BYTES
    edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(texts)]
    return [texts[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name; forward for scoring, and with what backward needs."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        make = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"word": make(WORDS, EMBED, by=0.05), "gram": make(GRAMS, EMBED, by=0.05)}
        for d in "fb":
            self.p |= {f"x{d}": make(2 * EMBED, 3 * HIDDEN), f"h{d}": make(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": make(2 * HIDDEN, HIDDEN), "ac": np.zeros(HIDDEN, np.float32), "v": make(HIDDEN), "u": make(2 * HIDDEN), "uc": np.zeros(1, np.float32)}

    def embed(self, x: Inputs) -> np.ndarray:
        out = np.empty((len(x.word), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.p["word"][x.word]
        if len(x.word):
            for k in range(0, len(x.word), 1 << 14):
                first = x.first[k : k + (1 << 14)]
                stop = x.first[k + (1 << 14)] if k + (1 << 14) < len(x.first) else len(x.gram)
                out[k : k + (1 << 14), EMBED:] = np.add.reduceat(self.p["gram"][x.gram[first[0] : stop]], first - first[0], axis=0)
            out[:, EMBED:] /= np.sqrt(x.size[:, None]).astype(np.float32)
        return out

    def windows(self, projected: tuple[np.ndarray, np.ndarray], at: np.ndarray, end: np.ndarray, keep: bool = False):
        """Logits of windows; projected: the words' inputs to the gates of either direction."""
        n, steps, h = len(at), WINDOW, HIDDEN
        rows = at[None, :] + np.arange(steps)[:, None]
        real = rows < end[None, :]
        rows = np.where(real, rows, 0)
        states, saved = np.zeros((steps, n, 2 * h), np.float32), {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            w, s = self.p[f"h{d}"], np.zeros((n, h), np.float32)
            for t in order:
                g = projected["fb".index(d)][rows[t]] if len(projected[0]) else np.zeros((n, 3 * h), np.float32)
                r = s @ w
                zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, q = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + q * r[:, 2 * h :])
                new = (s + z * (c - s)) * real[t][:, None] + s * ~real[t][:, None]
                if keep:
                    saved[d, t] = s, z, q, c, r[:, 2 * h :]
                s = new
                (states[t, :, :h] if d == "f" else states[t, :, h:])[...] = s
        e = np.tanh(states @ self.p["a"] + self.p["ac"])
        weight = np.where(real, e @ self.p["v"], -30)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (states * weight[:, :, None]).sum(axis=0)
        logit = pooled @ self.p["u"] + self.p["uc"][0]
        return (logit, (rows, real, states, saved, e, weight, pooled)) if keep else logit

    def all_windows(self, projected: tuple[np.ndarray, np.ndarray], first: int, last: int) -> np.ndarray:
        """Logits of the windows that begin at the words from first to last, each of `WINDOW` words: step by step for all, over slices that lie one word apart."""
        h, n = HIDDEN, last - first
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        for d, order, part in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            w, s, own = self.p[f"h{d}"], np.zeros((n, h), np.float32), projected["fb".index(d)]
            for t in order:
                g = own[first + t : last + t]
                r = s @ w
                zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                s = s + zr[:, :h] * (np.tanh(g[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :]) - s)
                states[t, :, part] = s
        weight = np.tanh(states @ self.p["a"] + self.p["ac"]) @ self.p["v"]
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        return (states * weight[:, :, None]).sum(axis=0) @ self.p["u"] + self.p["uc"][0]

    def project(self, embedded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(embedded @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb")

    def score(self, texts: list[bytes], by_window: bool = False):
        """Logits of texts, or of all windows with the texts that they are of."""
        x = Inputs(texts)
        projected = self.project(self.embed(x))
        end = len(x.word) - WINDOW + 1
        every = [self.all_windows(projected, k, min(k + 2048, end)) for k in range(0, end, 2048)]
        every = np.concatenate([*every, np.zeros(len(x.word) + 1 - max(0, end), np.float32)])  # by their first words; those across texts are of none
        logit = every[x.at]
        short = np.flatnonzero(x.end - x.at < WINDOW)
        for k in range(0, len(short), 2048):
            own = short[k : k + 2048]
            logit[own] = self.windows(projected, x.at[own], x.end[own])
        return (logit, x) if by_window else np.maximum.reduceat(logit, np.cumsum(x.windows) - x.windows)

    def gradients(self, x: Inputs, pick: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[dict, float]:
        """Of the mean logistic loss of some windows."""
        h, p = HIDDEN, self.p
        at, end = x.at[pick], x.end[pick]
        used = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(at, end)] or [np.zeros(0, np.int64)]))
        n_grams = x.size[used]
        each = np.sqrt(n_grams[:, None]).astype(np.float32)
        grams = np.repeat(x.first[used] - (np.cumsum(n_grams) - n_grams), n_grams) + np.arange(n_grams.sum())
        embedded = np.empty((len(used), 2 * EMBED), np.float32)
        embedded[:, :EMBED] = p["word"][x.word[used]]
        if len(used):
            embedded[:, EMBED:] = np.add.reduceat(p["gram"][x.gram[grams]], np.cumsum(n_grams) - n_grams, axis=0) / each
        begin = np.searchsorted(used, at)  # windows are of consecutive words
        logit, (rows, real, states, saved, e, weight, pooled) = self.windows(self.project(embedded), begin, begin + (end - at), keep=True)
        prob = _sigmoid(logit)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((prob - y) * importance / len(y)).astype(np.float32)
        g["u"], g["uc"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["u"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_states = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = (e * d_score[:, :, None]).sum(axis=(0, 1))
        d_e = d_score[:, :, None] * p["v"] * (1 - e * e)
        g["a"], g["ac"] = states.reshape(-1, 2 * h).T @ d_e.reshape(-1, h), d_e.sum(axis=(0, 1))
        d_states = d_states + d_e @ p["a"].T
        d_embedded = np.zeros_like(embedded)
        for d, order, part in (("f", range(WINDOW - 1, -1, -1), slice(0, h)), ("b", range(WINDOW), slice(h, 2 * h))):
            back, d_in = np.zeros((len(pick), h), np.float32), np.zeros((len(used), 3 * h), np.float32)
            for t in order:
                s, z, q, c, r = saved[d, t]
                live = real[t][:, None]
                ds = (d_states[t, :, part] + back) * live
                dc, dz = ds * z * (1 - c * c), ds * (c - s) * z * (1 - z)
                dq = dc * r * q * (1 - q)
                d_g = np.concatenate([dz, dq, dc], axis=1)
                d_r = np.concatenate([dz, dq, dc * q], axis=1)
                g[f"h{d}"] += s.T @ d_r
                g[f"c{d}"] += d_g.sum(axis=0)
                np.add.at(d_in, rows[t][real[t]], d_g[real[t]])
                back = ds * (1 - z) + d_r @ p[f"h{d}"].T + (d_states[t, :, part] + back) * ~live
            g[f"x{d}"] = embedded.T @ d_in
            d_embedded += d_in @ p[f"x{d}"].T
        np.add.at(g["word"], x.word[used], d_embedded[:, :EMBED])
        np.add.at(g["gram"], x.gram[grams], np.repeat(d_embedded[:, EMBED:] / each, n_grams, axis=0))
        return g, float(-(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9) * importance).mean())


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.k = net, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.k += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.99 * self.v[k] + 0.01 * x * x
            self.net.p[k] = (self.net.p[k] - self.rate * (self.m[k] / (1 - 0.9**self.k)) / (np.sqrt(self.v[k] / (1 - 0.99**self.k)) + 1e-7)).astype(np.float32)


def log_odds(bucket: np.ndarray, sizes: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Of a toxic document given that it has something of a bucket, from documents' presence; shrunk where little is known. sizes: how many of the buckets are of each document."""
    seen = np.zeros((2, size))
    for label, part in zip(y.tolist(), np.split(bucket, np.cumsum(sizes)[:-1])):
        seen[label][np.unique(part)] += 1
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    return np.log((seen[1] / n1 + 1 / (n1 + n0)) / (seen[0] / n0 + 1 / (n1 + n0))) * (seen.sum(axis=0) > 1)


def window_logits(net: Network, texts: list[bytes]) -> np.ndarray:
    """Of all windows of many texts, some at a time: the driver's memory is that of a part."""
    return np.concatenate([net.score(p, by_window=True)[0] for p in _parts(texts)])


def window_maxima(values: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest value of each window (words from at to end); 0 of a window without words."""
    out = np.full(len(at), -np.inf)
    for j in range(WINDOW):
        own = np.flatnonzero(at + j < end)
        out[own] = np.maximum(out[own], values[at[own] + j])
    return np.where(end > at, out, 0)


def train(rows: list[tuple[int, bytes]], steps: tuple[int, ...] = STEPS, seed: int = 11) -> Network:
    """rows: label and text."""
    rng, net = np.random.default_rng(seed), Network(seed)
    y = np.array([t for t, _ in rows])
    x = Inputs.joined([t for _, t in rows])
    grams = np.add.reduceat(np.append(x.size, 0), np.minimum(np.cumsum(x.counts) - x.counts, len(x.size))) * (x.counts > 0)
    word, gram = log_odds(x.word, x.counts, y, WORDS), log_odds(x.gram, grams, y, GRAMS)
    net.p["word"][:, 0], net.p["gram"][:, 0] = word / 3, gram / 3
    of_window, per = y[x.of], np.cumsum(x.windows) - x.windows
    toxic, clean = np.flatnonzero(of_window == 1), np.flatnonzero(of_window == 0)
    word, gram = np.maximum(word, 0).astype(np.float32), np.maximum(gram, 0).astype(np.float32)
    by_word = word[x.word] + (np.add.reduceat(gram[x.gram], x.first) / np.sqrt(x.size) if len(x.word) else 0)
    logit = window_maxima(np.broadcast_to(by_word, len(x.word)), x.at, x.end)
    adam = Adam(net, 0.005)
    for count in steps:
        worst = np.maximum.reduceat(logit, per)
        positive = toxic[logit[toxic] >= worst[x.of[toxic]] - 0.2 * np.abs(worst[x.of[toxic]])]
        hard = clean[np.argsort(-logit[clean])[: max(BATCH, len(clean) // 50)]]
        for _ in range(count):
            pick = np.concatenate([rng.choice(positive, BATCH // 2), rng.choice(clean, BATCH // 4), rng.choice(hard, BATCH // 4)])
            g, _ = net.gradients(x, pick, of_window[pick].astype(np.float32), np.ones(len(pick), np.float32))
            adam.step(g)
        logit = window_logits(net, [t for _, t in rows])
    return net


def calibrate(net: Network, rows: list[tuple[int, bytes]]) -> float:
    """The shift of the logit at which the training rows' labels are met best, half-way to either side."""
    y = np.array([t for t, _ in rows])
    logit = np.concatenate([net.score(p) for p in _parts([t for _, t in rows])]).astype(float)
    order = np.argsort(logit)
    logit, y = logit[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]]) * 1.0
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edges = np.concatenate([[logit[0] - 2], logit, [logit[-1] + 2]])
    return float((edges[k] + edges[k + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(network, shift) from labelled rows that are not held out; a share of toxic rows where only one label is there."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    fits = F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT)
    there = documents(docs).where(fits)
    chosen = draw(marks.join(there.select("doc_id").distinct(), "doc_id", "left_semi"), "toxic", sample, 2, 2 * sample)  # labels of other documents take no place
    taken = there.join(F.broadcast(chosen), "doc_id").groupBy("toxic", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # of `sample` rows
    taken = taken.withColumn("_bytes", F.sum(F.octet_length("text")).over(upto)).where(F.col("_bytes") <= SAMPLE_BYTES)
    rows = [(r["toxic"], r["text"].encode()) for r in taken.orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "text").collect()]  # of SAMPLE_BYTES a label at most
    y = [t for t, _ in rows]
    if len({*y}) < 2:
        return None, float(np.mean(y)) if y else 0.0
    net = train(rows)
    shift = calibrate(net, rows)
    give_back()
    return net, shift


def score_documents(docs: DataFrame, model, *keep: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, with the columns in `keep`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = documents(docs, *keep).withColumn("held_out", held_out())
    more = [f for f in own.schema.fields if f.name not in ("text",)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, shift = sent.value
        for batch in slices(batches, most=1 << 19):
            score = probability(net, shift, raw_texts(batch.column("text")))
            columns = [batch.column(f.name) for f in more] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in more), "score", "predicted"])

    return own.mapInArrow(scan, T.StructType([*more, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def probability(net: Network | None, shift: float, texts: list[bytes]) -> np.ndarray:
    return np.full(len(texts), shift) if net is None else _sigmoid(net.score(texts).astype(np.float64) - shift)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels))


def reject(docs: DataFrame, model) -> DataFrame:
    """docs without the rows that score 0.5 or more; columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.withColumn("text", F.col("text").cast("string"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, shift = sent.value
        for batch in slices(batches, most=1 << 18):
            yield batch.filter(pa.array(probability(net, shift, raw_texts(batch.column("text"))) < 0.5))

    return own.mapInArrow(scan, own.schema)
