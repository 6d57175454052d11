"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams (two and three bytes of
the lower-cased text, as square roots of their shares) predicts each bit. Decoding is weighted by
loss: a language costs the sum over the bits of the classifier's logistic loss for its codeword,
each bit weighted by how well its classifier did in training, and the cheapest language is chosen.
A document is flagged as ambiguous where the second language costs little more or the signs of the
bits are nearer to no codeword than half the code's distance.

Up to five languages get the exhaustive code (every way to part them in two); more get a random
code of the best of a few draws, with a fixed seed.

The classifiers are fitted on a bounded sample of labelled rows: at most `SAMPLE` whole documents
of each language, those of the least hash of doc_id, and at most `SAMPLE_ALL` of the `LANGUAGES`
commonest languages together. Their features are taken where the texts are; what the driver gets is
8 kB a document (96 MB at most), however long the texts.

Cases: `und` with score 0 for null texts and texts without a letter (Unicode's categories L*), and
for all where there is no labelled row; one language alone is always predicted; null langs, null
doc_ids and held-out rows (crc32(doc_id as text) mod 4 is 2; null doc_ids are not) are not learned
from; of rows with one doc_id and language one is learned from; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import documents, draw, raw_texts, slices
from .wordstream import LOWER

FOLD, HELD_OUT = 4, 2
SAMPLE, SAMPLE_ALL, LANGUAGES = 600, 12_000, 1_000
BUCKETS = 2048
AMBIGUOUS = 0.7


def held_out() -> Column:
    return common.held_out(FOLD, HELD_OUT)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))  # true of the categories Lu, Ll, Lt, Lm and Lo alone


def features(texts: list[bytes]) -> np.ndarray:
    """A row of hashed n-gram shares, square-rooted, for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(t), 1 << 20):
            data = LOWER[np.frombuffer(t, np.uint8, min(len(t) - at, (1 << 20) + 2), at)].astype(np.uint32)
            if len(data) < 2:
                continue
            two = data[:-1] * np.uint32(257) + data[1:]
            grams = [two[: 1 << 20], (two[:-1] * np.uint32(263) + data[2:] + np.uint32(7919))[: 1 << 20]]
            for g in grams:
                total += np.bincount((g * np.uint32(2654435761)) >> np.uint32(21), minlength=BUCKETS)
        out[i] = np.sqrt(total / max(1, total.sum()))
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of bits (-1, 1)."""
    if n <= 5:
        parts = [c for k in range(n) for c in combinations(range(1, n), k) if k < n - 1] if n > 1 else []
        return np.array([[1 if i == 0 or i in c else -1 for c in parts] for i in range(n)]).reshape(n, len(parts))
    rng, best, far = np.random.default_rng(7), None, -1
    bits = max(15, 4 * int(np.ceil(np.log2(n))))
    for _ in range(200 if n <= 64 else 10):
        code = rng.choice([-1, 1], (n, bits))
        while (same := np.abs(code.sum(axis=0)) == n).any():  # a bit that all languages share parts none
            code[:, same] = rng.choice([-1, 1], (n, int(same.sum())))
        d = (bits - (code @ code.T - 2 * bits * np.eye(n, dtype=int)).max()) // 2
        if best is None or d > far:
            best, far = code, d
    return best


@dataclass
class Coder:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its share of the likelihood, and whether it is ambiguous."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        f = x @ self.weights + self.bias
        cost = np.stack([(np.logaddexp(0, -c * f) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(cost.min(axis=1, keepdims=True) - cost)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        wrong = (np.sign(f) != self.code[best]).sum(axis=1)
        n, bits = self.code.shape
        radius = (bits - (self.code @ self.code.T - 2 * bits * np.eye(n, dtype=int)).max()) / 4
        return best, p.max(axis=1), (p.max(axis=1) < AMBIGUOUS) | (wrong >= radius)


def fit(of: list[str], x: np.ndarray, rounds: int = 150, ridge: float = 1e-5) -> Coder:
    """of: the language of each row of features."""
    langs, number, count = np.unique(np.array(of, object), return_inverse=True, return_counts=True)
    langs, code = langs.tolist(), codewords(len(langs))
    y = code[number].astype(np.float32)
    share = (1 / count[number] / len(langs)).astype(np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros((BUCKETS + 1, code.shape[1])), np.zeros((BUCKETS + 1, code.shape[1]))
    for k in range(1, rounds + 1 if len(langs) > 1 else 1):
        g = -y * share[:, None] / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        g = np.concatenate([x.T @ g + ridge * w, g.sum(axis=0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, b = w - step[:-1].astype(np.float32), b - step[-1].astype(np.float32)
    error = ((np.sign(x @ w + b) != y) * share[:, None]).sum(axis=0)
    return Coder(langs, code, w, b, np.maximum(0.05, 1 - 2 * error))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Coder | None:
    """A coder from rows with doc_id, text and lang, as long as they are not held out."""
    rows = documents(docs, "lang").withColumn("lang", F.col("lang").cast("string")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = draw(rows, "lang", sample, LANGUAGES, SAMPLE_ALL)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = raw_texts(batch.column("text"))
            for k in range(0, len(texts), 500):
                x = features(texts[k : k + 500])
                hashes = batch.column("_h").slice(k, 500)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(k, 500), batch.column("doc_id").slice(k, 500), hashes, pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "doc_id", "_h", "x"])

    taken = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).withColumn("_h", F.xxhash64("text")).select("lang", "doc_id", "_h", "text")
    one = taken.mapInArrow(take, "lang string, doc_id long, _h long, x binary").groupBy("lang", "doc_id").agg(F.min_by("x", "_h").alias("x"))
    found = one.orderBy("lang", "doc_id").collect()  # SAMPLE_ALL rows of 8 kB at most
    return fit([r["lang"] for r in found], np.stack([np.frombuffer(r["x"], np.float32) for r in found])) if found else None


def identify(docs: DataFrame, coder: Coder | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(coder)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Coder | None = sent.value
        for batch in slices(batches):
            texts = raw_texts(batch.column("text"))
            legible = np.array([has_letter(t.decode()) for t in texts], bool) & (model is not None)
            langs, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if legible.any():
                at = np.flatnonzero(legible)
                best, score[at], unsure[at] = model.predict(features([texts[i] for i in at]))
                for i, k in zip(at.tolist(), best.tolist()):
                    langs[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(score), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return documents(docs).withColumn("held_out", held_out()).mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
