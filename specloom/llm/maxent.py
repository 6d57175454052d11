"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class | history) * P(word | class)

The class factor is log-linear: a weight for each class and each value of hashed features of the
history (the word before, the words two and three before as skips, the pair before). It is trained
by gradient updates over all training text: tasks sum observed and expected counts of features and
classes over their part, the sums are added by slices, and the driver takes a step scaled by the
expected counts (the first, from no weights at all, in logarithms of both). The word factor is counts within the class, with one more for each word and for
one unknown word, so the whole is a distribution.

Classes: the commonest words (by hash) are classes of their own, as is the end of a text; other words
are classed by their endings, of which those that follow the same words are put together (k-means on
the corpus's counts of ending and word before). Counts of words, over all training text, are asked
for by blocks (see blocks): each learns the counts of its own words, nothing else.

Cases: null texts are empty: their only token is the end; a word that training hasn't counts as the
unknown word of its class; null doc_ids are training rows; without training rows every token is
unknown; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import documents, durable, raw_texts, slices, text_bytes
from .wordstream import Words, mix

FOLD, HELD_OUT = 7, 2
COMMON, TAIL_CLASSES = 31, 32
CLASSES = COMMON + TAIL_CLASSES + 1
END_CLASS = CLASSES - 1
WORD_BUCKETS, TAIL_BUCKETS, NEAR_BUCKETS = 1 << 16, 1 << 11, 1 << 7
FEATURES, ROWS = 4, 1 << 12
UPDATES = 4
SMOOTH = 4.0
RATE = 0.45
SHARD_BYTES = 16 << 20
#: Parts of a sum that are added at once.
ADD_PARTS = 64
#: Text that a task adds up at least, where each core has so many tasks.
SUM_BYTES, TASKS_A_CORE = 48 << 20, 3
#: Histories that are taken at once: while training, and while scoring.
STEP, SCORED = 4096, 1024
END = np.uint64(0xE2D0E2D0E2D0E2D1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == HELD_OUT, F.lit(False))


class Tokens:
    """Tokens of texts: each text's words and its end; features of the history of each."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        self.sizes = words.counts + 1
        self.ends = np.cumsum(self.sizes) - 1
        n = int(self.sizes.sum())
        word = np.ones(n, bool)
        word[self.ends] = False
        self.key = np.full(n, END, np.uint64)
        self.key[word] = words.hash
        self.bucket = (self.key >> np.uint64(40)).astype(np.int64) & (WORD_BUCKETS - 1)
        self.tail = np.full(n, -1, np.int64)
        self.tail[word] = (mix(words.tail(3).astype(np.uint64)) >> np.uint64(40)).astype(np.int64) & (TAIL_BUCKETS - 1)
        self.first = self.ends - self.sizes + 1

    def before(self, k: int) -> np.ndarray:
        """The key of the token k before; zero before the text's start."""
        out = np.zeros(len(self.key), np.uint64)
        out[k:] = self.key[: len(self.key) - k] if k < len(self.key) else 0
        for j in range(k):
            at = self.first + j
            out[at[at <= self.ends]] = 0
        return out

    def near(self) -> np.ndarray:
        return (self.before(1) >> np.uint64(50)).astype(np.int64) & (NEAR_BUCKETS - 1)

    def features(self) -> np.ndarray:
        one, two, three = (self.before(k) for k in (1, 2, 3))
        values = (one, two * np.uint64(3) + np.uint64(1), three * np.uint64(5) + np.uint64(2), mix(one) + two)
        return np.stack([(mix(v) >> np.uint64(44)).astype(np.uint16) & np.uint16(ROWS - 1) for v in values])


@dataclass
class Model:
    of_bucket: np.ndarray  # class of a word bucket, -1: by its ending
    of_tail: np.ndarray
    bias: np.ndarray
    weights: np.ndarray  # feature, row, class

    def classes(self, tokens: Tokens) -> np.ndarray:
        out = self.of_bucket[tokens.bucket]
        out = np.where(out < 0, self.of_tail[tokens.tail], out)
        out[tokens.ends] = END_CLASS
        return out

    def _exponentials(self, features: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each history: exp(score of each class - the largest), and their sum. room: two arrays to work in, which the next call overwrites."""
        z, more = np.empty((2, features.shape[1], CLASSES), np.float32) if room is None else room[:, : features.shape[1]]
        np.take(self.weights[0], features[0], axis=0, out=z, mode="clip")
        for f in range(1, FEATURES):
            z += np.take(self.weights[f], features[f], axis=0, out=more, mode="clip")
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z, z.sum(axis=1)

    def probs(self, features: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        z, total = self._exponentials(features, room)
        z /= total[:, None]
        return z

    def log_prob_of(self, features: np.ndarray, kind: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """The natural logarithm of the probability of one class of each history."""
        z, total = self._exponentials(features, room)
        return np.log(np.maximum(z[np.arange(len(z)), kind], 1e-37).astype(np.float64)) - np.log(total.astype(np.float64))


def add_rows(sums: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values (history, class) to the row of each feature's sums (feature, row * class) that rows (feature, history) names; two classes at once, as complex numbers."""
    pairs, two = values.astype(np.float64).view(np.complex128), np.arange(values.shape[1] // 2)
    for own, x in zip(sums.view(np.complex128), rows):
        np.add.at(own, (x.astype(np.int64)[:, None] * len(two) + two).ravel(), pairs.ravel())


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the number of each key's in them: numbered by hash, then only the distinct ones are sorted."""
    coded = pa.array(keys).dictionary_encode()
    found, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order, place, rank = np.argsort(found), np.empty(len(found), np.int64), np.empty(len(found), np.int64)
    place[of], rank[order] = np.arange(len(of)), np.arange(len(order))
    return found[order], place[order], rank[of]


def _sums(docs: DataFrame, of, most: int = 2 << 20, total: int | None = None) -> list[np.ndarray]:
    """The sums over all of docs of the arrays that of(texts) yields; added within a task, then by slices of the arrays, `ADD_PARTS` tasks' at a time until one is left.

    Each task sends arrays of their whole size, so the tasks are as many as the text asks for (`total` bytes, counted where not given), not as the files.
    """
    tasks = max(TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, (text_bytes(docs) if total is None else total) // SUM_BYTES)
    docs = docs.coalesce(tasks)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals: list[np.ndarray] | None = None
        for batch in slices(batches, most=most):
            found = of(raw_texts(batch.column("text")))
            if totals is None:
                totals = found
            else:
                for t, x in zip(totals, found):
                    t += x
        rows = [(k * 4096 + j, B.squeeze(s.astype(np.float32))) for k, t in enumerate(totals or []) for j, s in enumerate(np.array_split(t.ravel(), max(1, t.size >> 17)))]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([TaskContext.get().partitionId() // ADD_PARTS] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["slice", "part", "data"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for data in batch.column("data").to_pylist():
                total = total + B.unsqueeze(data)[0].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py() // ADD_PARTS], pa.int32()), pa.array([B.squeeze(total)], pa.binary())], names=["slice", "part", "data"])

    schema, left = "slice int, part int, data binary", docs._jdf.queryExecution().toRdd().getNumPartitions()
    added = docs.mapInArrow(part, schema)
    while True:
        added, left = added.groupBy("slice", "part").applyInArrow(add, schema), -(-left // ADD_PARTS)
        if left <= 1:
            break
    rows = [(r["slice"], B.unsqueeze(bytes(r["data"]))[0]) for r in added.collect()]  # the arrays' own size
    found: dict[int, list] = {}
    for slice_, data in sorted(rows, key=lambda r: r[0]):
        found.setdefault(slice_ // 4096, []).append(data)
    return [np.concatenate(found[k]) for k in sorted(found)]


def _cluster(rows: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means with cosine likeness; centres start at the heaviest rows, each far from those before."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    centres = [unit[weight.argmax()]]
    far = 1 - unit @ centres[0]
    for _ in range(k - 1):
        centres.append(unit[(np.maximum(far, 0) * np.sqrt(weight)).argmax()])
        far = np.minimum(far, 1 - unit @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        for c in range(k):
            own = of == c
            if own.any() and weight[own].sum() > 0:
                m = (unit[own] * weight[own, None]).sum(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-9)
    return (unit @ centres.T).argmax(axis=1)


def train(docs: DataFrame, updates: int = UPDATES, total: int | None = None) -> Model:
    """docs: the training rows (doc_id, text), of about `total` bytes of text. One pass for the classes, then each update over its share of all rows."""

    def counts(texts: list[bytes]) -> list[np.ndarray]:
        t = Tokens(texts)
        word = t.tail >= 0
        return [np.bincount(t.bucket[word], minlength=WORD_BUCKETS).astype(float), np.bincount((t.tail * NEAR_BUCKETS + t.near())[word], minlength=TAIL_BUCKETS * NEAR_BUCKETS).astype(float), np.array([float(len(texts))])]

    total = text_bytes(docs) if total is None else total
    found = _sums(docs, counts, total=total)
    words, pairs, texts = found if found else (np.zeros(WORD_BUCKETS), np.zeros(TAIL_BUCKETS * NEAR_BUCKETS), np.zeros(1))
    common = np.argsort(-words, kind="stable")[:COMMON]
    common = common[words[common] > 0]
    of_bucket = np.full(WORD_BUCKETS, -1, np.int64)
    of_bucket[common] = np.arange(len(common))
    pairs = pairs.reshape(TAIL_BUCKETS, NEAR_BUCKETS)
    weight = pairs.sum(axis=1)
    expected = weight[:, None] * pairs.sum(axis=0) / max(pairs.sum(), 1)
    of_tail = COMMON + _cluster(np.log((pairs + 1) / (expected + 1)), weight, TAIL_CLASSES)
    model = Model(of_bucket, of_tail, np.zeros(CLASSES, np.float32), np.zeros((FEATURES, ROWS, CLASSES), np.float32))
    mass = np.ones(CLASSES)
    np.add.at(mass, of_tail, weight)
    mass[COMMON:] = np.maximum(mass[COMMON:] - words[common].sum() / TAIL_CLASSES, 1)
    mass[: len(common)] += words[common]
    mass[END_CLASS] += texts[0]
    model.bias = np.log(mass / mass.sum()).astype(np.float32)
    spark = docs.sparkSession
    for step in range(updates):
        sent = spark.sparkContext.broadcast(model)  # of fixed size

        def gradient(texts: list[bytes], sent=sent) -> list[np.ndarray]:
            m, t = sent.value, Tokens(texts)
            features, own = t.features(), m.classes(t)
            wanted = np.zeros((FEATURES, ROWS * CLASSES))
            bias = np.bincount(own, minlength=CLASSES).astype(float)
            seen = np.concatenate([np.bincount(features[f].astype(np.int64) * CLASSES + own, minlength=ROWS * CLASSES) for f in range(FEATURES)]).astype(float)
            room = np.empty((2, STEP, CLASSES), np.float32)
            for k in range(0, len(own), STEP):
                x = features[:, k : k + STEP]
                p = m.probs(x, room)
                bias -= p.sum(axis=0)
                add_rows(wanted, x, p)
            return [seen, wanted.ravel(), bias, np.array([float(len(own))])]

        share = docs.where(F.pmod(F.floor(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) / FOLD), F.lit(updates)) == step)
        found = _sums(share, gradient, total=total // updates)
        if found and found[3][0]:
            seen, wanted, bias, n = found
            step_by = np.log((seen + 1) / (wanted + 1)) if step == 0 else np.clip((seen - wanted) / (wanted + SMOOTH), -1, 1)
            model.weights = model.weights + (RATE * step_by * (seen + wanted > 0)).astype(np.float32).reshape(model.weights.shape)
            model.bias = model.bias + np.clip(bias / (np.exp(model.bias) * n[0] + SMOOTH), -0.5, 0.5).astype(np.float32)
    return model


def score_documents(docs: DataFrame, updates: int = UPDATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    own = documents(docs).withColumn("held_out", held_out())
    spark, total = docs.sparkSession, text_bytes(own)
    model = train(own.where("not held_out").select("doc_id", "text"), updates, total)
    sent, shards, parts = spark.sparkContext.broadcast(model), B.shards_for(total, SHARD_BYTES), B.parts_for(own, total)
    dealt = B.pack(own, parts)

    def tokens_of(table: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of a block, its distinct keys in order, a place of each, and the key of each token."""
        t = Tokens([x for c in table.column("text").chunks for x in raw_texts(c)])
        return t, *distinct(t.key)

    def shard_slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(shard[a]), slice(a, b)

    def send(table: pa.Table, _) -> Iterator[tuple[int, bytes]]:
        t, keys, place, of = tokens_of(table)
        kind = sent.value.classes(t)[place].astype(np.uint8)
        trains = np.repeat(~table.column("held_out").to_numpy(), t.sizes)
        n = np.bincount(of[trains], minlength=len(keys)).astype(np.uint32)
        for shard, part in shard_slices(keys):
            yield shard, B.squeeze(keys[part], n[part], kind[part])

    def add(messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [B.unsqueeze(m) for _, m in messages]
        keys, n, kind = (np.concatenate(c) for c in zip(*parts))
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        totals = np.bincount(of, weights=n).astype(np.int64)
        known = totals > 0
        by_class = np.bincount(kind[first], weights=totals, minlength=CLASSES), np.bincount(kind[first][known], minlength=CLASSES)
        yield -1 - messages[0][0], B.squeeze(by_class[0].astype(np.int64), by_class[1].astype(np.int64))  # a shard's own, dealt with a block of its
        at = 0
        for (block, _), part in zip(messages, parts):
            here = totals[of[at : at + len(part[0])]]
            at += len(part[0])
            yield block, B.squeeze(here.astype(np.uint32 if here.max(initial=0) < 1 << 32 else np.uint64))

    told = durable(B.answers(dealt, send, add, parts))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            for data in batch.column("answer").to_pylist():
                totals += np.array(B.unsqueeze(data))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(totals[0]), pa.array(totals[1])], names=["class", "n", "words"])

    by_class = np.zeros((2, CLASSES), np.int64)
    sums = told.where("block < 0").select("answer").mapInArrow(unfold, "class long, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    for row in sums.collect():  # one row a class
        by_class[:, row["class"]] = row["n"], row["words"]
    answers = B.gather(told.where("block >= 0"), parts)
    of_class, words_of_class = by_class
    n_all, v_all = int(of_class.sum()), int(words_of_class.sum())
    class_total = np.log10(np.where(np.arange(CLASSES) == END_CLASS, np.maximum(of_class + 1, 1), of_class + words_of_class + 1).astype(float))
    base_total = np.log10(float(n_all + v_all + 1))

    def last(table: pa.Table, told: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        t, keys, _, of = tokens_of(table)
        totals = np.zeros(len(keys), np.int64)
        for shard, part in shard_slices(keys):
            totals[part] = B.unsqueeze(told[shard])[0]
        c = totals[of]
        log_c = np.log10(c + 1.0)
        kind, features, within, room = sent.value.classes(t), t.features(), np.empty(len(c)), np.empty((2, SCORED, CLASSES), np.float32)
        for k in range(0, len(c), SCORED):
            within[k : k + SCORED] = sent.value.log_prob_of(features[:, k : k + SCORED], kind[k : k + SCORED], room)
        score = within / np.log(10) + log_c - class_total[kind]
        add_up = lambda x: np.add.reduceat(x, t.first) if len(t.first) else x[:0]
        n = len(t.sizes)
        columns = {"doc_id": table.column("doc_id").combine_chunks(), "held_out": table.column("held_out").combine_chunks(), "n_tokens": pa.array(t.sizes.astype(np.int64)), "n_known": pa.array(add_up((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(n, n_all, np.int64)), "base_score": pa.array(add_up(log_c - base_total)), "score": pa.array(np.minimum(add_up(score), 0.0))}
        yield pa.RecordBatch.from_pydict(columns)

    return B.finish(B.meet(dealt, answers), last, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
