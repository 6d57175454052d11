"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction.

A document is its token ids and an end id; a longer one than a sequence is cut into pieces of
the whole length, of which the first may be shorter. How well pieces pack depends on their
lengths alone, so the instance is the count of each length: at most `capacity` numbers however
many documents there are. On that histogram the reduction fixes, many copies at a time, the
sets that provably dominate every other set with one of the pieces, from the longest to the
shortest and again until no length is left that can be fixed:

* exact partners (together they fill a sequence: nothing dominates that);
* a piece that nothing fits beside, alone;
* the largest fitting partner, where at most one more fits beside it, or where at most two fit
  and no pair of them is longer than that partner;
* the pair of the largest partner and the largest that fits beside both, where at most two fit
  and every other pair is no longer than the partner or has a smaller second.

What is left is packed best-fit decreasing, again by counts: sequences with the same contents
are one pattern. A piece finds its place by its rank among the pieces of its length.

Cases: null text is empty (the end id alone is its piece); null doc_ids stay; repeated rows are
documents of their own; ties in rank are rows that do not differ; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, durable, raw_texts, slices

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together.
RANK_GROUP = 2_000
#: Words whose ids a worker keeps: so many at most, each of so many characters at most (a text without spaces is one word).
CACHED_WORDS, CACHED_LENGTH = 200_000, 64
#: New words that are encoded as one text.
JOINED_WORDS = 64
#: Text whose words are taken together.
TEXT_BYTES = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the instance: counts of lengths -------------------------------------------------


@dataclass
class Plan:
    """Runs of places, sorted by length and first rank: copies `each` a sequence in sequences from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 44) + self.rank, length * (1 << 44) + rank, side="right") - 1
        within = rank - self.rank[at]
        return self.sequence[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that dominate, each with its copies, and the counts that are left."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*sizes: int) -> None:
        need = {s: sizes.count(s) for s in sizes}
        copies = min(left[s] // k for s, k in need.items())
        fixed.append((tuple(sorted(sizes, reverse=True)), copies))
        for s, k in need.items():
            left[s] -= k * copies
            if not left[s]:
                del left[s]

    for s in sorted(left, reverse=True):
        if s in left and s == capacity:
            fix(s)
        elif s in left and capacity - s in left and (2 * s != capacity or left[s] > 1):
            fix(s, capacity - s)

    def dominating(j: int) -> tuple[int, ...] | None:
        """A set with j that dominates every other set with it, if the tests find one."""
        sizes = sorted(left)

        def fits(limit: int, *used: int) -> int:
            """The largest length up to `limit` of which a piece is left beside `used`; 0 if none."""
            k = bisect.bisect_right(sizes, limit) - 1
            while k >= 0 and left[sizes[k]] <= used.count(sizes[k]):
                k -= 1
            return sizes[k] if k >= 0 else 0

        def smallest(k: int) -> int:
            """The sum of the k shortest pieces beside j; more than fits if there are fewer."""
            total = 0
            for s in sizes:
                take = min(k, left[s] - (s == j))
                total, k = total + s * take, k - take
                if not k:
                    return total
            return capacity + 1

        room = capacity - j
        best = fits(room, j)
        if not best:
            return (j,)
        if smallest(2) > room or best == room:
            return j, best
        if smallest(3) <= room:
            return None
        pairs = [(a, b) for a in sizes if a <= room and left[a] > (a == j) for b in [fits(min(a, room - a), j, a)] if b]
        second = fits(room - best, j, best)
        if max(a + b for a, b in pairs) <= best:
            return j, best
        return (j, best, second) if second and all(a + b <= best or b <= second for a, b in pairs) else None

    again = True
    while again:  # what one fix takes away may let another length be fixed
        again = False
        for j in sorted(left, reverse=True):
            while j in left and (found := dominating(j)):
                fix(*found)
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing by counts: patterns ((length, copies), ...) and how many sequences have each."""
    rooms: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    order: list[int] = []

    def add(room: int, pattern: tuple, n: int) -> None:
        if room not in rooms or not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        n, new = counts[s], []
        while n and (k := bisect.bisect_left(order, s)) < len(order):
            room = order[k]
            pattern, bins = rooms[room].pop()
            if not rooms[room]:
                order.pop(k)
            each = room // s
            full = min(bins, n // each)
            if full:
                new.append((room - each * s, (*pattern, (s, each)), full))
                n, bins = n - full * each, bins - full
            if bins and n:
                new.append((room - n * s, (*pattern, (s, n)), 1))
                n, bins = 0, bins - 1
            if bins:
                add(room, pattern, bins)
        each = capacity // s
        if n // each:
            new.append((capacity - each * s, ((s, each),), n // each))
        if n % each:
            new.append((capacity - n % each * s, ((s, n % each),), 1))
        for x in new:
            add(*x)
    return [x for found in rooms.values() for x in found]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, left = reduce_instance(counts, capacity)
    patterns = [(tuple((s, sizes.count(s)) for s in sorted({*sizes}, reverse=True)), n) for sizes, n in fixed] + best_fit(left, capacity)
    runs, ranks, sequence = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for s, each in pattern:
            runs.append((s, ranks[s], each, sequence, offset))
            ranks[s] += each * n
            offset += s * each
        sequence += n
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


# --- documents to pieces ---------------------------------------------------------------


class _Numbers(dict):
    """Words by number, in the order in which they are first asked for; `new` are those without ids yet."""

    def __init__(self):
        self.count, self.new = 0, []

    def __missing__(self, word: str) -> int:
        self[word] = n = self.count
        self.count = n + 1
        self.new.append(word)
        return n


class Words:
    """Token ids of texts by their words; a worker encodes each word once.

    The tokenizer cuts a text before it merges, and always before a space that follows
    something other than white space; so a text without runs of white space that end in a
    space has the ids of its space-parted words. Other texts are encoded whole by `tokenizers`.
    For the same reason many new words are encoded as one text, and the ids that begin with a
    space begin its words; a word that ends in white space (or is empty) is a text of its own.

    The words of many texts lie in one buffer, each with the space before it, and Arrow numbers
    the distinct ones; only those become Python objects. Of the words that are known when there
    are too many, those stay that were met most often.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.begins = np.zeros(self.encoder.get_vocab_size(), bool)
        self.begins[[k for token, k in self.encoder.get_vocab().items() if token[:1] == "\u0120"]] = True  # a space of byte-level tokens
        self._keep(_Numbers())

    def _keep(self, known: _Numbers) -> None:
        """The known words; their ids in one pool, where each word's begin and how many they are, whether it ends in white space (or is empty), how often it was met."""
        self.known, self.pool, self.start, self.size, self.white, self.met = known, array("I"), array("q"), array("q"), array("b"), array("i")

    def _thin(self) -> None:
        """Keeps half as many words as a worker may know, of those that were met more than once the ones most often met."""
        pool, start, size, white, met = np.frombuffer(self.pool, np.uint32), *(np.frombuffer(x, x.typecode) for x in (self.start, self.size, self.white, self.met))
        words, numbers = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        seen = met[numbers]
        stay = np.sort(np.argsort(-seen, kind="stable")[: min(CACHED_WORDS // 2, int((seen > 1).sum()))])
        old, known = numbers[stay], _Numbers()
        known.update((words[k], n) for n, k in enumerate(stay.tolist()))
        known.count = len(old)
        self._keep(known)
        self.pool.frombytes(_runs(pool, start[old], size[old]).tobytes())
        for kept, values in ((self.start, np.cumsum(size[old]) - size[old]), (self.size, size[old]), (self.white, white[old]), (self.met, met[old] // 2)):
            kept.frombytes(values.tobytes())

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Puts the ids of the new words into the pool, those of long ones last."""
        white = np.array([not w or w[-1].isspace() for w in new], np.int8)
        kind = np.where([len(w) > CACHED_LENGTH for w in new], 2, white)
        order = np.argsort(kind, kind="stable")
        joined = int((kind == 0).sum())
        plain, alone = [new[k] for k in order[:joined].tolist()], [new[k] for k in order[joined:].tolist()]
        found = self._encode([" " + " ".join(plain[k : k + JOINED_WORDS]) for k in range(0, joined, JOINED_WORDS)])
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        first = np.flatnonzero(self.begins[ids])
        if len(first) != joined:
            raise ValueError("the tokenizer does not cut at each space")
        others = self._encode([f" {w}" for w in alone])
        size = np.empty(len(new), np.int64)
        size[order] = np.concatenate([np.diff(np.append(first, len(ids))), np.array([len(x) for x in others], np.int64)])
        start = np.empty(len(new), np.int64)
        start[order] = np.cumsum(size[order]) - size[order] + len(self.pool)
        self.pool.frombytes(np.concatenate([ids, *others]).tobytes())
        for kept, values in ((self.start, start), (self.size, size), (self.white, white), (self.met, np.zeros(len(new), np.int32))):
            kept.frombytes(values.tobytes())

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.ids_of([t.encode() for t in texts])

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, little-endian unsigned 32-bit."""
        if self.known.count > CACHED_WORDS:
            self._thin()
        plain = [b"" if t[:1] == b" " or b"  " in t or b"\n " in t else t for t in texts]  # most texts with runs are known at once
        distinct, of, counts = _split(plain)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        new, self.known.new = self.known.new, []
        if new:
            self._learn(new)
        np.frombuffer(self.met, np.int32)[number] += 1
        white = np.frombuffer(self.white, np.int8)[number][of]
        last = np.cumsum(counts)
        white[last[counts > 0] - 1] = 0  # no space follows
        runs = {*np.searchsorted(last, np.flatnonzero(white), side="right").tolist()}
        heads = [(p[: p.find(b" ")] if n else t).decode() for t, p, n in zip(texts, plain, counts.tolist())]
        for k, head in enumerate(heads):
            if counts[k] and (k in runs or head[-1].isspace()):
                runs.add(k)
                heads[k] = texts[k].decode()
        start, size = np.frombuffer(self.start, np.int64)[number][of], np.frombuffer(self.size, np.int64)[number][of]
        flat = _runs(np.frombuffer(self.pool, np.uint32), start, size).tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], last])]).tolist()
        if long := [w for w in new if len(w) > CACHED_LENGTH]:
            del self.pool[min(self.start[self.known.pop(w)] for w in long) :]
        return [head.tobytes() + (b"" if k in runs else flat[cuts[k] : cuts[k + 1]]) for k, head in enumerate(self._encode(heads))]


def _runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of each run one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(size.sum())]


def _split(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words that follow a space, the place of each text's words in them, and how many each text has; no text begins with a space."""
    data = b"".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    space, first = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20), np.cumsum(size) - size
    at = np.searchsorted(space, first)
    heads = at + np.arange(len(texts))
    word = np.ones(len(space) + len(texts), bool)
    word[heads] = False
    offsets = np.append(np.insert(space, at, first), len(data))
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word), [pa.py_buffer(np.packbits(word, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(data)])
    found = parts.dictionary_encode()
    held, n = found.dictionary.buffers(), len(found.dictionary)
    begin, end = np.frombuffer(held[1], np.int64, n + 1, found.dictionary.offset * 8)[[0, -1]].tolist() if n else (0, 0)
    distinct = held[2][begin:end].to_pybytes()[1:].decode().split(" ") if n else []
    of = np.frombuffer(found.indices.buffers()[1], np.int32, len(word), found.indices.offset * 4)[word]
    return distinct, of, np.diff(np.append(at, len(space)))


@cache
def _worker_words(path: str) -> Words:
    """One for each Python worker: tasks that follow find the words of earlier ones."""
    return Words(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False):
    """A mapInArrow function: (doc_id, text) to pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(path)
        for batch in slices(batches, most=TEXT_BYTES):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], **({"ids": []} if with_ids else {})}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.ids_of(raw_texts(batch.column("text")))):
                ids, n = memoryview(ids + end), len(ids) // 4 + 1
                start, k = 0, 0
                while start < n:
                    length = (n - 1) % capacity + 1 if not k else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(out, (doc, k, start, length, zlib.crc32(part))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                    start, k = start + length, k + 1
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in out.items()})

    return pieces


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (durable, with doc_id, piece, start, length, ids_crc32) with their sequence_id and offset.

    A row's own number deals it to a group of its length, so no doc_id, null or repeated, fills one.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row a length
    plan = make_plan(counts, capacity)
    groups = max([1, *(-(-n // RANK_GROUP) for n in counts.values())])
    own = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    sizes = own.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_group", (F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_group").orderBy("_row"))
    ranked = own.withColumn("_within", within).join(before, ["length", "_group"]).withColumn("_rank", F.col("_within") - 1 + F.col("_before"))
    names = pieces.columns
    sent = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.places(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(durable(documents(docs).mapInArrow(tokenize(tokenizer or default_tokenizer(), capacity, end_id), PIECES)), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the pieces in their order (each at most `capacity` ids)."""
    pieces = durable(documents(docs).mapInArrow(tokenize(tokenizer or default_tokenizer(), capacity, end_id, with_ids=True), PIECES + ", ids array<int>"))
    found = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return pack_pieces(pieces, capacity).groupBy("sequence_id").agg(found.alias("_p")).select(
        "sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"), F.transform("_p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces")
    )
