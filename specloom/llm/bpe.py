"""Byte-level BPE: texts to token ids by batched merge rounds in numpy, and ids back to texts.

A text is cut at its special tokens, then at spaces after something other than white space (the
pre-tokenizer always cuts there), and each distinct part into the pre-tokenizer's words. The new
words of a batch are merged together: their symbols lie in one flat array, and the rank of a pair
of neighbours is found by binary search over the sorted keys of all pairs.

* Words up to `SHORT` bytes: in a round every word merges all its pairs of its own lowest rank.
* Longer words: in a round the lowest rank of all words is merged wherever it stands, in linked
  lists, so a word of megabytes costs its merges and not its length times its rounds.

A merged pair only makes pairs of higher rank (a vocabulary lists the parts of a symbol before it;
`Vocabulary` checks that), so merging all of a rank at once, from the left where they overlap,
gives what one merge at a time gives.

Cases: null text is empty (no tokens); null and repeated doc_ids stay, each row by itself; other
columns are ignored; an empty table gives no rows; a text is held whole by the task that reads it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, raw_texts, slices

#: Words of more bytes are merged rank by rank, not word by word.
SHORT = 64
#: Bytes of words in one flat array, unless one word has more.
FLAT_BYTES = 1 << 20
#: Text encoded at once.
TEXT_BYTES = 2 << 20
#: What a worker keeps: parts of texts up to KEPT_LENGTH characters, two generations of KEPT parts.
KEPT, KEPT_LENGTH = 150_000, 64
NO_RANK = np.iinfo(np.int64).max
#: A symbol that is in no pair; it parts words in a flat array.
WALL = (1 << 21) - 1

# Fixed value: the pre-tokenizer's pattern.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file: symbols of bytes, sorted pair keys with rank and result, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        if model["type"] != "BPE" or whole["normalizer"] or (whole["pre_tokenizer"] or {}).get("type") != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take more than their own text")
        letters, vocab = byte_letters(), model["vocab"]
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[f(a, b)] for a, b in pairs], np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        rank = np.arange(len(pairs), dtype=np.int64)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made[::-1]] = rank[::-1]
        if (np.maximum(born[left], born[right]) >= rank).any():
            raise ValueError(f"{path} uses a symbol before the pair that makes it")
        key = left << 21 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], rank[order], made
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, k in vocab.items():
            tokens[k] = bytes(map(byte_of.__getitem__, token))
        for token, k in self.special.items():
            tokens[k] = token.encode()
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `NO_RANK` if it is none, by binary search."""
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of ids; what isn't UTF-8 becomes U+FFFD."""
        ids = ids.astype(np.int64)
        size = self.length[ids]
        shift = self.start[ids] - (np.cumsum(size) - size)
        raw = self.bytes[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()
        return raw.decode("utf-8", "replace").encode()


def _first_of_overlaps(follows: np.ndarray) -> np.ndarray:
    """Of hits in order, every other one of each chain; follows[k]: hit k overlaps the one before."""
    k = np.arange(len(follows))
    return (k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0


def merge_short(v: Vocabulary, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that lie one after the other in `data`, and how many each has; each round merges the lowest rank of every word."""
    symbol = v.of_byte[np.frombuffer(data, np.uint8)]
    word = np.repeat(np.arange(len(size)), size)
    done_words, done_symbols = [word[:0]], [symbol[:0]]

    def pair_ranks(at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbol) - 1)
        return np.where((word[at] == word[after]) & (after > at), v.ranks(symbol[at], symbol[after]), NO_RANK)

    rank = pair_ranks(np.arange(len(symbol)))
    while len(symbol):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        lengths = np.diff(np.append(starts, len(symbol)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        open_ = lowest < NO_RANK
        if not open_.all():
            done_words.append(word[~open_])
            done_symbols.append(symbol[~open_])
            symbol, word, rank, lowest = symbol[open_], word[open_], rank[open_], lowest[open_]
        hit = np.flatnonzero(rank == lowest)
        hit = hit[_first_of_overlaps(np.diff(hit, prepend=-2) == 1)]
        symbol[hit] = v.made[rank[hit]]
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        symbol, word, rank = symbol[keep], word[keep], rank[keep]
        hit -= np.arange(len(hit))
        touched = np.zeros(len(symbol), bool)
        touched[hit] = True
        touched[np.maximum(hit - 1, 0)] = True
        anew = np.flatnonzero(touched)
        rank[anew] = pair_ranks(anew)
    words = np.concatenate(done_words)
    return np.concatenate(done_symbols)[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(size))


def merge_long(v: Vocabulary, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `merge_short`; each round merges the lowest rank that is left anywhere."""
    wall = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(wall[-1]) + 1, WALL, np.int64)
    flat[np.delete(np.arange(len(flat)), wall)] = v.of_byte[np.frombuffer(data, np.uint8)]
    n = len(flat)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[-1] = n - 1
    rank = np.full(n, NO_RANK, np.int64)
    found: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def look(at: np.ndarray) -> None:
        rank[at] = v.ranks(flat[at], flat[after[at]])
        at = at[rank[at] < NO_RANK]
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts) if len(at) else ():
            r = int(rank[part[0]])
            if r not in found:
                heapq.heappush(heap, r)
            found[r].append(part)

    look(np.arange(1, n - 1))
    while heap:
        r = heapq.heappop(heap)
        hit = np.unique(np.concatenate(found.pop(r)))
        hit = hit[rank[hit] == r]
        if not len(hit):
            continue
        hit = hit[_first_of_overlaps(np.append(False, after[hit[:-1]] == hit[1:]))]
        gone = after[hit]
        then = after[gone]
        flat[hit], flat[gone], rank[gone] = v.made[r], WALL, NO_RANK
        after[hit], before[then] = then, hit
        look(np.unique(np.concatenate([hit, before[hit][before[hit] > 0]])))
    left = flat != WALL
    return flat[left], np.diff(np.cumsum(left)[wall])


def encode_words(v: Vocabulary, data: bytes, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids (little-endian unsigned 32-bit) of words that lie one after the other in `data`, and how many ids each has."""
    ends, ids, counts = np.cumsum(size), [], []
    long = size > SHORT
    first = 0
    while first < len(size):  # stretches of words of one kind
        kind = bool(long[first])
        turn = int(np.argmax(long[first:] != kind)) or len(size) - first
        begun = int(ends[first] - size[first])
        last = max(first + 1, min(first + turn, int(np.searchsorted(ends, begun + FLAT_BYTES, side="right"))))
        found, n = (merge_long if kind else merge_short)(v, data[begun : int(ends[last - 1])], size[first:last])
        ids.append(found.astype("<u4").tobytes())
        counts.append(n)
        first = last
    return b"".join(ids), np.concatenate(counts) if counts else np.zeros(0, np.int64)


WHITE_BEFORE_SPACE = [f"{w} " for w in " \t\n\v\f\r"]


class Encoder:
    """Encodes batches of texts; keeps the ids of short parts that it has met, within bounds."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.word = regex.compile(WORD)
        self.cut = regex.compile(r"(?<=\S) ")
        self.runs = regex.compile(r"(?:\s|^) ")
        self.special = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.vocabulary.special, key=len, reverse=True))) if self.vocabulary.special else None
        self.far = regex.compile("[^\u0000-՗]")
        self.young: dict = {}
        self.old: dict = {}
        self.path, self.library = path, None

    def words(self, part: str) -> list[str]:
        """The pre-tokenizer's words; parts with characters that this Python's Unicode doesn't have are cut by the library, which may know others than `regex`."""
        if self.far.search(part) and any(unicodedata.category(c) == "Cn" for c in part):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        return self.word.findall(part)

    def parts(self, text: str) -> list:
        """A text cut at its spaces, but for spaces that follow white space: a tuple of what is before the first, then what follows each."""
        apart = self.runs.search(text) if not text.isascii() else text[:1] == " " or any(w in text for w in WHITE_BEFORE_SPACE)
        cut = self.cut.split(text) if apart else text.split(" ")
        return [(cut[0],), *cut[1:]]

    def _meet(self, parts: set) -> list:
        """Afterwards `young` has the ids of all these parts; returns those that it is not to keep."""
        new = []
        for p in parts.difference(self.young):
            ids = self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                self.young[p] = ids
        # parts that follow a space and end with something else are cut in one go, as each begins a word; long ones go last, so stretches of short words are long
        joined = [p for p in new if p and p.__class__ is str and len(p) < SHORT // 4 and not p[-1].isspace()]
        rest = set(new).difference(joined)
        new = [*joined, *rest]
        texts = [f" {p}" for p in joined] + [p[0] if isinstance(p, tuple) else f" {p}" for p in rest]
        data = "".join(texts)
        lengths = (lambda x: list(map(len, x))) if data.isascii() else (lambda x: [len(y.encode()) for y in x])
        words = [*self.words("".join(texts[: len(joined)])), *(w for t in texts[len(joined) :] for w in self.words(t))]
        size = np.array(lengths(words), np.int64)
        ids, counts = encode_words(self.vocabulary, data.encode(), size)
        place = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(np.cumsum(size), np.cumsum(lengths(texts)), side="right")]
        bounds = [0, *(4 * place).tolist()]
        self.young.update((p, ids[a:b]) for p, a, b in zip(new, bounds, bounds[1:]))
        return [p for p, t in zip(new, texts) if len(t) > KEPT_LENGTH]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        plan: list[list] = []  # of each text: a list of parts for a stretch of text, a number for a special token
        for text in texts:
            own, at = [], 0
            for m in self.special.finditer(text) if self.special else ():
                own += [self.parts(text[at : m.start()]), self.vocabulary.special[m.group()]]
                at = m.end()
            plan.append([*own, self.parts(text[at:] if at else text)])
        passing = self._meet(set().union(*(x for own in plan for x in own if not isinstance(x, int))))
        known = self.young
        out = [b"".join([b"".join(map(known.__getitem__, x)) if not isinstance(x, int) else x.to_bytes(4, "little") for x in own]) for own in plan]
        for p in passing:
            del known[p]
        if len(known) > KEPT:
            self.young, self.old = {}, known
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4"))


@cache
def worker_encoder(path: str) -> Encoder:
    """One for each Python worker: tasks that follow find the parts of earlier ones."""
    return Encoder(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit numbers)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in slices(batches, most=TEXT_BYTES):
            ids = encoder.encode([x.decode() for x in raw_texts(batch.column("text"))])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return documents(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, text of the ids; null ids are an empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in slices(batches, "ids"):
            texts = [encoder.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.coalesce("ids", F.lit(b""))
    return decoded.select(
        "doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
