"""Suffix-array dedup: strings of `LENGTH` bytes that start in an earlier document are removed.

Sorting every suffix of the corpus is neither needed nor affordable: a suffix matters only where
its first `LENGTH` bytes occur twice. Anchors find those places without loss: in every window of
`LENGTH` bytes the gram (half as long) of the least hash is its anchor, so equal windows have equal
anchors at equal places. Blocks of documents ask two questions of the corpus (see blocks):

1. which of my anchor grams occur in another block? (eight bytes an anchor)
2. for anchors that do, or that occur in two of my own documents: which of their windows start in
   a document with a smaller doc_id? Each distinct context of an anchor is sent once a block, with
   its smallest doc_id.

The second is answered by sorting the windows, suffixes of the contexts, deep-shallow: multikey
quicksort down to a shallow depth, whose characters are words of eight bytes (each group is parted
three ways by its pivot, all groups at once; the middle part goes a word deeper); groups that are
still together there have long common prefixes and are ordered by blind tries. Equal contexts are
merged by their bytes before, so the sort sees each once. Neighbours in that order with all bytes
in common are one string, whose smallest document keeps it. Contexts are compared byte by byte;
hashes only bring candidates together.

A gram with more than `HOT` occurrences (counted in full) sends its windows one by one, dealt out by the window's
own hash and merged by block, so no common passage gathers in one task.

Cases: null texts are empty; texts shorter than `LENGTH` bytes keep all their bytes; null doc_ids
come after all others and are no duplicates of each other; rows with one doc_id don't remove from
each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import documents, raw_texts, text_bytes

LENGTH = 50
SHALLOW = 32
HOT = 100_000
SHARD_BYTES = 6 << 20
SCAN_BYTES = 1 << 18
#: Contexts that are gathered, compared and hashed at once, and windows that are sorted at once (those of one key at least).
ROWS, SORT_ROWS = 1 << 12, 1 << 18
_LAST = np.iinfo(np.int64).max
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x ^= x >> np.uint64(29)
    return x * _ODD[1]


@cache
def _byte_hashes() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[2])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place, put together from hashes of powers of two."""
    power, size, whole, done = _byte_hashes()[data], 1, None, 0
    n = len(data) - k + 1
    while True:
        if k & size:
            whole = power[:n] if whole is None else _join(whole[:n], power[done : done + n])
            done += size
        size *= 2
        if size > k:
            return whole
        power = _join(power[: len(power) - size // 2], power[size // 2 :])


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _ODD[0] + b
    out ^= out >> np.uint64(31)
    out *= _ODD[1]
    return out


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place of the window from each place, and each place's gram hash."""
    k = length // 2 - 1
    h = gram_hashes(data, k)
    places = np.arange(len(h), dtype=np.uint64)
    least, size, width = (h & ~np.uint64(0xFFFFFF)) | places, 1, length - k + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64), h


def documents_at(ends: np.ndarray, at: int, n: int) -> np.ndarray:
    """Of the n bytes from `at`: how many documents end at or before each."""
    before, upto = np.searchsorted(ends, [at, at + n - 1], side="right").tolist()
    return before + np.cumsum(np.bincount(ends[before:upto] - at, minlength=n))


class Anchored:
    """A block's texts in one buffer, and its anchors: place, the first and last window that has it, key, document."""

    def __init__(self, table: pa.Table, length: int):
        texts = [t for chunk in table.column("text").chunks for t in raw_texts(chunk)]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if texts else self.ends
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for at in range(0, max(0, len(self.data) - length + 1), SCAN_BYTES):
            data = self.data[at : at + SCAN_BYTES + length - 1]
            where, h = window_anchors(data, length)
            first = np.arange(len(where))
            doc = documents_at(self.ends, at, len(where))
            inside = at + first + length <= self.ends[doc]
            where, first, doc = where[inside], first[inside], doc[inside]
            new = np.flatnonzero(np.diff(where, prepend=-1) | np.diff(doc, prepend=-1))
            last = np.append(new[1:], len(where)) - 1
            if len(new):
                parts.append((at + where[new], at + first[new], at + first[last], _mix(h[where[new]]), doc[new]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        self.place, self.first, self.last, self.key, self.doc = columns

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, how many documents have each, and how many anchors."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        new_key = np.diff(key, prepend=~key[:1]) != 0
        new = new_key | (np.diff(doc, prepend=-1) != 0)
        at = np.flatnonzero(new_key)
        return key[at], np.add.reduceat(new.astype(np.int64), at) if len(at) else at, np.diff(np.append(at, len(key))).astype(np.uint32)


def split(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: ordered keys have ordered shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    shard = split(keys, shards)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(shard[a]), slice(a, b)


# --- contexts ----------------------------------------------------------------------------


class Contexts:
    """A block's distinct contexts of the anchors that matter, in the order of their keys.

    A context is the bytes of all windows of an anchor. `of` is each such anchor's context,
    `doc_id` the smallest document of a context; `cover` says by windows what is found elsewhere.
    """

    def __init__(self, block: Anchored, told: dict[int, bytes], length: int):
        self.block, self.length = block, length
        answers = [B.unsqueeze(a) for _, a in sorted(told.items())]
        known = np.concatenate([a[0] for a in answers]) if answers else np.zeros(0, np.uint64)
        hot = np.concatenate([a[1] for a in answers]) if answers else np.zeros(0, np.uint8)
        keys, n, _ = block.keys()
        wanted = np.union1d(keys[n > 1], known)
        at = np.searchsorted(wanted, block.key)
        self.anchors = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == block.key)) if len(wanted) else np.zeros(0, np.int64)
        a = self.anchors
        first, size, left = block.first[a], block.last[a] - block.first[a] + length, block.place[a] - block.first[a]
        width = 2 * length
        rows = np.zeros((len(a), width + 2), np.uint8)
        step, within = ROWS, np.arange(width)
        strings = sliding_window_view(np.concatenate([block.data, np.zeros(width, np.uint8)]), width)
        for k in range(0, len(a), step):
            np.multiply(strings[first[k : k + step]], within < size[k : k + step, None], out=rows[k : k + step, :width])
        rows[:, width], rows[:, width + 1] = size, left
        order = np.lexsort((block.ids[block.doc[a]], row_hashes(rows), block.key[a]))
        new = ~repeated(rows, block.key[a], order)
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(new) - 1
        head = order[new]
        self.rows, self.key, self.doc_id = rows[head], block.key[a][head], block.ids[block.doc[a]][head]
        at = np.searchsorted(known, self.key)
        self.hot = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == self.key) & (hot[np.minimum(at, len(known) - 1)] > 0) if len(known) else np.zeros(len(head), bool)

    def messages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is sent: contexts, or single windows where the gram is hot: rows, keys (in order), doc_ids; and of each the context and window it came from."""
        cold, hot = np.flatnonzero(~self.hot), np.flatnonzero(self.hot)
        of, window, strings = windows_of(self.rows[hot], self.length)
        rows = np.zeros((len(of), self.rows.shape[1]), np.uint8)
        rows[:, : self.length] = strings
        rows[:, -2] = self.length
        hashes, ids = _mix(row_hashes(rows)), self.doc_id[hot][of]
        order = np.lexsort((ids, hashes))
        rows, hashes, ids, of, window = rows[order], hashes[order], ids[order], hot[of[order]], window[order]
        all_keys = np.concatenate([self.key[cold], hashes])
        order = np.argsort(all_keys, kind="stable")
        pick = lambda x, y: np.concatenate([x, y])[order]
        return pick(self.rows[cold], rows), all_keys[order], pick(self.doc_id[cold], ids), pick(cold, of), pick(np.full(len(cold), -1), window)

    def covered(self, told: dict[int, bytes], shards: int) -> np.ndarray:
        """Bytes of the buffer that are removed."""
        block, a = self.block, self.anchors
        _, keys, _, of, window = self.messages()
        masks = np.zeros(len(self.key), np.uint64)
        for shard, part in _by_shard(keys, shards):
            if shard in told:
                (mask,) = B.unsqueeze(told[shard])
                whole = window[part] < 0
                masks[of[part][whole]] |= mask[whole]
                single = ~whole & (mask > 0)
                np.bitwise_or.at(masks, of[part][single], np.uint64(1) << window[part][single].astype(np.uint64))
        later = block.ids[block.doc[a]] > self.doc_id[self.of]
        marks = np.zeros(len(block.data) + 1, np.int32)  # sums are of windows over one byte
        full = a[later]
        np.add.at(marks, block.first[full], 1)
        np.add.at(marks, np.minimum(block.last[full] + self.length, len(block.data)), -1)
        rest, mask = a[~later], masks[self.of[~later]]
        rest, mask = rest[mask > 0], mask[mask > 0]
        for w in range(self.length):
            at = block.place[rest] - w
            hit = at[(mask >> np.uint64(w) & np.uint64(1) > 0) & (at >= block.first[rest]) & (at <= block.last[rest])]
            np.add.at(marks, hit, 1)
            np.add.at(marks, np.minimum(hit + self.length, len(block.data)), -1)
        np.cumsum(marks, out=marks)
        return marks[:-1] > 0


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    n, width = rows.shape
    out = np.zeros(n, np.uint64)
    for k in range(0, n, ROWS):
        own = out[k : k + ROWS]
        whole = np.zeros((len(own), -(-width // 8) * 8), np.uint8)
        whole[:, :width] = rows[k : k + ROWS]
        for column in whole.view(np.uint64).T:
            own[:] = _join(own, column)
    return out


def repeated(rows: np.ndarray, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """In an order, which rows equal the one before in bytes and key."""
    out = np.zeros(len(order), bool)
    for k in range(0, len(order), ROWS):
        own = order[max(0, k - 1) : k + ROWS]
        out[max(1, k) : k + ROWS] = (rows[own[1:]] == rows[own[:-1]]).all(axis=1) & (keys[own[1:]] == keys[own[:-1]])
    return out


def windows_of(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of contexts: row, bytes from the window's start to the anchor, and its string."""
    size, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    n = size - length + 1
    of = np.repeat(np.arange(len(rows)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(of):
        return of, start, np.empty((0, length), np.uint8)
    strings = sliding_window_view(np.ascontiguousarray(rows).ravel(), length)[of * rows.shape[1] + start]
    return of, left[of] - start, strings


# --- sorting -------------------------------------------------------------------------------


class BlindTrie:
    """Orders strings of one length. Inner nodes know only the depth at which they branch; a string
    goes down blindly by its bytes there, is compared with the leaf it comes to, and joins the path
    where that comparison says."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.top: list = [None, [0]] if strings else [None, []]
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        own, node, path = self.strings[k], self.top, []
        while node[0] is not None:
            path.append(node)
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if own == other:
            node[1].append(k)
            return
        depth = next(i for i, (x, y) in enumerate(zip(own, other)) if x != y)
        at = next((p for p in path if p[0] >= depth), node)
        if at[0] == depth:
            at[1][own[depth]] = [None, [k]]
        else:
            at[:] = [depth, {other[depth]: list(at), own[depth]: [None, [k]]}]

    def order(self) -> Iterator[list[int]]:
        """Groups of equal strings, in order."""
        stack = [self.top]
        while stack:
            depth, under = stack.pop()
            if depth is None:
                yield under
            else:
                stack += [under[b] for b in sorted(under, reverse=True)]


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words by (group, words), and in that order which rows differ from the one before.

    Every group of rows that are still together is parted by its pivot (the median of its first,
    middle and last row's word at its depth) into less, equal and greater; the equal go a word
    deeper. All groups take a step at once, each as a few passes over the rows that are left.
    """
    n, most = words.shape
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.diff(group[order], prepend=-1) != 0)
    new = np.zeros(n + 1, bool)
    new[start], new[n] = True, True
    size, depth = np.diff(np.append(start, n)), np.zeros(len(start), np.int64)
    while True:
        open_ = (size > 1) & (depth < most)
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order, new[:n]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first - start, size)  # places of the rows that are left, group by group
        rows = order[at]
        word = words[rows, np.repeat(depth, size)]
        pivot = np.sort(np.stack([word[first], word[first + size // 2], word[first + size - 1]]), axis=0)[1]
        bound = np.repeat(pivot, size)
        less, equal = word < bound, word == bound
        n_less, n_equal = np.add.reduceat(less.astype(np.int64), first), np.add.reduceat(equal.astype(np.int64), first)
        place = np.empty(len(rows), np.int64)
        for part, begin in ((less, start), (equal, start + n_less), (~(less | equal), start + n_less + n_equal)):
            rank = np.cumsum(part) - part
            place[part] = (np.repeat(begin - rank[first], size) + rank)[part]
        order[place] = rows
        parts = np.stack([n_less, n_equal, size - n_less - n_equal], axis=1)
        begins = np.stack([start, start + n_less, start + n_less + n_equal], axis=1)
        depths = np.stack([depth, depth + 1, depth], axis=1)
        filled = parts.ravel() > 0
        start, size, depth = begins.ravel()[filled], parts.ravel()[filled], depths.ravel()[filled]
        new[start] = True


def deep_shallow(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes by (group, bytes), and in that order which rows differ from the one before."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8")
    depth = min(-(-shallow // 8), words.shape[1])
    order, new = multikey_quicksort(words[:, :depth].astype(np.uint64), group)
    if depth * 8 >= width:
        return order, new
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    several = np.flatnonzero(ends - starts > 1)
    rest = np.ascontiguousarray(words[:, depth:])
    differs = np.zeros(n, bool)
    differs[1:] = (rest[order[1:]] != rest[order[:-1]]).any(axis=1)
    differs[starts] = False
    deep = several[np.add.reduceat(differs, starts)[several] > 0] if len(several) else several
    tails = strings[:, depth * 8 :]
    for a, b in zip(starts[deep].tolist(), ends[deep].tolist()):
        own = order[a:b].copy()
        at = a
        for equal in BlindTrie([t.tobytes() for t in tails[own]]).order():
            order[at : at + len(equal)] = own[equal]
            new[at] = True
            at += len(equal)
    return order, new


def earlier_windows(rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each context, the windows (bits, by bytes to the anchor) that a context of the same key with a smaller doc_id has too."""
    order = np.lexsort((ids, row_hashes(rows), keys))
    new = ~repeated(rows, keys, order)
    keys, names, ids = keys[order], *np.unique(ids[order], return_inverse=True)
    head, of, ids = np.flatnonzero(new), np.cumsum(new) - 1, ids.astype(np.int32)  # doc_ids by their rank
    rows = rows[order[head]]
    kind = np.cumsum(np.diff(keys[head], prepend=keys[head][:1]) != 0)  # keys are in order
    alone = np.bincount(kind)[kind] == 1
    least = np.full((len(head), length), len(names), np.int32)
    size, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    window = np.arange(length)
    for k in range(0, len(head), ROWS):
        part = slice(k, k + ROWS)
        np.copyto(least[part], ids[head[part], None], where=(window <= left[part, None]) & (window >= (left - (size - length))[part, None]))
    crowded = np.flatnonzero(~alone)
    number = np.unique(keys[head[crowded]], return_inverse=True)[1]
    cuts = [0]
    for k in np.flatnonzero(np.diff(number)) + 1:
        if (k - cuts[-1]) * (length - length // 2 + 2) > SORT_ROWS:
            cuts.append(int(k))
    for a, b in zip(cuts, [*cuts[1:], len(crowded)]):
        row, w, strings = windows_of(rows[crowded[a:b]], length)
        if not len(row):
            continue
        by, new = deep_shallow(strings, number[a:b][row] * length + w)
        string = np.cumsum(new) - 1
        first = np.minimum.reduceat(ids[head[crowded[a:b]]][row][by], np.flatnonzero(new))
        least[crowded[a:b][row[by]], w[by]] = first[string]
    masks = np.zeros(len(of), np.uint64)
    for k in range(0, len(of), ROWS):
        earlier = np.zeros((len(of[k : k + ROWS]), 64), bool)
        np.less(least[of[k : k + ROWS]], ids[k : k + ROWS, None], out=earlier[:, :length])
        masks[k : k + ROWS] = np.packbits(earlier, axis=1, bitorder="little").view("<u8").ravel()
    out = np.empty(len(of), np.uint64)
    out[order] = masks
    return out


# --- the operator ------------------------------------------------------------------------


def _found(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    if not 16 <= length <= 64:
        raise ValueError("lengths from 16 to 64 bytes are laid out for")
    total = text_bytes(docs)
    shards, hot = B.shards_for(total, SHARD_BYTES), HOT
    parts = B.parts_for(docs, total)
    dealt = B.pack(docs, parts)

    def send_keys(table: pa.Table, _) -> Iterator[tuple[int, bytes]]:
        keys, _, n = Anchored(table, length).keys()
        for shard, part in _by_shard(keys, shards):
            yield shard, B.squeeze(keys[part], n[part])

    def shared_keys(messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        each, counts = zip(*(B.unsqueeze(m) for _, m in messages))
        keys, counts = np.concatenate(each), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]) != 0)
        size = np.diff(np.append(new, len(keys)))
        total = np.add.reduceat(counts[order].astype(np.int64), new)
        shared, often = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8)
        shared[order] = np.repeat(size > 1, size)
        often[order] = np.repeat(total > hot, size)
        at = 0
        for (block, _), own in zip(messages, each):
            part = slice(at, at + len(own))
            at += len(own)
            if shared[part].any():
                yield block, B.squeeze(own[shared[part]], often[part][shared[part]])

    def send_contexts(table: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        rows, keys, ids, _, _ = Contexts(Anchored(table, length), told, length).messages()
        for shard, part in _by_shard(keys, shards):
            own = rows[part]
            size = own[:, -2]
            bytes_ = own[:, :-2][np.arange(own.shape[1] - 2) < size[:, None]]
            yield shard, B.squeeze(keys[part], ids[part], size, own[:, -1], bytes_)

    def compare(messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [B.unsqueeze(m) for _, m in messages]
        keys, ids, size, left, bytes_ = (np.concatenate(c) for c in zip(*parts))
        rows = np.zeros((len(keys), 2 * length + 2), np.uint8)
        rows[:, :-2][np.arange(2 * length) < size[:, None]] = bytes_
        rows[:, -2], rows[:, -1] = size, left
        masks = earlier_windows(rows, keys, ids, length)
        at = 0
        for (block, _), part in zip(messages, parts):
            own = masks[at : at + len(part[0])]
            at += len(own)
            if own.any():
                yield block, B.squeeze(own)

    first = B.ask(dealt, send_keys, shared_keys, parts)
    met = B.meet(dealt, first)
    second = B.ask(met, send_contexts, compare, parts).withColumnRenamed("answers", "masks")
    both = met.join(second, "block", "left")
    return both.select("block", "payload", F.concat(F.transform(F.coalesce("answers", F.array().cast(_ANSWERS)), lambda x: F.struct(x["shard"].alias("shard"), x["answer"].alias("answer"))), F.transform(F.coalesce("masks", F.array().cast(_ANSWERS)), lambda x: F.struct((-1 - x["shard"]).alias("shard"), x["answer"].alias("answer")))).alias("answers")), shards


_ANSWERS = "array<struct<shard:long,answer:binary>>"


def _removed(table: pa.Table, told: dict[int, bytes], length: int, shards: int) -> tuple[Anchored, np.ndarray]:
    block = Anchored(table, length)
    contexts = Contexts(block, {s: a for s, a in told.items() if s >= 0}, length)
    return block, contexts.covered({-1 - s: a for s, a in told.items() if s < 0}, shards)


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans, [start, end) in bytes."""
    found, shards = _found(documents(docs), length)
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}

    def last(table: pa.Table, told: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        block, gone = _removed(table, told, length, shards)
        out: dict[str, list] = {name: [] for name in types}
        for doc, a, b in zip(table.column("doc_id").to_pylist(), block.starts.tolist(), block.ends.tolist()):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept = block.data[a:b][~own].tobytes()
            for name, value in zip(types, (doc, b - a, int(own.sum()), len(edges), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in edges])):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({name: pa.array(v, types[name]) for name, v in out.items()})

    return B.finish(found, last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the columns they have, their texts without repeats. A character that loses a byte goes as a whole; n_chars follows; nulls stay null."""
    own = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    found, shards = _found(own, length)

    def last(table: pa.Table, told: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        block, gone = _removed(table, told, length, shards)
        texts = []
        for a, b, whole in zip(block.starts.tolist(), block.ends.tolist(), table.column("text").is_valid().to_pylist()):
            data, lost = block.data[a:b], gone[a:b]
            if lost.any():
                char = np.cumsum((data & 0xC0) != 0x80) - 1
                lost = np.bincount(char, weights=lost)[char] > 0
            texts.append(data[~lost].tobytes().decode() if whole else None)
        k = table.schema.get_field_index("text")
        yield from table.set_column(k, table.schema.field(k), pa.array(texts, table.schema.field(k).type)).to_batches()

    out = B.finish(found, last, own.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
