"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingles.

SimHash comes first (see simhash): the majority bits of a set's shingles, anchors, links of 2 or
fewer differing bits, components. Each set of a component is compared with the component's least
by all their shingles, and those that are similar are joined.

No number of differing bits holds for a similarity of 0.8 (its pairs differ by about ten of 64
bits, some by many more), so the rest is found by the shingles themselves, which misses none:
if two sets have similarity s, the first n - ceil(s n) + 1 shingles of each, in any order that all
sets share, have one in common. Rare shingles come first, so that what many texts quote is seldom
asked for; counts in hashed cells rank them, which decides the cost and never the result. Pairs
that SimHash has joined are not compared again.

Shards by shingle pair the sets that share a first shingle, if their sizes and the places of the
shingle leave room for the similarity. A group of over `SMALL` sets first links all to the one
that has the shingle earliest; only pairs that no link has joined by then are compared after that.
Every candidate is compared by all its shingles.

Equal sets are one node; a text without words has the empty set. Words, shingles and nodes are told
apart by hashes of 64 bits. The sets that are compared are few of all; a bitmap of fixed size keeps
most of the others from being sent.

Cases: null and wordless texts have the empty set and are copies of each other; fewer words than a
shingle are one shingle; rows without a doc_id stay; repeated rows are copies; an empty table gives
no rows; docs may have any other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import simhash
from .common import documents, durable, give_back, raw_texts, slices, text_bytes
from .components import connected_components
from .maxent import _sums
from .simhash import grouped, keep_first
from .wordstream import Words, mix

WORDS, SIMILARITY = 5, 0.8
CELLS = 1 << 21
FILTER_BITS = 26
SMALL = 8
SHARD_BYTES = 4 << 20
SEND_ROWS = 1 << 19
#: Text that is hashed at once: its arrays stay in a core's cache.
SCAN_BYTES = 1 << 18
#: Text whose shingles are counted at once: an array of all cells is added for each.
COUNT_BYTES = 8 << 20


class Sets:
    """The sets of word shingles of many texts: `hash`, by text and in order within it; `of`, the text of each; `size` and `node` of each text."""

    def __init__(self, texts: list[bytes], words: int = WORDS):
        found = Words(texts)
        n, begin = found.counts, np.cumsum(found.counts) - found.counts
        count = np.where(n < words, np.minimum(n, 1), n - words + 1)
        self.of = np.repeat(np.arange(len(n)), count)
        at = begin[self.of] + np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)
        own = np.zeros(len(at), np.uint64)
        width = np.minimum(n, words)[self.of]
        for j in range(words):
            part = np.flatnonzero(width > j)
            own[part] = mix((own[part] ^ np.uint64(j + 1)) + found.hash[at[part] + j])
        order = np.lexsort((own, self.of))
        own, of = own[order], self.of[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
        self.hash, self.of = own[fresh], of[fresh]
        self.size = np.bincount(self.of, minlength=len(n))
        self.first = np.cumsum(self.size) - self.size
        self.node = np.zeros(len(n), np.int64)
        filled = np.flatnonzero(self.size)
        if len(filled):
            self.node[filled] = mix(np.add.reduceat(mix(self.hash ^ np.uint64(0x5851F42D4C957F2D)), self.first[filled]) + self.size[filled].astype(np.uint64)).view(np.int64)


def set_nodes(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    return Sets(texts, words).node


def nodes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, which rows with equal sets of shingles share, and print, the SimHash fingerprint of the set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SCAN_BYTES):
            own = Sets(raw_texts(batch.column("text")), words)
            prints = simhash.majorities(own.hash, own.size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.node), pa.array(prints)], names=["doc_id", "fp", "print"])

    return documents(docs).mapInArrow(scan, "doc_id long, fp long, print long")


def print_pairs(own: DataFrame) -> DataFrame:
    """Pairs a, b of nodes: each node (fp, print) with the least of its component of linked fingerprints."""
    distinct = durable(own.where("fp <> 0").select("fp", "print").distinct())  # a text without words is like no other
    prints = durable(distinct.groupBy("print").agg(F.min("fp").alias("_least")))
    roots = connected_components(simhash.links(prints.select(F.col("print").alias("fp"))))
    named = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "_least", F.coalesce("root", "print").alias("_root"))
    heads = named.groupBy("_root").agg(F.min("_least").alias("a"))
    return distinct.join(named.join(heads, "_root").select("print", "a"), "print").where("a <> fp").select("a", F.col("fp").alias("b"))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7)).astype(np.int64) & (CELLS - 1)


class Rule:
    """What a similarity (a fraction) asks of sizes and places."""

    def __init__(self, similarity: float):
        s = Fraction(str(similarity))
        if not 0 < s <= 1:
            raise ValueError("a similarity is over 0 and at most 1")
        self.p, self.q = s.numerator, s.denominator

    def prefix(self, n):
        return n - -(-self.p * n // self.q) + 1

    def holds(self, n, m, shared):
        """Whether sets of n and m with so many in common (or at most so many) are (or may be) similar."""
        return shared * (self.p + self.q) >= self.p * (n + m)

    def room(self, n, i, m, j):
        """Whether sets of n and m may be similar whose first common shingle is at i and j."""
        return self.holds(n, m, np.minimum(n - i, m - j))


def _groups(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted tokens: the first row of each row's group, and its size."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    n = np.diff(np.append(first, len(token)))
    return np.repeat(first, n), np.repeat(n, n)


def _unique(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return found[:, 0], found[:, 1]


def candidates(docs: DataFrame, words: int, rule: Rule) -> DataFrame:
    """Pairs a, b (token null) to be compared, and of large groups each row: token, a, n, pos."""
    own = documents(docs)
    spark, total = docs.sparkSession, text_bytes(own)
    shards = B.shards_for(total, SHARD_BYTES)

    def count(texts: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(t) for t in texts]) // SCAN_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        counts = np.zeros(CELLS, np.float32)
        for a, b in zip(cuts, cuts[1:]):
            np.add.at(counts, _cell(Sets(texts[a:b], words).hash), np.float32(1))
        return [counts]

    counted = _sums(own, count, COUNT_BYTES, total)
    sent = spark.sparkContext.broadcast(counted[0].astype(np.float32) if counted else np.zeros(CELLS, np.float32))  # of fixed size

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        known: set[int] = set()
        size = 0

        def close() -> pa.RecordBatch:
            token, node, n, pos = (np.concatenate(c) for c in zip(*held))
            shard = ((token >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            parts = [order[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            data = [B.squeeze(token[p], node[p], n[p], pos[p]) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([shard[p[0]] for p in parts], pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

        for batch in slices(batches, most=SCAN_BYTES):
            found = Sets(raw_texts(batch.column("text")), words)
            wanted = np.zeros(len(found.node), bool)
            wanted[[k for k, (node, m) in enumerate(zip(found.node.tolist(), found.size.tolist())) if m and node not in known and not known.add(node)]] = True
            order = np.lexsort((found.hash, sent.value[_cell(found.hash)], found.of))
            of = found.of[order]
            pos = np.arange(len(of)) - found.first[of]
            keep = (pos < rule.prefix(found.size)[of]) & wanted[of]
            order, of, pos = order[keep], of[keep], pos[keep]
            held.append((found.hash[order], found.node[of], found.size[of].astype(np.int32), pos.astype(np.int32)))
            size += len(of)
            if size >= SEND_ROWS:
                yield close()
                held, size, known = [], 0, set()
        if size:
            yield close()

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        token, node, n, pos = (np.concatenate(x) for x in zip(*(B.unsqueeze(d) for d in group.column("data").to_pylist())))
        order = np.lexsort((node, n, pos, token))
        token, node, n, pos = token[order], node[order], n[order], pos[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])  # copies stand side by side
        token, node, n, pos = token[fresh], node[fresh], n[fresh].astype(np.int64), pos[fresh].astype(np.int64)
        first, size = _groups(token)
        token, node, n, pos, size = (x[size > 1] for x in (token, node, n, pos, size))
        first = _groups(token)[0] if len(token) else first[:0]
        pairs = []

        def pair(x: np.ndarray, y: np.ndarray) -> None:
            fits = rule.room(n[x], pos[x], n[y], pos[y]) & (node[x] != node[y])
            pairs.append((node[x[fits]], node[y[fits]]))

        rows = np.arange(len(token))
        low = rows[size <= SMALL]
        for d in range(1, SMALL):
            low = low[low + d < first[low] + size[low]]
            pair(low, low + d)
        large = rows[size > SMALL]
        pair(first[large], large)
        a, b = _unique(pairs)
        give_back()
        blank = lambda k: pa.nulls(k, pa.int64())
        return pa.concat_tables([
            pa.table({"token": blank(len(a)), "a": pa.array(a), "b": pa.array(b), "n": blank(len(a)), "pos": blank(len(a))}),
            pa.table({"token": pa.array(token[large].view(np.int64)), "a": pa.array(node[large]), "b": blank(len(large)), "n": pa.array(n[large]), "pos": pa.array(pos[large])}),
        ])

    return own.select("text").mapInArrow(send, "shard int, data binary").groupBy("shard").applyInArrow(meet, "token long, a long, b long, n long, pos long")


def apart(large: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame:
    """Pairs a, b of a group that are not linked yet."""
    known = large.join(roots, large["a"] == roots["node"], "left").select("token", "a", "n", "pos", F.coalesce("root", "a").alias("root"))
    mixed = known.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("token")

    def cross(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        a, n, pos, root = (group.column(c).to_numpy() for c in ("a", "n", "pos", "root"))
        kinds, of, count = np.unique(root, return_inverse=True, return_counts=True)
        pairs, size = [], 0
        for k in np.flatnonzero(of != count.argmax()).tolist():
            fits = (root != root[k]) & rule.room(n[k], pos[k], n, pos)
            pairs.append((np.full(fits.sum(), a[k]), a[fits]))
            size += len(pairs[-1][0])
            if size >= SEND_ROWS:
                x, y = _unique(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                pairs, size = [], 0
        x, y = _unique(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return known.join(mixed, "token", "left_semi").groupBy("token").applyInArrow(cross, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("_x", "_y"))
            fits = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                fits.append(bool(rule.holds(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)))))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("_x")), "a")
    return with_a.join(sets.select(F.col("node").alias("b"), F.col("own").alias("_y")), "b").select("a", "b", "_x", "_y").mapInArrow(compare, "a long, b long")


def components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, own: DataFrame | None = None) -> DataFrame:
    """node and root of all nodes whose sets are similar to another's, directly or over others; root is the least node."""
    rule = Rule(similarity)
    near = durable(print_pairs(durable(nodes(docs, words)) if own is None else own))
    joined = durable(similar(near, sets_of(docs, near, words), rule))
    found = durable(candidates(docs, words, rule))
    pairs, large = found.where("token is null").select("a", "b").distinct(), found.where("token is not null").select("token", "a", "n", "pos")
    pairs = durable(unlinked(pairs, stars(joined)))
    roots = connected_components(joined.union(durable(similar(pairs, sets_of(docs, pairs, words), rule))))
    if large.isEmpty():
        return roots
    more = durable(apart(large, roots, rule))
    if more.isEmpty():
        return roots
    return connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(durable(similar(more, sets_of(docs, more, words), rule))))


def stars(joined: DataFrame) -> DataFrame:
    """node and root of pairs a, b whose a is the least node of their component: SimHash's pairs are of that kind, so they need no rounds."""
    return joined.select(F.col("b").alias("node"), F.col("a").alias("root")).union(joined.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in no component together."""
    with_a = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left")
    with_b = with_a.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    return with_b.where("coalesce(_ra <> _rb, true)").select("a", "b")


def sets_of(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """node and own (its shingles, in order) of the nodes of pairs. It stays behind its exchange, which both ends of the pairs read."""
    needed = durable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    marks = docs.sparkSession.sparkContext.broadcast(_marks(needed))  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SCAN_BYTES):
            own = Sets(raw_texts(batch.column("text")), words)
            place = own.node.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            near = np.flatnonzero(marks.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            _, first = np.unique(own.node[near], return_index=True)
            near = near[first]
            data = [own.hash[a:b].tobytes() for a, b in zip(own.first[near].tolist(), (own.first + own.size)[near].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(own.node[near]), pa.array(data, pa.binary())], names=["node", "own"])

    return documents(docs).select("text").mapInArrow(scan, "node long, own binary").join(needed, "node", "left_semi").dropDuplicates(["node"])


def _marks(needed: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits, by the first bits of the nodes."""
    place = F.shiftrightunsigned("node", 64 - FILTER_BITS) + 1  # buckets and their bits count from 1
    rows = needed.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # of the bitmap's size at most
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["at"] - 1) * len(part) : row["at"] * len(part)] = part
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, fp (of equal sets), component_id (the smallest doc_id that can be reached over links) and root (a fp that names the component) of each row."""
    own = durable(nodes(docs, words))
    return grouped(own.select("doc_id", "fp"), lambda _: components(docs, words, similarity, own))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near-duplicates, as simhash.keep_one."""
    return keep_first(docs, near_duplicates(docs, words, similarity), lambda texts: set_nodes(texts, words))
