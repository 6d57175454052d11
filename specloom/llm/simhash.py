"""SimHash near-duplicates by anchor-point covering.

Fingerprints are the bitwise majority of the XXH64 (seed 42) of a text's word shingles.

The anchors are a covering code on 46 of the 64 bits: two blocks of 23 bits, each with the
binary Golay code, which is perfect with covering radius 3. A fingerprint x is at home at the
anchor nearest to it, block by block. If y differs from x in at most 2 bits, y lies within
radius 3 plus those bits of x's home, in each block; so y is sent to every anchor that is within
5 in one block and its own home in the other, or within 4 in both (about 61 of 2**24 anchors),
and every link is met at the home of its smaller fingerprint. There all 64 bits are compared.
Only distinct fingerprints take part, so a large group of copies is a single row here.

Cases: null, empty and wordless texts have fingerprint zero, which links like any other; fewer
words than a shingle are one shingle; null doc_ids keep their row and name no component unless
nothing else could (null then); repeated rows are linked to each other; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, durable, lookup, raw_texts, slices
from .components import connected_components

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Up to so many doc_ids (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: Fixed values of the code: length, covering radius, generator polynomial.
BITS, RADIUS, GENERATOR = 23, 3, 0b110001110101

#: For each byte, its eight bits in eight bytes.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII white-space bytes
    if not words:
        return []
    if len(words) <= n:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    own = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxh64_intdigest(own[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority bits of consecutive groups of hashes; zero for an empty group."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.cumsum(n) - n
    parts = -(-n // 255)  # sums of up to 255 bits fit a byte
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    sums = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(starts, parts) + within * 255, axis=0)
    bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    out[full] = np.packbits(bits * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def prints(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    found = [shingle_hashes(t, n) for t in texts]
    flat = np.fromiter((h for x in found for h in x), np.uint64, sum(map(len, found)))
    return majorities(flat, np.array([len(x) for x in found], np.int64)).view(np.int64)


def printed(docs: DataFrame, of: Callable[[list[bytes]], np.ndarray], name: str) -> DataFrame:
    """docs with a column more: a long of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of(raw_texts(batch.column("text"))), pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField(name, LongType())]))


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a long of the fingerprint's 64 bits."""
    return printed(documents(docs), lambda texts: prints(texts, n), "fp").select("doc_id", "fp")


def syndromes(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for k in range(BITS - 1, BITS - 13, -1):
        out ^= ((out >> k) & 1) * (GENERATOR << (k - 11))
    return out


@cache
def errors(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """All error patterns up to a weight, by their syndrome (the lightest first), and where each syndrome's begin."""
    found = np.array([sum(1 << i for i in c) for w in range(weight + 1) for c in combinations(range(BITS), w)], np.int64)
    s = syndromes(found)
    return found[np.argsort(s, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(s, minlength=2048))])


def homes(block: np.ndarray) -> np.ndarray:
    found, first = errors(RADIUS)
    return block ^ found[first[syndromes(block)]]


def around(block: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Every codeword within `weight` of each block: rows and codewords."""
    found, first = errors(weight)
    s = syndromes(block)
    n = first[s + 1] - first[s]
    rows = np.repeat(np.arange(len(block)), n)
    return rows, block[rows] ^ found[np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def anchors(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints (uint64): their home anchors; and all that they are sent to, as rows and anchors."""
    mask = np.uint64((1 << BITS) - 1)
    a, b = (fp & mask).astype(np.int64), ((fp >> np.uint64(BITS)) & mask).astype(np.int64)
    ha, hb = homes(a), homes(b)
    rows, sent = [], []
    for ta in range(threshold + 1):  # up to `ta` bits differ in the first block, the rest in the second
        tb = threshold - ta
        ra, ca = around(a, RADIUS + ta) if ta else (np.arange(len(a)), ha)
        order = np.argsort(rb := (around(b, RADIUS + tb) if tb else (np.arange(len(b)), hb))[0], kind="stable")
        cb = (around(b, RADIUS + tb) if tb else (rb, hb))[1][order]
        n = np.bincount(rb, minlength=len(b))
        first = np.cumsum(n) - n
        each = n[ra]
        at = np.repeat(first[ra] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        rows.append(np.repeat(ra, each))
        sent.append(np.repeat(ca, each) | cb[at] << BITS)
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(sent)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return ha | hb << BITS, pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs a < b of the distinct fingerprints (fp) that differ in at most `threshold` (2 at most) bits."""
    if threshold > 2:
        raise ValueError("the anchors are laid out for up to 2 differing bits")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchors(fp.view(np.uint64), 0)[0]), batch.column("fp")], names=["anchor", "a"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                fp = batch.column("fp").slice(k, 2000).to_numpy()
                _, rows, sent = anchors(fp.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(sent), pa.array(fp[rows])], names=["anchor", "b"])

    at_home = distinct.select("fp").mapInArrow(home, "anchor long, a long")
    sent = distinct.select("fp").mapInArrow(visit, "anchor long, b long")
    near = (at_home["anchor"] == sent["anchor"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return at_home.join(sent, near).select("a", "b")


def grouped(own: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """own (doc_id, fp) with component_id and its component's root; components gives node and root of the distinct fp that are linked."""
    distinct = durable(own.groupBy("fp").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")))
    roots = components(distinct)
    joined = distinct.join(roots, distinct["fp"] == roots["node"])
    least = joined.groupBy("root").agg(F.min("_first").alias("_least"))
    named = distinct.join(roots.join(least, "root").select(F.col("node").alias("fp"), "root", "_least"), "fp", "left")
    known = named.select("fp", "_n", F.coalesce("_least", "_first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return lookup(own, known, "fp", "_n", own.count())


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that can be reached over links) and root (a fp that names the component) of each row."""
    return grouped(durable(fingerprints(docs, n)), lambda distinct: connected_components(links(distinct, threshold)))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the smallest doc_id."""
    return keep_first(docs, near_duplicates(docs, n, threshold), lambda texts: prints(texts, n))


def keep_first(docs: DataFrame, found: DataFrame, of: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, and of its rows that of the least text.

    found: doc_id, fp, component_id and root of each row; of gives the fp of texts. Rows without a
    doc_id can't be named and stay. docs may have columns of any names: they are set aside as one.
    """
    groups = durable(found.where("doc_id is not null"))
    by_id = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_stays"), F.count("*").alias("_rows"))
    gone = durable(by_id.where("not _stays").select(F.col("doc_id").alias("_gone")))
    if gone.count() <= BROADCAST_IDS:  # else both sides are dealt out by doc_id
        gone = F.broadcast(gone)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"), docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("text"))
    whole = [F.col("_all").getField(c).alias(c) for c in docs.columns]
    kept = own.join(gone, own["_id"] == gone["_gone"], "left_anti")
    if by_id.where("_stays and _rows > 1").isEmpty():
        return kept.select(*whole)
    twice = durable(by_id.where("_stays and _rows > 1").select(F.col("doc_id").alias("_twice")))
    heads = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_head"), F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
    again = printed(own.join(twice, own["_id"] == twice["_twice"], "left_semi"), of, "_own")
    again = again.join(heads, (again["_id"] == heads["_head"]) & (again["_own"] == heads["_fp"]))
    one = again.groupBy("_root").agg(F.min_by("_all", F.struct(F.col("text").isNotNull(), "text")).alias("_all"))
    return one.select(*whole).unionByName(kept.join(twice, own["_id"] == twice["_twice"], "left_anti").select(*whole))
