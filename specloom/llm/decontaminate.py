"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word windows.

Every document is scanned once against the set. A window is `n` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Candidates come from a
hash of the window's word numbers and are verified word by word before they count.

The set is broadcast in blocks of at most `block_windows` windows (a stated query set against
all rows; a longer item is dealt to several), so that what is sent has a fixed bound however large
the benchmark or one of its items is; each further block is another pass over the documents.

Cases: null or wordless texts have no words and no hits; null or empty items have no window;
repeated items count once by item_id; a null item_id marks words and counts as an item named
"null"; tables may be empty and may have any other columns.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, durable, raw_texts, slices

WINDOW_WORDS = 10
BLOCK_WINDOWS = 500_000
SPANS = "array<struct<start:int,end:int>>"

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and turns every byte outside words into a space.
NORMAL = bytes(x if x in _WORD else 0x20 for b in range(256) for x in [b + 32 if 0x41 <= b <= 0x5A else b])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class WindowSet:
    """The windows of some items by their length, with the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        self.words: dict[bytes, int] = {}
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            seen = tuple(self.words.setdefault(w, len(self.words)) for w in words_of(text))
            m = min(n, len(seen))
            for k in range(len(seen) - m + 1 if m else 0):
                owners[m][seen[k : k + m]].add(number[item])
        self.owners = {m: dict(found) for m, found in owners.items()}
        self.hashes = {m: np.unique(_hash(np.array(list(found), np.int64))) for m, found in self.owners.items()}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie inside an occurrence, and the items that occur."""
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        marks, found = np.zeros(len(ids) + 1, np.int64), set()
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for m, hashes in self.hashes.items():
            if len(ids) < m:
                continue
            at = np.flatnonzero(known[m:] - known[:-m] == m)
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(m)]
            near = np.isin(_hash(rows), hashes)
            for p, row in zip(at[near].tolist(), rows[near].tolist()):
                if owners := self.owners[m].get(tuple(row)):
                    marks[p] += 1
                    marks[p + m] -= 1
                    found |= owners
        return np.cumsum(marks[:-1]) > 0, found


def _hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1] if rows.ndim == 2 else 0):
        out = (out + rows[:, j].astype(np.uint64) + np.uint64(1)) * _BASE
        out ^= out >> np.uint64(29)
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _blocks(benchmark: DataFrame, n: int, most: int) -> Iterator[WindowSet]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    held, windows = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"].encode())
        for at in range(0, max(1, len(words) - n + 1), most):  # an item of more windows is dealt to several blocks
            part = words[at : at + most + n - 1]
            held.append((row["item"], b" ".join(part)))
            windows += max(1, len(part) - n + 1)
            if windows >= most:
                yield WindowSet(held, n)
                held, windows = [], 0
    if held:
        yield WindowSet(held, n)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *keep: str, n: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, text, the columns in `keep`, n_words, hits (runs of hit words, as [start, end) word numbers) and items (ids of the items with occurring windows)."""
    own, sc = documents(docs, *keep), docs.sparkSession.sparkContext
    first = list(islice(_blocks(benchmark, n, block_windows), 2)) or [WindowSet([], n)]
    if len(first) == 1:
        out = own.withColumns({"n_words": F.lit(None).cast("long"), "hits": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
        return out.mapInArrow(_scan(sc.broadcast(first[0])), out.schema)
    del first
    rows = durable(own.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*[F.col(f"`{c}`") for c in own.columns if c != "text"]).alias("more")))
    met = rows.join(_marks(rows, benchmark, n, block_windows), "row", "left").withColumn("n_words", F.lit(None).cast("long"))
    return met.mapInArrow(_settle, met.schema).select("text", "more.*", "n_words", "hits", "items").select(*own.columns, "n_words", "hits", "items")


def _marks(rows: DataFrame, benchmark: DataFrame, n: int, block_windows: int) -> DataFrame:
    """row, hits and items of the rows (row, text) that any block hits; a pass over the texts for each block, which writes what it found alone."""
    sc = rows.sparkSession.sparkContext
    marks = [durable(rows.select("row", "text").mapInArrow(_mark(sc.broadcast(block)), f"row long, hits {SPANS}, items array<string>")) for block in _blocks(benchmark, n, block_windows)]
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items")]  # one list a block at most
    return reduce(DataFrame.unionByName, marks).groupBy("row").agg(*lists)


def _scan(sent):
    """Of rows without hits: their words, hits and items by one block."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: WindowSet = sent.value
        for batch in slices(batches):
            counts, hits, items = [], [], []
            for text in raw_texts(batch.column("text")):
                words = words_of(text)
                hit, found = block.hits(words)
                counts.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in _runs(hit)])
                items.append(sorted({block.ids[k] for k in found}))
            new = {"n_words": counts, "hits": hits, "items": items}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema)

    return scan


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with the spans and items of all blocks: their words, and both without what several blocks found."""
    for batch in slices(batches):
        counts = [len(words_of(text)) for text in raw_texts(batch.column("text"))]
        hits = [[{"start": a, "end": b} for a, b in _merged([(r["start"], r["end"]) for r in own or []])] for own in batch.column("hits").to_pylist()]
        items = [sorted({*(own or [])}) for own in batch.column("items").to_pylist()]
        new = {"n_words": counts, "hits": hits, "items": items}
        yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema)


def word_bounds(text: bytes) -> np.ndarray:
    """[start, end) bytes of each word, one row a word."""
    own = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    return np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2)


def cut_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """text without the words of the runs."""
    bounds, kept, at = word_bounds(text), [], 0
    for a, b in runs:
        kept.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b" ".join([*kept, text[at:]])


def cut_spans(text: bytes, block: WindowSet) -> bytes:
    """text without its hit words; what a cut brings together is looked at again."""
    while True:
        hit, _ = block.hits(words_of(text))
        runs = _runs(hit)
        if not runs:
            return text
        text = cut_runs(text, runs)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, whole: bool = False, n: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with the columns they have; hit spans are cut out of their texts (n_chars follows), or hit documents dropped (`whole`).

    Where the benchmark is several blocks, the hits of all are marked before a text is cut, and
    the texts that were cut are looked at again until none has a hit. Texts are written once; a
    block's pass writes the numbers of the rows that it hits, and their spans. What docs hold besides
    the text lies in one struct meanwhile, so no name of theirs can clash.
    """
    out = docs.withColumn("text", F.col("text").cast("string"))
    first = list(islice(_blocks(benchmark, n, block_windows), 2))
    if len(first) == 1:
        out = out.mapInArrow(_cut(docs.sparkSession.sparkContext.broadcast(first[0]), whole), out.schema)
    elif first:
        del first
        left = durable(out.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*[F.col(f"`{c}`") for c in out.columns if c != "text"]).alias("more")))
        settled = []
        while True:
            hits = _marks(left, benchmark, n, block_windows).drop("items")
            met = left.join(hits, "row", "left")
            settled.append(met.where("hits is null").drop("hits"))
            hit = met.where("hits is not null")
            if whole or hit.isEmpty():
                break
            left = durable(hit.mapInArrow(_cut_marked, hit.schema).drop("hits"))
        out = reduce(DataFrame.unionByName, settled).select("text", "more.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _mark(sent):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: WindowSet = sent.value
        for batch in slices(batches):
            at, spans, items = [], [], []
            for k, text in enumerate(raw_texts(batch.column("text"))):
                hit, found = block.hits(words_of(text))
                if runs := _runs(hit):
                    at.append(k)
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    items.append([block.ids[k] for k in found])
            hits = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), hits, pa.array(items, pa.list_(pa.string()))], names=["row", "hits", "items"])

    return mark


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        k = batch.schema.get_field_index("text")
        done = [cut_runs(t, _merged([(r["start"], r["end"]) for r in runs])).decode() for t, runs in zip(raw_texts(batch.column("text")), batch.column("hits").to_pylist())]
        yield batch.set_column(k, batch.schema.field(k), pa.array(done, batch.schema.field(k).type))


def _cut(sent, whole: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: WindowSet = sent.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            done = [None if t is None else cut_spans(t.encode(), block).decode() for t in texts]
            if whole:
                batch = batch.filter(pa.array([a == b for a, b in zip(texts, done)]))
            else:
                batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(done, batch.schema.field("text").type))
            yield batch

    return cut


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_contamination's rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def sha256_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT m FROM bw
), dw AS (
  SELECT r, m, i, array_to_string(ws[i : i + m - 1], ' ') AS win
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, sizes WHERE len(ws) >= m)
), found AS (SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
