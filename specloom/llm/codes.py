"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, floor(1024 * x); a vector is cut into `PARTS` consecutive parts, each
with a codebook of `ENTRIES` entries at most, found by Lloyd's rounds from the vectors of the
smallest vec_ids. Distances, ties and means are exact integers.

Elkan's bounds save most distances of the later rounds. With each vector are kept, for each part, an
upper bound of the distance to its entry and a lower bound of the distance to every entry (one byte
each, in steps of the largest, rounded down). After a round the bounds are shifted by how far the
entries moved. An entry is passed over only if it is strictly farther than the upper bound: by its
lower bound, or because it lies more than twice that bound from the vector's entry. Whatever is left
is compared in integers, ties going to the lower number.

A round is one pass over the vectors, written to the shared folder with the sums of each task beside
them; the driver gets the added-up sums, one row an entry (`PARTS` * `ENTRIES` at most).

Cases: rows whose vector is null or has null, NaN or infinite components (or components beyond the
range of 32-bit floats) are dropped; the vector of the smallest vec_id (null ids last, ties by
components) sets the number of components, and rows with another number have no place in the
codebooks and are dropped; if four doesn't divide it the first parts are longer; fewer vectors than
entries make fewer entries; repeated rows stay; null labels are one label; an error beyond 64 bits is
null; large components are compared in whole numbers of any length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, lookup

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared at once in a task.
CHUNK = 2048
#: Sums travel as two numbers, so that they fit in decimals.
LIMB = 1 << 62


def splits(size: int) -> list[tuple[int, int]]:
    """Begin and end of the parts of a vector."""
    edges = np.cumsum([0, *(len(x) for x in np.array_split(np.empty(size), PARTS))]).tolist()
    return list(zip(edges, edges[1:]))


def whole(x: float) -> int:
    """floor(1024 * x), whatever its size."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def narrow_limit(size: int) -> int:
    """Components below it make distances that are exact in doubles and in 64 bits."""
    return int(math.sqrt((1 << 53) / max(1, size))) // 2


def _up(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 + 1e-6)


def _down(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 - 1e-9)


@dataclass
class Book:
    """The entries of one part and how far each moved since the round before (rounded up)."""

    entries: list[tuple[int, ...]]
    moved: np.ndarray

    def prepare(self) -> None:
        """In a task: entries as an array, half their distances, and half the distance to the nearest other."""
        size = len(self.entries[0])
        self.limit = narrow_limit(size)
        self.narrow = all(abs(v) < self.limit for e in self.entries for v in e)
        if self.narrow:
            self.flat = np.array(self.entries, np.int64).reshape(len(self.entries), size)
            self.half = _down(self.all_squares(self.flat)) / 2
            other = self.half.copy()
            np.fill_diagonal(other, np.inf)
            self.near = other.min(axis=1)

    def all_squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of x to all entries; every step is a whole number below 2**53."""
        a, b = x.astype(np.float64), self.flat.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entry, squared distance, upper and lower bounds of vectors without bounds."""
        squares = self.all_squares(x)
        entry = squares.argmin(1)  # the first of equals
        own = squares[np.arange(len(x)), entry]
        return entry, own, _up(own), _down(squares)

    def later(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the bounds of the round before, and how many distances that took."""
        upper = upper + self.moved[entry]
        lower = np.maximum(lower - self.moved, 0)
        own = np.full(len(x), -1, np.int64)
        rows = np.flatnonzero(upper >= self.near[entry])
        maybe = (lower[rows] <= upper[rows, None]) & (self.half[entry[rows]] <= upper[rows, None])
        maybe[np.arange(len(rows)), entry[rows]] = False
        some = maybe.any(1)
        rows, maybe = rows[some], maybe[some]
        was = entry[rows]
        now = ((x[rows] - self.flat[was]) ** 2).sum(1)
        tight = _up(now)
        lower[rows, was] = _down(now)
        maybe &= (lower[rows] <= tight[:, None]) & (self.half[was] <= tight[:, None])
        r, c = np.nonzero(maybe)
        squares = ((x[rows[r]] - self.flat[c]) ** 2).sum(1)
        lower[rows[r], c] = _down(squares)
        best = now << 8 | was
        np.minimum.at(best, r, squares << 8 | c)
        entry = entry.copy()
        entry[rows], own[rows], upper[rows] = best & 255, best >> 8, _up(best >> 8)
        return entry, own, upper, lower, len(rows) + len(r)

    def exact(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.flat[entry]) ** 2).sum(1)

    def slow(self, x: tuple[int, ...]) -> tuple[int, int]:
        """Squared distance and entry in whole numbers of any length."""
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(self.entries))


def pack_bounds(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes and the step of each vector; what comes back is never larger."""
    step = (lower.max(1) / 255 * (1 + 1e-6)).astype(np.float32)
    safe = np.where(step > 0, step, 1).astype(np.float64)
    return np.minimum(lower / safe[:, None], 255).astype(np.uint8), step


def unpack_bounds(steps: np.ndarray, step: np.ndarray) -> np.ndarray:
    return steps * (step.astype(np.float64)[:, None] * (1 - 1e-6))


class Task:
    """What one task does: assigns vectors, keeps their bounds, and adds up the parts of each entry."""

    def __init__(self, books: list[Book], size: int):
        self.books, self.spans = books, splits(size)
        for b in books:
            b.prepare()
        self.counts = np.zeros((PARTS, ENTRIES), np.int64)
        self.sums = [np.zeros((ENTRIES, b - a), np.int64) for a, b in self.spans]
        self.large: dict[tuple[int, int], list[int]] = {}
        self.distances = 0

    def assign(self, vectors: np.ndarray, state: tuple | None) -> tuple:
        """(entry, own, upper, steps, step), a row a vector and a column a part, of float vectors; own: squared distances (objects; -1: not needed)."""
        n = len(vectors)
        k = max(len(b.entries) for b in self.books)
        entry, own = np.zeros((n, PARTS), np.int64), np.full((n, PARTS), -1, object)
        upper, steps, step = np.full((n, PARTS), np.inf), np.zeros((n, PARTS, k), np.uint8), np.zeros((n, PARTS), np.float32)
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
        for p, (book, (a, b)) in enumerate(zip(self.books, self.spans)):
            wide = np.abs(scaled[:, a:b]).max(1, initial=0) >= book.limit if book.narrow else np.ones(n, bool)
            rows = np.flatnonzero(~wide)
            if len(rows):
                x = scaled[rows, a:b].astype(np.int64)
                if state is None:
                    e, d, u, low = book.first(x)
                    self.distances += low.size
                else:
                    e, d, u, low, took = book.later(x, state[0][rows, p], state[1][rows, p], unpack_bounds(state[2][rows, p], state[3][rows, p]))
                    self.distances += took
                entry[rows, p], own[rows, p], upper[rows, p] = e, d, u
                steps[rows, p], step[rows, p] = pack_bounds(low)
                order = np.argsort(e, kind="stable")
                begins = np.flatnonzero(np.diff(e[order], prepend=-1))
                self.counts[p] += np.bincount(e, minlength=ENTRIES)
                if b > a:
                    self.sums[p][e[order][begins]] += np.add.reduceat(x[order], begins, axis=0)
            for i in np.flatnonzero(wide).tolist():
                x = tuple(whole(float(v)) for v in vectors[i, a:b])
                own[i, p], entry[i, p] = book.slow(x)
                self.counts[p, entry[i, p]] += 1
                total = self.large.setdefault((p, int(entry[i, p])), [0] * (b - a))
                total[:] = [s + v for s, v in zip(total, x)]
        return entry, own, upper, steps, step

    def added(self) -> dict[str, list]:
        """One row for each part and entry that has vectors."""
        out: dict[str, list] = {"part": [], "entry": [], "n": [], "sums": []}
        for p, c in zip(*np.nonzero(self.counts)):
            total = [int(a) + b for a, b in zip(self.sums[p][c], self.large.get((int(p), int(c)), [0] * self.sums[p].shape[1]))]
            for name, value in zip(out, (int(p), int(c), int(self.counts[p, c]), [Decimal(y) for s in total for y in divmod(s, LIMB)])):
                out[name].append(value)
        return out


DECIMALS = pa.list_(pa.decimal128(38, 0))


def _floats(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a list column (no nulls, one length) or of binaries."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), size)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _pass(books: list[Book], size: int, last: bool):
    """A mapInArrow function: vectors (with or without state) to their state and the sums, or at last to codes and errors."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(at, CHUNK) for at in range(0, batch.num_rows, CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(books, size)
        k = len(books[0].entries)
        label = pa.null()
        for batch in chunks(batches):
            n, vectors = batch.num_rows, _floats(batch.column("vector"), size)
            label = batch.schema.field("label").type
            state = None
            if "code" in batch.schema.names:
                code, upper, steps, step = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, PARTS, -1) for c, kind in (("code", np.uint8), ("upper", np.float32), ("steps", np.uint8), ("step", np.float32)))
                state = code[:, :, 0].astype(np.int64), upper[:, :, 0].astype(np.float64), steps, step[:, :, 0]
            entry, own, upper, steps, step = task.assign(vectors, state)
            code = [x.tobytes() for x in entry.astype(np.uint8)]
            if last:
                for p, (book, (a, b)) in enumerate(zip(task.books, task.spans)):
                    open_ = np.flatnonzero(own[:, p] < 0)
                    if len(open_):
                        own[open_, p] = book.exact(np.floor(vectors[open_, a:b] * SCALE).astype(np.int64), entry[open_, p])
                error = [int(e) if (e := sum(x)) < 1 << 63 else None for x in own]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                bound = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                binary = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                columns = [batch.column("vec_id"), batch.column("label"), binary(vectors), pa.array(code, pa.binary()), binary(bound), binary(steps), binary(step)]
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), DECIMALS)]
                yield pa.RecordBatch.from_arrays([*columns, *none], names=STATE)
        if not last and (sums := task.added())["n"]:
            n = len(sums["n"])
            none = [pa.nulls(n, t) for t in (pa.int64(), label, *[pa.binary()] * 5)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(sums["part"], pa.int32()), pa.array(sums["entry"], pa.int32()), pa.array(sums["n"], pa.int64()), pa.array(sums["sums"], DECIMALS)], names=STATE)

    return run


STATE = ["vec_id", "label", "vector", "code", "upper", "steps", "step", "part", "entry", "n", "sums"]


def moved_books(state: DataFrame, books: list[Book], size: int) -> list[Book]:
    """The books after a round: the means of what each entry has, rounded down."""
    widest = max(b - a for a, b in splits(size))
    rows = state.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(2 * widest)]).collect()
    entries = [list(b.entries) for b in books]
    for r in rows:
        width = len(entries[r["part"]][0])
        entries[r["part"]][r["entry"]] = tuple((int(r[f"s{2 * i}"]) * LIMB + int(r[f"s{2 * i + 1}"])) // r["n"] for i in range(width))
    return [Book(new, np.array([_moved(a, b) for a, b in zip(old.entries, new)])) for old, new in zip(books, entries)]


def _moved(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    square = sum((x - y) ** 2 for x, y in zip(a, b))
    return math.sqrt(square) * (1 + 1e-6) if square < 1 << 1000 else math.inf


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (array<double>) of the rows that have one."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4028234663852886e38)
    found = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), embeddings["label"].alias("label"), vector.alias("vector"))
    return found.where(F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", bad), F.lit(True)))


@dataclass
class Codes:
    """codes: vec_id, label, code (binary, a byte a part), error; books: the entries of each part."""

    codes: DataFrame
    books: list[list[tuple[int, ...]]]

    def vectors(self) -> DataFrame:
        """vec_id and the vector that each code stands for (entries / 1024)."""
        books = self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[v / SCALE for book, c in zip(books, code) for v in book[c]] for code in batch.column("code").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "vector"])

        return self.codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> Codes:
    """Codes of all kept vectors after so many rounds."""
    kept = kept_vectors(embeddings)
    label = kept.schema["label"].dataType
    starts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector")
    first = starts.first()
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if first is None:
        return Codes(embeddings.sparkSession.createDataFrame([], out), [])
    size = len(first["vector"])
    kept = kept.where(F.size("vector") == size)
    starts = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()]
    books = []
    for a, b in splits(size):
        entries = [tuple(whole(v) for v in x[a:b]) for x in starts]
        books.append(Book(entries, np.zeros(len(entries))))
    binary = [T.StructField(c, T.BinaryType()) for c in ("vector", "code", "upper", "steps", "step")]
    sums = [T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), *binary, *sums])
    state = kept
    for _ in range(rounds):
        state = durable(state.mapInArrow(_pass(books, size, False), schema))
        books = moved_books(state, books, size)
        state = state.where("part is null").select(*STATE[:7])
    return Codes(durable(state.mapInArrow(_pass(books, size, True), out)), [b.entries for b in books])


def digest(found: Codes) -> DataFrame:
    """The contract's columns."""
    text = ",".join(str(v) for book in found.books for e in book for v in e)
    key = F.when(F.col("label").isNull(), F.lit("n")).otherwise(F.concat(F.lit("l"), F.col("label").cast("string")))
    codes = found.codes.withColumn("_key", key)
    labels = durable(codes.groupBy("_key").agg(F.count("*").alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("error").alias("_known")))
    total = int(labels.agg(F.sum("_n")).first()[0] or 0)
    sums = labels.select("_key", "_n", F.when(F.col("_known") == F.col("_n"), F.col("label_error").try_cast("long")).alias("label_error"))
    return lookup(codes, sums, "_key", "_n", total).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    )


def vector_codes(embeddings: DataFrame) -> DataFrame:
    return digest(compress(embeddings))


def _sql() -> str:
    near = f"min(CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, e.v) + list_inner_product(e.v, e.v) AS BIGINT) * {ENTRIES} + e.c)"
    assigned = lambda k: f"a{k} AS MATERIALIZED (SELECT x.p, x.k, any_value(x.v) AS v, {near} AS best FROM x JOIN b{k} e ON e.p = x.p GROUP BY x.p, x.k)"
    mean = lambda k: f"""m{k} AS (SELECT p, c, list(m ORDER BY j) AS v FROM (SELECT p, best % {ENTRIES} AS c, j, CAST(floor(sum(v[j]) / count(*)) AS DOUBLE) AS m FROM a{k}, unnest(range(1, len(v) + 1)) AS u(j) GROUP BY p, c, j) GROUP BY p, c),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, c))"""  # noqa: E731
    rounds = ",\n".join(f"{assigned(k)},\n{mean(k)}" for k in range(ROUNDS))
    return f"""
WITH d AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS k, list_transform(embedding, lambda z: floor(1024 * z::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT k, p, w[p * len(w) // {PARTS} + 1 : (p + 1) * len(w) // {PARTS}] AS v FROM d, unnest(range({PARTS})) AS u(p)),
b0 AS (SELECT p, k AS c, v FROM x WHERE k < {ENTRIES}),
{rounds},
{assigned(ROUNDS)},
f AS (SELECT k, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda z: z::BIGINT), ','), ',' ORDER BY p, c)) FROM b{ROUNDS}) AS codebooks_sha256 FROM d JOIN f USING (k)
"""


ORACLE_SQL = _sql()
