"""Periodic runs of words: every maximal stretch with a short period, and texts with their repeats collapsed.

A run is a stretch of consecutive words whose smallest period q fits it `LEAST_EXPONENT` times at
least, of `LEAST_LENGTH` words at least, that no neighbouring word extends. The period of a run is
the length of a Lyndon word: where the run breaks off, one of the two orders of words (one the
other's inverse) makes each of its roots the longest Lyndon word at its place. So the words are
scanned right to left under both orders with a stack of suffixes, whose tops part the longest Lyndon
words; a root that is followed by two more of its kind is extended to both sides.

Suffixes are compared, and roots extended, by the length of their longest common extension (LCE):
a binary search over rolling hashes, then the words themselves are compared, so a collision costs time
and not a result. What has been compared at one distance is kept, and not compared again.

Only stretches that may hold a run are scanned: in a run each three words in a row stand three
times, the next no farther than a quarter of the stretch. Hashes decide that for a batch of texts at
once; a collision only makes a stretch longer.

Cases: null text has no words, no runs and an empty collapsed text; null and repeated doc_ids stay,
each row by itself; other columns are ignored; an empty table gives no rows; of runs with equal
exponents the one with the smallest start, then period, is the greatest; a text is held whole by the
task that reads it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, raw_texts, slices
from .wordstream import mix

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Rolling hashes: a Mersenne prime and a base.
PRIME, BASE = (1 << 61) - 1, 0x1D3F_8A6B_5C97_E241 % ((1 << 61) - 1)

_powers = [1]


def _power(n: int) -> list[int]:
    while len(_powers) <= n:
        _powers.append(_powers[-1] * BASE % PRIME)
    return _powers


class Scan:
    """One stretch of words, as numbers."""

    def __init__(self, words: np.ndarray):
        self.flat = words
        self.words = words.tolist()
        self.n = len(self.words)
        self.powers = _power(self.n)
        self.hashes = [0]
        for w in self.words:
            self.hashes.append((self.hashes[-1] * BASE + w + 1) % PRIME)
        self.same: dict[int, tuple[int, int]] = {}  # of a distance d: words[x] == words[x + d] for x from first to last, and not at last

    def _equal(self, i: int, j: int, n: int) -> bool:
        h = self.hashes
        return (h[i + n] - h[j + n] - (h[i] - h[j]) * self.powers[n]) % PRIME == 0

    def _search(self, equal: Callable[[int], bool], most: int) -> int:
        """The greatest length up to `most` that is equal: doubled until it isn't, then halved."""
        step = 1
        while step <= most and equal(step):
            step *= 2
        low, high = step // 2, min(step - 1, most)
        while low < high:
            mid = (low + high + 1) // 2
            if equal(mid):
                low = mid
            else:
                high = mid - 1
        return low

    def _verified(self, i: int, j: int, n: int) -> int:
        """How many of the n words from i and from j are equal, word by word."""
        differ = np.flatnonzero(self.flat[i : i + n] != self.flat[j : j + n])
        return int(differ[0]) if len(differ) else n

    def lce(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        if j >= self.n or self.words[i] != self.words[j]:
            return 0
        d = j - i
        first, last = self.same.get(d, (self.n, self.n))
        if first <= i < last:
            return last - i
        if i < first < self.n and self._equal(i, j, first - i) and self._verified(i, j, first - i) == first - i:
            self.same[d] = (i, last)
            return last - i
        most = self.n - j
        found = self._search(lambda n: self._equal(i, j, n), most)
        found = self._verified(i, j, found)
        while found < most and self.words[i + found] == self.words[j + found]:  # two hashes collided
            found += 1
        self.same[d] = (i, i + found)
        return found

    def lcs(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j)."""
        found = self._search(lambda n: self._equal(i - n, j - n, n), i)
        while self._verified(i - found, j - found, found) < found:
            found //= 2
        while found < i and self.words[i - found - 1] == self.words[j - found - 1]:
            found += 1
        return found

    def next_smaller(self, sign: int) -> list[int]:
        """For each place the next suffix that is smaller (the end is smallest); up to it reaches the longest Lyndon word."""
        words, n = self.words, self.n
        out, stack = [n] * n, [n]
        for i in range(n - 1, -1, -1):
            while (j := stack[-1]) < n:
                a, b = words[i], words[j]
                if a == b:
                    k = self.lce(i, j)
                    if j + k == n:
                        break
                    a, b = words[i + k], words[j + k]
                if (a > b) == (sign > 0):
                    break
                stack.pop()
            out[i] = stack[-1]
            stack.append(i)
        return out

    def runs(self, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, sorted."""
        found: set[tuple[int, int, int]] = set()
        words, n = self.words, self.n
        for sign in (1, -1):
            self.same.clear()
            last: dict[int, tuple[int, int]] = {}
            for i, j in enumerate(self.next_smaller(sign)):
                p = j - i
                # the first root of a run begins less than p after it, so all but two of its periods follow
                if j + (exponent - 2) * p > n or words[i] != words[j]:
                    continue
                a, b = last.get(p, (0, 0))
                if a <= i and j <= b:
                    continue
                ahead = self.lce(i, j)
                if ahead < (exponent - 2) * p:
                    continue
                start = i - self.lcs(i, j)
                last[p] = start, j + ahead
                length = j + ahead - start
                if length >= max(least, exponent * p):
                    found.add((start, length, p))
        return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) of the words of many texts outside which no run lies (of 6 words and 4 periods or more)."""
    at = np.flatnonzero(text[:-2] == text[2:]) if len(words) > 2 else np.zeros(0, np.int64)
    group = text[at]
    limit = np.bincount(text)[group] // LEAST_EXPONENT
    grams = words.astype(np.uint64)
    while len(at):
        key = mix(mix(mix(grams[at] + np.uint64(1)) + grams[at + 1]) + grams[at + 2]) ^ mix(group.astype(np.uint64) + np.uint64(0x51ED27))
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        new = np.append(True, key[1:] != key[:-1])
        gap = np.where(new[1:], len(words), np.diff(place))
        nearest = np.minimum(np.append(len(words), gap), np.append(gap, len(words)))
        begins = np.flatnonzero(new)
        often = np.repeat(np.diff(np.append(begins, len(key))), np.diff(np.append(begins, len(key)))) >= 3
        good = np.empty(len(at), bool)
        good[order] = often & (nearest <= limit[order])
        kept, whose = at[good], group[good]
        begins = np.flatnonzero(np.append(True, (np.diff(kept) > 1) | (np.diff(whose) != 0))) if len(kept) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(kept)))
        long = sizes >= LEAST_LENGTH - 2
        each = np.repeat(long, sizes)
        before = len(at)
        at, group, limit = kept[each], np.repeat(np.arange(len(sizes)), sizes)[each], np.repeat((sizes + 2) // LEAST_EXPONENT, sizes)[each]
        if len(at) == before:
            return [(int(kept[b]), int(kept[b]) + int(s) + 2) for b, s in zip(begins[long], sizes[long])]
    return []


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text's words."""
    number: dict[bytes, int] = {}
    fresh = count()
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([np.fromiter(map(number.setdefault, t, fresh), np.int64, len(t)) for t in texts]) if len(texts) else np.zeros(0, np.int64)
    out: list[list] = [[] for _ in texts]
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    for a, b in stretches(flat, text):
        k = int(text[a])
        out[k] += [(int(a - first[k]) + s, length, p) for s, length, p in Scan(flat[a:b]).runs()]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what repeats: of each run only its first period stays, unless another run drops that too."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period), collapsed (the kept words, one space between). prepare: what to make of a document's words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [x.split() for x in raw_texts(batch.column("text"))]  # bytes: at 0x20 and 0x09-0x0D
            if prepare:
                texts = [prepare(k, words) for k, words in zip(ids, texts)]
            found = runs_of(texts)
            collapsed = pa.array([collapse(words, own) for words, own in zip(texts, found)], pa.binary())
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, RUNS), collapsed.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return documents(docs).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: one document in ten (by crc32 of its id) repeats a stretch of its words to its end; a null id doesn't."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", 0), lambda best, x: F.when(greater(x, best), x).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("_best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return out.select("doc_id", "n_runs", "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


_SQL_BEST = "arg_min({0}, {{'r': -length::DOUBLE / period, 's': start, 'p': period}})"
#: Equal words at each distance, as islands; a period that a smaller one covers is not the smallest.
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS h FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS q FROM g),
w AS MATERIALIZED (SELECT k, n, i, CASE WHEN i >= a THEN w[a + (i - a) % q + 1] ELSE w[i + 1] END AS word FROM p, unnest(range(n)) AS u(i)),
e AS (SELECT x.k, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
s AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e),
c AS MATERIALIZED (SELECT k, min(i) AS start, count(*) + q AS length, q AS period FROM s GROUP BY k, q, island HAVING count(*) + q >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * q)),
r AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.k = c.k AND d.period < c.period AND d.start <= c.start AND d.start + d.length >= c.start + c.length)),
b AS (SELECT k, count(*) AS n_runs, {_SQL_BEST.format("start")} AS start, {_SQL_BEST.format("length")} AS length, {_SQL_BEST.format("period")} AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY k),
o AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = w.k AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (k) LEFT JOIN o USING (k)
"""
