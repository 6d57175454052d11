"""WARC archives of captured pages, and their index by an external merge.

Writing: pages are sorted by URL key and time inside their partition and written as archives,
each record a gzip member of its own; an archive is a row of a table in the shared folder, which
any store that Spark writes to can hold, and whose commit survives lost tasks (`export` puts the
same bytes into .warc.gz files). Of equal payloads of at least `REVISIT_BYTES` one is a response,
the others are revisits that refer to it.

Index: the archives of one task are a run of captures in order. Reading cuts each run at common
borders of (URL key, time, record) into segments, which stay as they are, in order and compressed;
a range's segments are streams that a loser tree merges, a batch of each in memory. The ranges,
one after the other, are the capture history of the whole collection in order. Borders use the
whole key: a single host or URL with most of the captures is cut as well.

Cases: null html is an empty payload and stays a response; a null url has an empty key; null
page_ids are written as such and are never referred to; rows with the page_id of the response are
responses too; page_ids whose time would lie outside the years 1 to 9999 get the first or last
second of these; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lookup

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
MERGE_ROWS = 50_000
#: Borders are chosen from at most so many captures' keys.
MOST_SAMPLES = 500_000
INFLATE_BYTES = 1 << 16
_EPOCH = 1_704_067_200
#: The first and last second of the years 1 to 9999.
_TIMES = (-62_135_596_800, 253_402_300_799)


def url_key(url: Column) -> Column:
    """The host's labels from the last, then the rest of the URL."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def capture_time(page_id: Column) -> Column:
    """The tables name no time: captures are a second apart, by page_id."""
    low, high = (F.lit(t - _EPOCH).cast("long") for t in _TIMES)
    return F.greatest(low, F.least(high, F.coalesce(page_id, F.lit(0)))) + F.lit(_EPOCH)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, url_key, time, digest (SHA-1) and refers_to of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "url_key": url_key(F.col("url")), "time": capture_time(F.col("page_id"))})
    long = own.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
    kept = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return lookup(own, durable(long.where("_n > 1")), "digest", "_n", pages.count()).withColumn("refers_to", F.when(kept, F.col("_keeper"))).drop("_keeper")


def _when(seconds: int) -> str:
    return str(np.datetime64(seconds, "s")) + "Z"


def record(page_id, url: str | None, payload: bytes, digest: str, time: int, refers_to) -> bytes:
    """One WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {_when(time)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive (a number), content (the bytes of a .warc.gz) and captures (url_key, time, page_id, offset of each record, in order); written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, info = TaskContext.get().partitionId(), 0, b"software: specloom\r\nformat: WARC File Format 1.1\r\n"
        info = _member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-page:info>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(info) + info + b"\r\n\r\n")
        out, size, captures = [info], len(info), []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + count], pa.int64()), pa.array([b"".join(out)], pa.large_binary()).cast(pa.binary()), pa.array([captures], _CAPTURES)], names=["archive", "content", "captures"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "time", "refers_to", "url_key")]
            for k in range(0, batch.num_rows, 500):
                for page, url, payload, digest, time, refers, key in zip(*(c.slice(k, 500).to_pylist() for c in columns)):
                    data = _member(record(page, url, payload, digest, time, refers))
                    captures.append({"url_key": key, "time": time, "page_id": page, "offset": size})
                    out.append(data)
                    size += len(data)
                    if size >= archive_bytes:
                        yield close()
                        out, size, captures, count = [info], len(info), [], count + 1
        if captures:
            yield close()

    run = planned.sortWithinPartitions("url_key", "time", "page_id")
    return durable(run.mapInArrow(write, "archive long, content binary, captures array<struct<url_key:string,time:long,page_id:long,offset:long>>"))


_CAPTURES = pa.list_(pa.struct([("url_key", pa.string()), ("time", pa.int64()), ("page_id", pa.int64()), ("offset", pa.int64())]))


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and contents of each gzip member."""
    at, data = 0, memoryview(data)
    while at < len(data):
        start, parts, z = at, [], zlib.decompressobj(31)
        while not z.eof and at < len(data):  # in slices: what follows a member would be copied for each
            parts.append(z.decompress(data[at : at + INFLATE_BYTES]))
            at += min(INFLATE_BYTES, len(data) - at) - len(z.unused_data)
        yield start, b"".join([*parts, z.flush()])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(uri: str | None) -> int | None:
    return int(n) if uri and (n := uri[len("<urn:x-page:") : -1]).lstrip("-").isdigit() else None


_ROW = pa.schema([
    ("archive", pa.int64()), ("offset", pa.int64()), ("url_key", pa.string()), ("time", pa.int64()), ("page_id", pa.int64()),
    ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
ROW = "archive long, offset long, url_key string, time long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def captures_of(archive: int, content: bytes, captures: list[dict]) -> Iterator[tuple]:
    """The captures of one archive as rows of `ROW`, in its order. A response whose payload hasn't its digest fails the job."""
    index = {c["offset"]: (c["url_key"], c["time"]) for c in captures}
    for offset, data in members(content):
        fields, block = parse(data)
        if (kind := fields["warc-type"]) == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"archive {archive}, offset {offset}: the payload hasn't the digest that its record names")
        size = int(http.rpartition(b"Content-Length:")[2])
        yield (archive, offset, *index[offset], _page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to")))


def read_archives(archives: DataFrame) -> DataFrame:
    """Every capture in the archives (`ROW`), archive by archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, captures in zip(*(batch.column(c) for c in ("archive", "content", "captures"))):
                yield _batch(list(captures_of(archive.as_py(), content.as_py(), captures.as_py())))

    return archives.mapInArrow(read, ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROW)] if rows else [pa.array([], f.type) for f in _ROW], schema=_ROW)


def _key(row: tuple) -> tuple:
    """The order of captures; archive and offset tell any two apart."""
    archive, offset, url_key, time, page_id = row[:5]
    return url_key, time, page_id is not None, page_id or 0, archive, offset


class LoserTree:
    """Merges sorted iterables: each inner node holds the loser of its match, so the next item takes one path of matches."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.losers = [0] * self.k
        winners = [*([0] * self.k), *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x < y or (x == y and a < b)))

    def __iter__(self) -> Iterator:
        while (item := self.heads[self.winner]) is not None:
            yield item
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def borders(archives: DataFrame, merge_rows: int | None = None) -> list[tuple]:
    """Keys that cut the captures into ranges of about `merge_rows`, from evenly spaced samples of all runs (`MOST_SAMPLES` at most)."""
    total = archives.agg(F.sum(F.size("captures"))).first()[0] or 0
    ranges = -(-total // (merge_rows or MERGE_ROWS))
    if ranges < 2:
        return []
    step = -(-total // min(20 * ranges, MOST_SAMPLES))
    some = F.filter("captures", lambda c, k: F.pmod(k + F.col("archive"), F.lit(step)) == 0)
    rows = archives.select("archive", F.explode(some).alias("c")).select("archive", "c.offset", "c.url_key", "c.time", "c.page_id").toLocalIterator()
    keys = sorted(_key(tuple(r)) for r in rows)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def segments(archives: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Each archive, read and cut at the borders: range, run (the task that wrote it), archive and segment (an Arrow stream of `ROW`)."""
    sent = archives.sparkSession.sparkContext.broadcast(cuts)  # one border for MERGE_ROWS captures

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        def close(at: int, archive: int, rows: list[tuple]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for k in range(0, len(rows), 1000):
                    out.write_batch(_batch(rows[k : k + 1000]))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([archive >> 24]), pa.array([archive]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range", "run", "archive", "segment"])

        for batch in batches:
            for archive, content, captures in zip(*(batch.column(c) for c in ("archive", "content", "captures"))):
                archive, at, rows = archive.as_py(), 0, []
                for row in captures_of(archive, content.as_py(), captures.as_py()):
                    new = bisect.bisect_right(sent.value, _key(row))
                    if new != at and rows:
                        yield close(at, archive, rows)
                        rows = []
                    at = new
                    rows.append(row)
                if rows:
                    yield close(at, archive, rows)

    return archives.mapInArrow(cut, "range long, run long, archive long, segment binary")


def _stream(parts: list[bytes]) -> Iterator[tuple[tuple, tuple]]:
    """Keys and rows of a run's segments, one after the other."""
    for part in parts:
        for batch in pa.ipc.open_stream(pa.py_buffer(part)):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield _key(row), row


def merge_index(archives: DataFrame) -> DataFrame:
    """Every capture in the archives (`ROW`) in the order of url_key, time, page_id, range after range."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(runs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            rows = []
            for _, row in LoserTree([_stream(parts) for parts in runs.values()]):
                rows.append(row)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        at, runs = None, {}
        for batch in batches:
            for number, run, segment in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "segment"))):
                if number != at:
                    yield from merged(runs)
                    at, runs = number, {}
                runs.setdefault(run, []).append(segment)
        yield from merged(runs)

    cuts = borders(archives)
    found = durable(segments(archives, cuts))
    return found.repartitionByRange(len(cuts) + 1, "range").sortWithinPartitions("range", "run", "archive").mapInArrow(merge, ROW)


def capture_history(pages: DataFrame) -> DataFrame:
    """Archives of the pages are written and read back; their captures, in order over the whole collection."""
    return merge_index(write_archives(plan_records(pages)))


def export(archives: DataFrame, folder: str) -> int:
    """Writes each archive as a .warc.gz file below a folder that pyarrow's file systems reach; returns how many. A file is renamed into place once it is whole."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(path, recursive=True)
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                name = f"{path}/{archive:016d}.warc.gz"
                with store.open_output_stream(f"{name}.part") as f:
                    f.write(content)
                store.move(f"{name}.part", name)
            yield batch.select(["archive"])

    return archives.select("archive", "content").mapInArrow(put, "archive long").count()


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM s WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT s.page_id, payload_bytes, s.payload_digest, CASE WHEN keeper IS NOT NULL AND s.page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND s.page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM s LEFT JOIN k ON s.payload_digest = k.payload_digest AND payload_bytes >= {REVISIT_BYTES}
"""
