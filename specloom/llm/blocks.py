"""Questions that blocks of documents ask of the whole corpus.

Rows are packed into blocks of some megabytes of text (an Arrow stream, compressed), dealt out
once. A block then asks: it sends compact messages to shards by key; a shard sees what all blocks
sent under its keys and answers each block; the answers meet their block again by an equi-join.
Within a block equal keys are merged before anything is sent, so a key that is everywhere costs a
shard one entry a block. The dealt blocks are one exchange of the plan, read again by every step.

Blocks and shards are dealt into partitions by the size of the text (`PART_BYTES` each, and no
fewer than spark.sql.shuffle.partitions), so a task reads about as much however large the corpus is.
A block is named by its task and place in it. Where a lost task would read its rows in another
order (behind an exchange), the rows are made durable first: blocks come out the same again.

Cases: a table without rows has no blocks; a text longer than a block is a block of its own; rows
may have any columns beside a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, raw_texts

BLOCK_BYTES, PART_BYTES = 6 << 20, 64 << 20
Emit = Callable[[pa.Table, dict[int, bytes]], Iterator[tuple[int, bytes]]]
Reduce = Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]
Finish = Callable[[pa.Table, dict[int, bytes]], Iterator[pa.RecordBatch]]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; open it with unsqueeze."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = ";".join(f"{a.dtype.str},{a.size}" for a in parts).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"%d\n" % len(head) + head + b"".join(a.tobytes() for a in parts))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, _, _ = raw.partition(b"\n")
    at, out = len(n) + 1 + int(n), []
    for spec in raw[len(n) + 1 : at].decode().split(";"):
        kind, size = spec.split(",")
        out.append(np.frombuffer(raw, np.dtype(kind), int(size), at))
        at += out[-1].nbytes
    return out


def parts_for(df: DataFrame, total_bytes: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // PART_BYTES))


def replays(df: DataFrame) -> bool:
    """Whether a task that runs again reads the same rows in the same order: scans do."""
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def pack(df: DataFrame, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df (with a text) as blocks: block (a number) and payload."""
    df = df if replays(df) else durable(df)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            sizes = np.fromiter((len(t) for t in raw_texts(batch.column("text"))), np.int64, batch.num_rows)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                size += n + 64
                if size >= block_bytes:
                    held.append(batch.slice(start, i + 1 - start))
                    yield close()
                    start, held, size, count = i + 1, [], 0, count + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield close()
        held = []
        give_back()

    return df.mapInArrow(write, "block long, payload binary").repartition(parts, "block")


def shards_for(total_bytes: int, each: int) -> int:
    return max(1, total_bytes // each)


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def _told(row: list | None) -> dict[int, bytes]:
    return {x["shard"]: x["answer"] for x in row or []}


def ask(blocks: DataFrame, emit: Emit, reduce: Reduce, parts: int) -> DataFrame:
    """block and what the shards answered to it. blocks may have answers of an earlier question."""
    return gather(answers(blocks, emit, reduce, parts), parts)


def gather(told: DataFrame, parts: int) -> DataFrame:
    """Rows (block, shard, answer) as one row a block; dealt as the blocks are."""
    return told.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))


def answers(blocks: DataFrame, emit: Emit, reduce: Reduce, parts: int) -> DataFrame:
    """block, shard and answer of each message that got one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                told = _told(batch.column("answers")[k].as_py()) if "answers" in batch.schema.names else {}
                sent = list(emit(_unpack(batch.column("payload")[k].as_py()), told))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sent], pa.int64()), pa.array([block] * len(sent), pa.int64()), pa.array([m for _, m in sent], pa.binary())], names=["shard", "block", "message"])
        give_back()

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        found = list(reduce(sorted(zip(group.column("block").to_pylist(), group.column("message").to_pylist()))))
        give_back()
        return pa.table({"block": pa.array([b for b, _ in found], pa.int64()), "shard": pa.array([key[0].as_py()] * len(found), pa.int64()), "answer": pa.array([a for _, a in found], pa.binary())})

    sent = blocks.mapInArrow(send, "shard long, block long, message binary")
    return sent.repartition(parts, "shard").groupBy("shard").applyInArrow(answer, "block long, shard long, answer binary")


def meet(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.select("block", "payload").join(answers, "block", "left")


def finish(met: DataFrame, last: Finish, schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from last(_unpack(batch.column("payload")[k].as_py()), _told(batch.column("answers")[k].as_py()))
        give_back()

    return met.mapInArrow(run, schema)
