"""A streaming source that follows one growing log file by byte offset.

Only whole lines are read; what follows the last line feed waits. A file that got shorter is read
from its start again. The file is read on the driver and its lines are dealt out from there, a batch
of at most `max_bytes` at a time; folders of finished files go through Spark's own file source.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

MAX_BYTES = 8 << 20


def read_new_lines(path: str, offset: int, max_bytes: int = MAX_BYTES) -> tuple[list[tuple[int, str]], int]:
    """(offset, line) of the whole lines from an offset on, and the offset to go on from."""
    try:
        size = os.path.getsize(path)
    except OSError:
        return [], 0
    if size < offset:
        offset = 0
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(max_bytes)
        while b"\n" not in data and (more := f.read(max_bytes)):
            data += more
    whole = data[: data.rfind(b"\n") + 1]
    out, at = [], offset
    for line in whole.splitlines(keepends=True) if b"\r" not in whole else [x + b"\n" for x in whole.split(b"\n")[:-1]]:
        text = line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line
        out.append((at, text.decode("utf-8", "replace").rstrip("\r\n")))
        at += len(line)
    return out, at


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines, end = read_new_lines(self.path, start["offset"], self.max_bytes)
        return iter(lines), {"offset": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        first = start["offset"] if end["offset"] >= start["offset"] else 0
        lines, _ = read_new_lines(self.path, first, max(1, end["offset"] - first))
        return iter([x for x in lines if x[0] < end["offset"]])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("specloom_tail").load(path): entry_seq (the line's offset) and value."""

    @classmethod
    def name(cls) -> str:
        return "specloom_tail"

    def schema(self) -> str:
        return "entry_seq long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)))


def tail(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("specloom_tail").load(path)
