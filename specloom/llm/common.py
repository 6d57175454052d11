"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once inside a Python worker.
CHUNK_BYTES = 4 << 20
#: Rows that a worker gets at once (a longer row alone): a batch stands in the executor's memory and in the worker's besides.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "specloom-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers about `BATCH_BYTES` of rows at once (Spark's default is 64 MB, of 10,000 rows at most), unless it is set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    give_back()  # what the driver's Python has freed since
    return df.checkpoint(eager=True)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of any table that has them, whatever else it has."""
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"), *[df[c] for c in more])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over the whole table (one pass over that column)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def held_out(fold: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves `remainder` by `fold`; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == remainder, F.lit(False))


#: A key is heavy with over one in so many of all rows (so there are fewer heavy keys than this), and over so many rows.
HEAVY_SHARE, HEAVY_ROWS = 10_000, 1_000


def lookup(rows: DataFrame, known: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns that `known` (one row a key, `count` of which are in rows) has for their key; null where it has none.

    Keys with over 1/`HEAVY_SHARE` of the `total` rows are fewer than that by definition: they are
    broadcast, and their rows spread over the join of the others, so no key fills a task.
    """
    names = [c for c in known.columns if c not in (key, count)]
    heavy = F.col(count) > max(HEAVY_ROWS, total // HEAVY_SHARE)
    hot = known.where(heavy).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    cold = known.where(~heavy).select(F.col(key).alias("_cold"), F.lit(0).alias("_kind"), *[F.col(c).alias(f"_cold_{c}") for c in names])
    marked = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left")
    is_hot = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_mine", F.when(is_hot, F.monotonically_increasing_id().cast(rows.schema[key].dataType)).otherwise(F.col(key))).withColumn("_sort", is_hot.cast("int"))
    met = marked.join(cold, (F.col("_mine") == F.col("_cold")) & (F.col("_sort") == F.col("_kind")), "left")
    return met.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in names])


def draw(keys: DataFrame, label: str, most: int, labels: int, in_all: int) -> DataFrame:
    """At most `most` doc_ids of each label (a column of keys), those of the least hash; `in_all` over the `labels` commonest labels, and none of others.

    Counts set a bar for the hash first, so what a label sends to be ordered is about four times
    what is taken of it, however many rows it has.
    """
    keys = keys.select(label, "doc_id").where(f"{label} is not null and doc_id is not null").withColumn("_h", F.xxhash64("doc_id"))
    counted = keys.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(labels).collect()  # `labels` rows at most
    most = max(1, min(most, in_all // max(1, len(counted))))
    bars = [(r[label], -(1 << 63) + int((1 << 64) * min(1.0, 4 * (most + 16) / r["n"])) - 1) for r in counted]
    bar = keys.sparkSession.createDataFrame(bars, T.StructType([keys.schema[label], T.StructField("_bar", T.LongType())]))
    few = keys.join(F.broadcast(bar), label).where("_h <= _bar").groupBy(label, "doc_id").agg(F.first("_h").alias("_h"))
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", "doc_id"))).where(F.col("_r") <= most).select(label, "doc_id")


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return None


def give_back() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks, several to an executor, and what each keeps adds up."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    give_back()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
