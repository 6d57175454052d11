"""Read queries over a contract and its change log: listings, summaries and bounded tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which an endpoint's methods are listed.
METHOD_ORDER = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE"]


def method_rank(method: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, METHOD_ORDER)), method)
    return F.when(at == 0, len(METHOD_ORDER) + 1).otherwise(at)


def endpoint_listing(endpoints: DataFrame) -> DataFrame:
    """Endpoints by path and the usual order of methods."""
    return endpoints.orderBy("template", method_rank(F.col("method")), "method").select("method", "template", "statuses", "sample_count")


def summary(changes: DataFrame) -> DataFrame:
    """One row: how many changes, how many of them breaking, and when the last was found."""
    return changes.agg(F.count("*").alias("total_changes"), F.count_if("breaking").alias("breaking_changes"), F.max("detected_at").alias("last_updated"))


def release_listing(releases: DataFrame, files: DataFrame) -> DataFrame:
    """files (file, generated_at, size) with the release each documents (file, version, breaking); newest first."""
    return files.join(releases.select("file", "version", "breaking", "changes"), "file", "left").orderBy(F.desc("generated_at"), "file")


def tail_of(lines: DataFrame, seq: str, most_bytes: int) -> DataFrame:
    """The newest lines (seq, value) of at most `most_bytes` together, a line feed counted for each.

    A line has a byte at least, so no more than `most_bytes` lines can be in it: the newest so many
    are found by a bounded top-k, and only those are summed in one task.
    """
    few = lines.orderBy(F.desc(seq)).limit(most_bytes)
    sizes = F.sum(F.octet_length("value") + 1).over(Window.orderBy(F.desc(seq)))
    return few.withColumn("_sum", sizes).where(F.col("_sum") <= most_bytes).drop("_sum")
