"""As-of lookups: of each point in an order the latest mark at or before it.

The order is dealt into stretches; inside one the latest mark runs along, and what a stretch begins
with is the last mark of those before it, from a table of one row a stretch. No task sees the whole
order, and no point meets more than one mark.

Cases: points before every mark have none (null); of marks at one place the greatest counts; null
places have none; several points at one place each get theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def as_of(points: DataFrame, marks: DataFrame, seq: str, mark: str, at: str | None = None) -> DataFrame:
    """points with `mark`, a column of marks (seq, mark), as of their own seq (`at`, if it has another name there)."""
    own = at or seq
    stretch = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    there = marks.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("_seq"), F.struct(F.col(seq).cast("long").alias("at"), F.col(mark).alias("mark")).alias("_mark"))
    lasts = there.groupBy(stretch("_seq").alias("_s")).agg(F.max("_mark").alias("_last"))
    rows = points.select(F.col(own).cast("long").alias("_seq"), F.struct(*points.columns).alias("_point"))
    both = rows.withColumn("_mark", F.lit(None).cast(there.schema["_mark"].dataType)).unionByName(there.withColumn("_point", F.lit(None).cast(rows.schema["_point"].dataType)))
    both = both.withColumn("_s", stretch("_seq"))
    run = Window.partitionBy("_s").orderBy("_seq", F.col("_point").isNotNull(), "_mark").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_here", F.last("_mark", ignorenulls=True).over(run)).where("_point is not null")
    every = both.where("_seq is not null").select("_s").distinct().join(lasts, "_s", "left")
    before = every.select("_s", F.last("_last", ignorenulls=True).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a stretch
    found = F.when(F.col("_seq").isNotNull(), F.coalesce("_here", "_before"))
    return met.join(before, "_s", "left").select("_point.*", found["mark"].alias(mark))
