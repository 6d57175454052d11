"""The aggregates of a contract as tables that merge: of a batch, of several, or of a whole log.

A part is one row a key with counts, extremes, conjunctions and bounded sets. Merging is a union and
the same aggregation again, so parts of any split of a log, in any order, merge to the parts of the
whole, and a contract of merged parts is the contract of all entries. Values that are no longer few
overflow to `many` and are dropped: a batch costs its own size and the contract's, never the log's.

Cases: a part without rows merges to the other; a field that is in one part alone keeps its counts.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import endpoints as E
from ..operators import profile as P
from ..operators.observe import KEY, SCOPE

_SUMS = ["n", "seen", "nulls", "texts", "auth", "n_all", "n_ok", "calls", *[f"n_{t}" for t in P.TYPES]]
_LEAST = ["lo", "first_seen", "first", "place", "versioned", "example"]
_MOST = ["hi", "last_seen"]
_ALL = ["plain", "bodies", "digits", "uuids", *[f"is_{f}" for f in P.FORMATS], *[f"{k}_{tag}" for k in E.VALUE_TYPES for tag in ("all", "ok")]]
_ANY = ["many"]
_SETS = ["statuses"]


def _merged(name: str) -> Column:
    """What a column of a part becomes where two meet."""
    c = F.col(f"`{name}`")
    for names, merge in ((_SUMS, F.sum), (_LEAST, F.min), (_MOST, F.max), (_ALL, F.bool_and), (_ANY, F.bool_or)):
        if name in names:
            return merge(c).alias(name)
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(name)  # of sets, one a part


@dataclass
class Parts:
    """The tables, each with its keys; the rest of its columns merge by their names."""

    endpoints: DataFrame
    fields: DataFrame
    texts: DataFrame
    values: DataFrame
    spellings: DataFrame
    examples: DataFrame
    path_params: DataFrame
    query_params: DataFrame
    key_sets: DataFrame

    def write(self, folder: str) -> Parts:
        """The tables, written below a folder and read again."""
        for t in fields(self):
            getattr(self, t.name).write.mode("overwrite").parquet(f"{folder}/{t.name}")
        return read_parts(self.endpoints.sparkSession, folder)


#: What a row of each table is of.
KEYS = {
    "endpoints": [*KEY, "names"], "fields": [*SCOPE, "parent", "path"], "texts": [*SCOPE, "path"], "values": [*SCOPE, "path", "text"], "spellings": [*SCOPE, "path", "raw_key"],
    "examples": [*KEY, "status"], "path_params": [*KEY, "name"], "query_params": [*KEY, "name"], "key_sets": [*SCOPE, "keys"],
}


def read_parts(spark: SparkSession, folder: str) -> Parts:
    return Parts(**{t.name: spark.read.parquet(f"{folder}/{t.name}") for t in fields(Parts)})


def parts_of(entries: DataFrame, observed: DataFrame) -> Parts:
    """The parts of some entries (with their templates) and what was observed of their bodies."""
    texts, values = P.text_parts(observed)
    return Parts(
        E.endpoint_parts(entries), P.field_parts(observed), texts, values, P.spelling_parts(observed), E.example_parts(entries), E.path_param_parts(entries), E.query_param_parts(entries), E.key_sets(entries)
    )


def merge(parts: list[Parts]) -> Parts:
    """What parts add up to: one union and one aggregation a table, however many parts there are."""

    def table(name: str) -> DataFrame:
        every = reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
        return every.groupBy(*KEYS[name]).agg(*[_merged(c) for c in every.columns if c not in KEYS[name]])

    out = Parts(**{t.name: table(t.name) for t in fields(Parts)})
    over = out.values.groupBy(*SCOPE, "path").agg((F.count("*") > P.ENUM_VALUES).alias("_over"))
    out.texts = out.texts.join(over, [*SCOPE, "path"], "left").withColumn("many", F.col("many") | F.coalesce("_over", F.lit(False))).drop("_over")
    out.values = P.few_values(out.texts, out.values)
    return out
