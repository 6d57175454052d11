"""From log entries to observations of every value in their bodies.

Bodies nested up to `INLINE` levels come apart with VARIANT functions, level by level inside their row.
Deeper ones, which are few, are walked whole in Arrow batches: the plan stays the same however deep a
single line goes, and both ways give the same rows.

Cases: what is no JSON has no observations; of a doubled key the last value counts (the session is set
to read them so).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_template
from ..functions.text import canonical_key

KEY = ["method", "template"]
SCOPE = [*KEY, "scope"]


def with_template(entries: DataFrame) -> DataFrame:
    """entries with template and params of their paths; as they are if they have them."""
    if {"template", "params"} <= {*entries.columns}:
        return entries
    return entries.withColumn("_t", path_template(F.col("path"))).withColumns({"template": F.col("_t.template"), "params": F.col("_t.params")}).drop("_t")


def is_success(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def bodies(entries: DataFrame) -> DataFrame:
    """One row a body: method, template, scope (the status, or `request` for requests that succeeded), entry_seq, body."""
    keyed = entries if "template" in entries.columns else with_template(entries)
    answer = F.when(F.col("response_body").isNotNull(), F.struct(F.col("status").cast("string").alias("scope"), F.col("response_body").alias("body")))
    request = F.when(F.col("request_body").isNotNull() & is_success(F.col("status")), F.struct(F.lit("request").alias("scope"), F.col("request_body").alias("body")))
    return keyed.select(*KEY, "entry_seq", F.explode(F.array_compact(F.array(answer, request))).alias("b")).select(*KEY, "b.scope", "entry_seq", "b.body")


def depth_of(text: Column) -> Column:
    """How deep the brackets of a JSON text nest."""
    bare = F.regexp_replace(F.regexp_replace(text, '"(\\\\.|[^"\\\\])*"', ""), "[^\\[\\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, c):
        now = a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, step, lambda a: a["most"])


def type_of(v: Column) -> Column:
    """JSON Schema type of a VARIANT; 1.0 is a number, 1 an integer."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer").when(s == "STRING", "string")
        .when(s.rlike("^DECIMAL\\((19|[23][0-9]),0\\)"), "integer").otherwise("number")
    )


#: Levels that the plan holds.
INLINE = 8
OBSERVATION = ["path", "parent", "raw_key", "type", "text", "int_value"]


def _canonical(key: str) -> str:
    """As `functions.text.canonical_key`."""
    snake = re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("(.)([A-Z][a-z]+)", r"\1_\2", key))
    return re.sub("^_+|_+$", "", re.sub("[- ]", "_", snake).lower()) or key


def _observation(path: str, parent: str | None, raw: str | None, value) -> tuple:
    """As the columns do: integers up to 38 digits are integers, larger ones numbers."""
    if isinstance(value, bool) or value is None or isinstance(value, (dict, list, str)):
        kind = {bool: "boolean", dict: "object", list: "array", str: "string"}.get(type(value), "null")
        return path, parent, raw, kind, value if kind == "string" else None, None
    whole = isinstance(value, int) and abs(value) < 10**38
    return path, parent, raw, "integer" if whole else "number", None, value if whole and -(1 << 63) <= value < 1 << 63 else None


def values_in(text: str) -> Iterator[tuple]:
    """Every value of a body (JSON), however deep: `OBSERVATION`."""
    try:
        left = [("", None, None, json.loads(text))]
    except (ValueError, RecursionError):
        return
    while left:
        path, parent, raw, value = left.pop()
        yield _observation(path, parent, raw, value)
        if isinstance(value, dict):
            left += [(f"{path}.{_canonical(k)}" if path else _canonical(k), path, k, v) for k, v in value.items()]
        elif isinstance(value, list):
            left += [(f"{path}[]", path, None, v) for v in value]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.string()] * 5, pa.int64()]
    for batch in batches:
        for k, text in enumerate(batch.column("body").to_pylist()):
            found = list(values_in(text))
            if found:
                keys = [pa.array([batch.column(c)[k].as_py()] * len(found), batch.schema.field(c).type) for c in (*SCOPE, "entry_seq")]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(own, kind) for own, kind in zip(zip(*found), kinds)]], names=[*SCOPE, "entry_seq", *OBSERVATION])


def observe(body_rows: DataFrame, depth: int | None = None) -> DataFrame:
    """Every value of every body: the scope, entry_seq, path (canonical keys joined by dots, [] for items), parent, raw_key, type, text, int_value.

    depth: of the deepest body, where it is known; else one pass over the texts finds out.
    """
    body_rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if depth is None:
        depth = body_rows.agg(F.max(depth_of(F.col("body")))).first()[0] or 0
    if depth > INLINE:
        deep = depth_of(F.col("body")) > INLINE
        keys = [f"`{c}` {t}" for c, t in body_rows.select(*SCOPE, "entry_seq").dtypes]
        walked = body_rows.where(deep).select(*SCOPE, "entry_seq", "body").mapInArrow(_walk, ", ".join([*keys, *(f"{c} string" for c in OBSERVATION[:-1]), "int_value long"]))
        return observe(body_rows.where(~deep), INLINE).unionByName(walked)
    node = "struct<path:string,parent:string,raw_key:string,v:variant>"

    def inner(n: Column) -> Column:
        """The values right below a value."""
        canon = lambda e: F.when(n["path"] == "", canonical_key(e["key"])).otherwise(F.concat_ws(".", n["path"], canonical_key(e["key"])))
        keys = F.transform(F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>")), lambda e: F.struct(canon(e).alias("path"), n["path"].alias("parent"), e["key"].alias("raw_key"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(n["v"], "$", "array<variant>"), lambda v: F.struct(F.concat(n["path"], F.lit("[]")).alias("path"), n["path"].alias("parent"), F.lit(None).cast("string").alias("raw_key"), v.alias("v")))
        return F.coalesce(keys, items, F.array().cast(f"array<{node}>"))

    root = F.struct(F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("raw_key"), F.col("v").alias("v"))
    rows = body_rows.select(*SCOPE, "entry_seq", F.try_parse_json("body").alias("v")).where("v is not null").withColumn("_0", F.array(root.cast(node)))
    for k in range(depth):  # each level is a column that the next reads: a body is parsed once and its values come out of one explode
        rows = rows.withColumn(f"_{k + 1}", F.flatten(F.transform(f"_{k}", inner)))
    out = rows.select(*SCOPE, "entry_seq", F.explode(F.concat(*[f"_{k}" for k in range(depth + 1)])).alias("o")).select(*SCOPE, "entry_seq", "o.*")
    out = out.withColumn("type", type_of(F.col("v")))
    return out.select(*SCOPE, "entry_seq", "path", "parent", "raw_key", "type", F.when(F.col("type") == "string", F.try_variant_get("v", "$", "string")).alias("text"), F.when(F.col("type") == "integer", F.try_variant_get("v", "$", "long")).alias("int_value"))


def present_paths(observed: DataFrame) -> DataFrame:
    """Distinct paths of each body, nulls included; [] once for non-empty arrays."""
    return observed.where("path <> ''").select(*SCOPE, "entry_seq", "path").distinct()
