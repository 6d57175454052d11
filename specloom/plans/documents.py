"""OpenAPI documents as tables, and their differences.

`docs` has one row a document: doc (its name) and spec (its JSON). Paths, operations, parameters and
responses come out with VARIANT functions; a schema, which nests as it likes, is walked whole by one
function over Arrow batches (`nodes`), to whatever depth and through anyOf inside anyOf.

Cases: what is no object, has no paths or names other methods gives no rows; a schema without a
type is unknown (no types) and differs from nothing; responses marked `x-inferred` are a guess and
take no part; statuses are texts (`default`, `2XX`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import diff

# The operations of a path item.
METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
KEY = ["doc", "method", "template"]
_BODY = "$.content['application/json'].schema"


def _object(v: Column, path: str = "$") -> Column:
    """The entries (key, value) of an object; none of anything else."""
    return F.coalesce(F.map_entries(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def operations(docs: DataFrame) -> DataFrame:
    """doc, method, template and op (a VARIANT) of every operation."""
    paths = docs.select("doc", F.explode(_object(F.try_parse_json("spec"), "$.paths")).alias("p"))
    items = paths.select("doc", F.col("p.key").alias("template"), F.explode(_object(F.col("p.value"))).alias("m")).where(F.col("m.key").isin(*METHODS))
    return items.select("doc", F.upper("m.key").alias("method"), "template", F.col("m.value").alias("op")).where(F.schema_of_variant("op").startswith("OBJECT"))


def statuses(ops: DataFrame) -> DataFrame:
    """doc, method, template, status (text) and answer of every observed response."""
    each = ops.select(*KEY, F.explode(_object(F.col("op"), "$.responses")).alias("r"))
    return each.where(~F.coalesce(F.try_variant_get("r.value", "$['x-inferred']", "boolean"), F.lit(False))).select(*KEY, F.col("r.key").alias("status"), F.col("r.value").alias("answer"))


def params(ops: DataFrame) -> DataFrame:
    """doc, method, template, location, name, type and required of every parameter; of one named twice the last."""
    each = ops.select(*KEY, F.posexplode(_items(F.col("op"), "$.parameters")).alias("k", "p"))
    text = lambda path: F.try_variant_get("p", path, "string")
    rows = each.select(*KEY, "k", text("$.in").alias("location"), text("$.name").alias("name"), diff.fmt_types(types_of(F.try_variant_get("p", "$.schema", "variant"))).alias("type"), F.coalesce(F.try_variant_get("p", "$.required", "boolean"), F.lit(False)).alias("required"))
    last = F.max_by(F.struct("type", "required"), "k").alias("l")
    return rows.where("location is not null and name is not null").groupBy(*KEY, "location", "name").agg(last).select(*KEY, "location", "name", "l.type", "l.required")


def types_in(schema) -> dict[str, dict]:
    """The types that a schema names, null apart, with the first schema of each: those of anyOf, of oneOf, then its own."""
    found: dict[str, dict] = {}
    left = [(schema, False)]
    while left:
        node, own = left.pop()
        if not isinstance(node, dict):
            continue
        if own:
            named = node.get("type")
            for kind in [named] if isinstance(named, str) else named if isinstance(named, list) else []:
                if isinstance(kind, str) and kind != "null":
                    found.setdefault(kind, node)
        else:
            parts = [part for word in ("anyOf", "oneOf") for part in (node[word] if isinstance(node.get(word), list) else [])]
            left += [(node, True), *((part, False) for part in reversed(parts))]
    return found


def walk(schema) -> Iterator[dict]:
    """Every node of a schema: path, parent, types, required and text (its description); the root's path is empty."""
    left = [("", None, False, schema)]
    while left:
        path, parent, required, node = left.pop()
        kinds = types_in(node)
        node = node if isinstance(node, dict) else {}
        text = node.get("description")
        yield {"path": path, "parent": parent, "types": sorted(kinds), "required": required, "text": text if isinstance(text, str) and text else None}
        own = kinds.get("object", {})
        if isinstance(props := own.get("properties"), dict):
            needed = own["required"] if isinstance(own.get("required"), list) else []
            left += [(f"{path}.{name}" if path else name, path, name in needed, child) for name, child in props.items()]
        if isinstance(items := kinds.get("array", {}).get("items"), dict):
            left.append((f"{path}[]", path, False, items))


_NODE = T.StructType([T.StructField("path", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("types", T.ArrayType(T.StringType())), T.StructField("required", T.BooleanType()), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_NODE))
def nodes(schemas: pd.Series) -> pd.Series:
    """The nodes of schemas (JSON); null of null."""
    return schemas.map(lambda text: None if text is None else list(walk(json.loads(text))))


def types_of(schema: Column) -> Column:
    """The types that a schema (a VARIANT) names, null apart, sorted; none of what is no schema."""
    return F.coalesce(F.get(nodes(F.to_json(schema)), F.lit(0))["types"], F.array().cast("array<string>"))


def fields(ops: DataFrame) -> DataFrame:
    """doc, method, template, scope (`request` or a status), path, parent, types and required of every schema node; the root's path is empty."""
    answers = statuses(ops).select(*KEY, F.col("status").alias("scope"), F.try_variant_get("answer", _BODY, "variant").alias("v"))
    asked = ops.select(*KEY, F.lit("request").alias("scope"), F.try_variant_get("op", f"$.requestBody{_BODY[1:]}", "variant").alias("v"))
    rows = answers.unionByName(asked).where(F.schema_of_variant("v").startswith("OBJECT"))
    found = rows.withColumn("n", nodes(F.to_json("v"))).select(*KEY, "scope", F.explode_outer("n").alias("o")).where("o is not null")  # a plain explode would have every schema walked twice, once for a filter on its size
    return found.select(*KEY, "scope", "o.path", "o.parent", "o.types", "o.required", "o.text")


def carry_over(new: DataFrame, old: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """new (fields) with the texts of the old document where a node has none of its own and is unchanged (same place, same types).

    rules (KEY, scope, path, text): what a rule would say; it is used where neither has a text.

    The joins are by merge: Spark takes the nodes of many documents for no more than the table that
    names them, and would send them all through the driver to every task.
    """
    place = [*KEY[1:], "scope", "path"]
    known = old.where("text is not null").select(*place, F.col("types").alias("_types"), F.col("text").alias("_old"))
    out = new.join(known.hint("merge"), place, "left").withColumn("_old", F.when(F.col("_types") == F.col("types"), F.col("_old")))
    said = [F.col("text"), F.col("_old")]
    if rules is not None:
        out = out.join(rules.select(*place, F.col("text").alias("_rule")).hint("merge"), place, "left")
        said.append(F.col("_rule"))
    return out.withColumn("text", F.coalesce(*said)).select(*new.columns)


def required_paths(found: DataFrame) -> DataFrame:
    """Fields that their parents require, under optional parents too; items are never required."""
    return found.where("required and not endswith(path, '[]')").select(*KEY, "scope", "path")


def schema_at(found: DataFrame, method: str, template: str, scope: str, path: str) -> DataFrame:
    return found.where((F.col("method") == method) & (F.col("template") == template) & (F.col("scope") == scope) & (F.col("path") == path))


def diff_documents(old: DataFrame, new: DataFrame, warm: DataFrame | None = None) -> DataFrame:
    """All changes (`diff.CHANGE`) from one document to the other; `old` and `new` have one row each (doc, spec).

    warm (method, template, scope: a status, `2xx` for request bodies, `*` for parameters) names
    what had enough samples when the old document was built: elsewhere new fields and parameters and
    changes of what is required are part of the baseline and are not reported.
    """
    a, b = operations(old).drop("doc").withColumn("doc", F.lit("d")), operations(new).drop("doc").withColumn("doc", F.lit("d"))
    key = [c for c in KEY if c != "doc"]
    out, ends = diff.diff_endpoints(a, b), diff.in_both(a, b)
    sides = [statuses(x).select(*key, F.col("status")) for x in (a, b)]
    out = out.unionByName(diff.diff_statuses(*sides, ends))
    out = out.unionByName(diff.diff_params(*(params(x).drop("doc") for x in (a, b)), warm, ends))
    both = [fields(x).drop("doc") for x in (a, b)]
    shared = sides[0].select(*key, F.col("status").alias("scope")).join(sides[1].select(*key, F.col("status").alias("scope")), [*key, "scope"]).distinct()
    asked = a.select(*key).join(b.select(*key), key).withColumn("scope", F.lit("request"))
    scopes = shared.unionByName(asked.distinct())
    bodies = [x.where("path = ''").join(scopes, [*key, "scope"], "left_semi") for x in both]
    return out.unionByName(diff.diff_bodies(*bodies, warm, ends)).unionByName(diff.diff_fields(*both, warm))
