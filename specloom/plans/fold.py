"""Tables folded into OpenAPI documents: the reverse of flattening, in Spark, of any number of APIs at once.

`schemas` folds the rows of fields (a row a node, with its parent) bottom-up: at each level the nodes'
JSON is made from their own row and their children's JSON, grouped by parent. `operations` folds
parameters, bodies and responses into operations, `documents` operations into paths and documents.
Rows carry `doc`, the name of their API. Every group is of a document's size, never of a log's.

Cases: an API without endpoints has no document; a field without types is `{}`; a name with a dot in
it is folded where its parent says; endpoints without responses get `default`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import operation_id
from ..functions.text import quoted
from ..operators.reads import method_rank
from ..scratch import scratch
from .render import status_phrase

KEY = ["doc", "method", "template"]
NODE = [*KEY, "scope", "path"]


def json_object(*members: tuple[str, Column]) -> Column:
    """An object of (name, JSON); members that are null are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{name}":'), value) for name, value in members])), ","), F.lit("}"))


def _members(rows: DataFrame, by: list[str], name: Column, value: Column, alias: str, order: Column | None = None) -> DataFrame:
    """by and an object (JSON) of all (name, value) of a group, by name or `order`."""
    at = name if order is None else order
    pairs = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.concat(quoted(name), F.lit(":"), value).alias("member"))))
    return rows.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["member"]), ","), F.lit("}")).alias(alias))


def _node(r) -> Column:
    """A node's JSON from its row; `_props`, `_needed` and `_items` are of its children."""
    array = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    enum = F.when(F.col("nullable"), F.regexp_replace(F.to_json("enum"), "\\]$", ",null]")).otherwise(F.to_json("enum"))
    of = {
        "object": [("properties", F.coalesce("_props", F.lit("{}"))), ("additionalProperties", F.lit("false")), ("required", array("_needed"))],
        "array": [("items", F.coalesce("_items", F.lit("{}")))],
        "string": [("format", quoted(F.col("format")))],
        "integer": [("x-observed-range", F.when(F.col("lo").isNotNull(), F.concat(F.lit("["), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("]")))), ("minimum", F.col("minimum").cast("string"))],
    }
    lone = F.size("types") == 1
    inner = lambda kind, *more: F.concat_ws(",", F.lit(f'"type":"{kind}"'), *[F.concat(F.lit(f'"{n}":'), v) for n, v in [*of.get(kind, []), *more]])
    branch = lambda kind, *more: F.when(F.array_contains("types", kind), inner(kind, *more))
    kinds = ["array", "boolean", "integer", "number", "object", "string"]
    single = F.coalesce(*[branch(k, *([("enum", enum)] if k == "string" else [])) for k in kinds])
    several = F.concat(F.lit('"anyOf":['), F.array_join(F.transform(F.array_compact(F.array(*[branch(k, *([("enum", F.to_json("enum"))] if k == "string" else [])) for k in kinds])), lambda b: F.concat(F.lit("{"), b, F.lit("}"))), ","), F.lit("]"))
    ambiguity = F.when(F.size("ambiguity") == 1, quoted(F.get("ambiguity", F.lit(0)))).when(F.size("ambiguity") > 1, F.to_json("ambiguity"))
    field = ~F.col("path").endswith("[]") & (F.col("path") != "")
    extras = [
        ("nullable", F.when(F.col("nullable"), F.lit("true"))), ("x-null-rate", F.when(F.col("nullable"), F.col("null_rate").cast("string"))), ("x-presence", F.when(field, F.col("presence_lb").cast("string"))),
        ("x-confidence", quoted(F.col("confidence"))), ("x-aliases", array("aliases")), ("x-enum-confidence", F.col("enum_confidence").cast("string")), ("x-ambiguity", ambiguity),
        ("x-observed-types", F.when(F.size("observed_types") > F.size("types"), F.to_json("observed_types"))),
    ]
    body = F.when(lone, single).when(F.size("types") > 1, several)
    return F.concat(F.lit("{"), F.concat_ws(",", body, *[F.concat(F.lit(f'"{n}":'), v) for n, v in extras]), F.lit("}"))


def schemas(fields: DataFrame) -> DataFrame:
    """doc, method, template, scope and schema (JSON) of every scope of fields (doc and the columns of `profile.field_profile`)."""
    rows = fields.withColumn("_level", F.length(F.regexp_replace("path", "\\[\\]|[^.\\[\\]]", "")) + F.size(F.split("path", "\\[\\]")) + F.when(F.col("path") == "", 0).otherwise(1))
    deepest = rows.agg(F.max("_level")).first()[0] or 0
    up = [*KEY, "scope", F.col("parent").alias("path")]
    done, home = None, scratch(fields.sparkSession, "fold")
    for level in range(deepest, -1, -1):
        here = rows.where(F.col("_level") == level)
        if done is None:
            here = here.withColumns({"_props": F.lit(None).cast("string"), "_needed": F.lit(None).cast("array<string>"), "_items": F.lit(None).cast("string")})
        else:
            name = F.when(F.col("parent") == "", F.col("path")).otherwise(F.expr("substring(path, length(parent) + 2)"))
            props = done.where("not endswith(path, '[]')").withColumn("_name", name)
            named = _members(props, [*KEY, "scope", "parent"], F.col("_name"), F.col("json"), "_props")
            needed = props.where("required").groupBy(*KEY, "scope", "parent").agg(F.array_sort(F.collect_list("_name")).alias("_needed"))
            items = done.where("endswith(path, '[]')").select(*up, F.col("json").alias("_items"))
            to = lambda df, c: df.select(*up, c)
            here = here.join(to(named, "_props"), NODE, "left").join(to(needed, "_needed"), NODE, "left").join(items, NODE, "left")
        json = here.select(*NODE, "parent", "required", _node(here).alias("json"))
        folder = f"{home}/{level}"  # written: the next level's plan starts there
        waiting = json if done is None else done.join(here.select(*KEY, "scope", F.col("path").alias("parent")), [*KEY, "scope", "parent"], "left_anti").select(*json.columns).unionByName(json)
        waiting.write.parquet(folder)
        done = fields.sparkSession.read.schema(json.schema).parquet(folder)
    return done.where("path = ''").select(*KEY, "scope", F.col("json").alias("schema"))


def _content(schema: Column, example: Column | None = None) -> Column:
    return json_object(("application/json", json_object(("schema", schema), *([("example", example)] if example is not None else []))))


def operations(endpoints: DataFrame, bodies: DataFrame, params: DataFrame, examples: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """doc, method, template and op (JSON) of every endpoint. bodies: of `schemas`; params: name, location, type, required, place."""
    phrase = F.create_map(*[F.lit(x) for k in range(100, 600) if (p := status_phrase(k)) != f"Status {k}" for x in (str(k), p)])
    said = lambda status: quoted(F.coalesce(F.try_element_at(phrase, status), F.concat(F.lit("Status "), status)))
    answers = endpoints.select(*KEY, F.explode(F.col("statuses").cast("array<string>")).alias("scope")).join(bodies, [*KEY, "scope"], "left").join(examples.select(*KEY, F.col("status").cast("string").alias("scope"), "example"), [*KEY, "scope"], "left")
    content = F.when(F.col("schema").isNotNull(), _content(F.col("schema"), F.col("example")))
    answers = answers.select(*KEY, F.col("scope").alias("status"), json_object(("description", said(F.col("scope"))), ("content", content)).alias("answer"))
    if inferred is not None:
        guess = inferred.select(*KEY, F.col("status").cast("string").alias("status"), "evidence", "confidence", *(["example", "envelope"] if "example" in inferred.columns else []))
        shown = F.when(F.col("envelope").isNotNull(), _content(F.col("envelope"), F.col("example"))) if "example" in guess.columns else F.lit(None).cast("string")
        guess = guess.select(*KEY, "status", json_object(("description", said(F.col("status"))), ("x-inferred", F.lit("true")), ("x-evidence", quoted(F.col("evidence"))), ("x-confidence", quoted(F.col("confidence"))), ("content", shown)).alias("answer"))
        answers = answers.unionByName(guess.join(answers, [*KEY, "status"], "left_anti"))
    responses = _members(answers, KEY, F.col("status"), F.col("answer"), "responses")
    kind = F.when(F.col("type") == "string/uuid", F.lit('{"type":"string","format":"uuid"}')).otherwise(json_object(("type", quoted(F.col("type")))))
    param = json_object(("name", quoted(F.col("name"))), ("in", quoted(F.col("location"))), ("required", F.col("required").cast("string")), ("schema", kind))
    listed = F.array_sort(F.collect_list(F.struct("location", "place", "name", param.alias("p"))))
    parameters = params.groupBy(*KEY).agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda p: p["p"]), ","), F.lit("]")).alias("parameters"))
    asked = bodies.where("scope = 'request'").select(*KEY, F.col("schema").alias("asked"))
    ids = endpoints.select(*KEY, operation_id(F.col("method"), F.col("template")).alias("_id"))
    order = F.row_number().over(Window.partitionBy("doc", "_id").orderBy("template", method_rank(F.col("method")), "method"))
    ids = ids.withColumn("_k", order).select(*KEY, F.when(F.col("_k") == 1, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_k").cast("string"))).alias("_id"))
    tag = F.coalesce(F.get(F.filter(F.split("template", "/"), lambda p: (p != "") & ~p.startswith("{")), F.lit(0)), F.lit("root"))
    rows = endpoints.join(ids, KEY).join(responses, KEY, "left").join(parameters, KEY, "left").join(asked, KEY, "left")
    text = lambda c: F.when(F.col(c) != "", quoted(F.col(c)))
    op = json_object(
        ("operationId", quoted(F.col("_id"))), ("tags", F.to_json(F.array(tag))), ("responses", F.coalesce("responses", F.lit('{"default":{"description":"No response observed"}}'))),
        ("x-sample-count", F.col("sample_count").cast("string")), ("x-first-seen", text("first_seen")), ("x-last-seen", text("last_seen")), ("x-api-version", text("api_version")), ("parameters", F.col("parameters")),
        ("requestBody", F.when(F.col("asked").isNotNull(), json_object(("required", F.coalesce("request_required", F.lit(False)).cast("string")), ("content", _content(F.col("asked")))))),
        ("security", F.when(F.col("auth_rate") >= 0.5, F.lit('[{"bearerAuth":[]}]'))),
    )
    return rows.select(*KEY, op.alias("op"), (F.coalesce("auth_rate", F.lit(0.0)) >= 0.5).alias("secured"))


def documents(ops: DataFrame) -> DataFrame:
    """doc and spec (JSON), a row an API; ops: of `operations`."""
    items = _members(ops, ["doc", "template"], F.lower("method"), F.col("op"), "item", method_rank(F.col("method")))
    paths = _members(items, ["doc"], F.col("template"), F.col("item"), "paths")
    secured = ops.groupBy("doc").agg(F.bool_or("secured").alias("secured"))
    scheme = F.when(F.col("secured"), F.lit('{"securitySchemes":{"bearerAuth":{"type":"http","scheme":"bearer"}}}'))
    info = json_object(("title", quoted(F.col("doc"))), ("version", F.lit('"1.0.0"')))
    return paths.join(secured, "doc").select("doc", json_object(("openapi", F.lit('"3.0.3"')), ("info", info), ("paths", F.col("paths")), ("components", scheme)).alias("spec"))


def contract_document(contract, title: str = "Observed API") -> DataFrame:
    """doc and spec of a contract (`build.Contract`)."""
    named = lambda df: df.withColumn("doc", F.lit(title))
    path = contract.path_params.select("method", "template", "name", F.lit("path").alias("location"), "type", F.lit(True).alias("required"), F.col("place").cast("long").alias("place"))
    query = contract.query_params.select("method", "template", "name", F.lit("query").alias("location"), "type", "required", F.col("first").alias("place"))
    inferred = None if contract.inferred is None else named(contract.inferred)
    return documents(operations(named(contract.endpoints), schemas(named(contract.profile)), named(path.unionByName(query)), named(contract.examples), inferred))
