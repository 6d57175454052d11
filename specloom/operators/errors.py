"""Error responses that traffic hasn't shown but its evidence supports: a small table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from .endpoints import endpoints
from .observe import KEY, SCOPE, bodies, is_success, observe, with_template
from .profile import field_profile

# What counts as evidence.
AUTH_SHARE = 0.5
UNIQUE_FIELDS = ["email", "sku", "username"]
STATE_FIELDS = ["status", "state"]


def error_envelope(observed: DataFrame) -> DataFrame:
    """Fields of all error bodies of the API with the share of errors that have them."""
    errors = observed.where(F.col("scope") != "request").where(F.col("scope").cast("int") >= 400)
    total = errors.where("path = ''").agg(F.count("*").alias("errors"))
    each = errors.where("path <> '' and instr(path, '.') = 0 and not endswith(path, '[]')").groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    return each.crossJoin(total).select("path", "types", "n", (F.col("n").cast("double") / F.col("errors")).alias("share"))  # one row of totals


def api_evidence(entries: DataFrame) -> DataFrame:
    """One row: whether the API answers 422, 409, 429, and with bodies to its errors."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    body = F.coalesce(F.bool_or((F.col("status") >= 400) & F.col("response_body").isNotNull()), F.lit(False))
    return entries.agg(has(422).alias("has_422"), has(409).alias("has_409"), has(429).alias("has_429"), body.alias("has_envelope"))


def endpoint_evidence(entries: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Per endpoint: path parameter, body, auth rate, state and unique fields, other methods of its template."""
    seen = observe(bodies(entries)) if observed is None else observed
    name = F.regexp_extract("path", "([^.]*)$", 1)
    state = seen.where((F.col("scope") != "request") & name.isin(*STATE_FIELDS)).select(*KEY).distinct().withColumn("has_state", F.lit(True))
    unique = seen.where((F.col("scope") == "request") & name.isin(*UNIQUE_FIELDS)).select(*KEY).distinct().withColumn("has_unique", F.lit(True))
    keyed = with_template(entries)
    sends = keyed.groupBy(*KEY).agg(F.bool_or(F.col("request_body").isNotNull()).alias("has_body"))
    rows = endpoints(keyed).select(*KEY, "auth_rate", "statuses", "sample_count")
    methods = rows.groupBy("template").agg(F.collect_set("method").alias("_methods"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = rows.join(methods, "template").join(sends, KEY).join(state, KEY, "left").join(unique, KEY, "left")
    return out.select(
        *KEY, "auth_rate", "statuses", "has_body", F.col("template").contains("{").alias("has_param"), F.array_sort(F.array_except("_methods", F.array("method"))).alias("siblings"),
        (F.col("method").isin("PATCH", "PUT") & yes(F.col("has_state"))).alias("changes_state"), ((F.col("method") == "POST") & yes(F.col("has_unique"))).alias("is_unique"),
    )


def validation_evidence(entries: DataFrame, profile: DataFrame) -> DataFrame:
    """Required request fields that a rejected (400, 422) request lacks; the first by entry and field."""
    needed = profile.where("scope = 'request' and required and parent = ''").select(*KEY, F.col("path").alias("field"))
    bad = with_template(entries).where("status in (400, 422)").where(F.col("request_body").startswith("{"))
    sent = bad.select(*KEY, "entry_seq", F.json_object_keys("request_body").alias("keys"))
    lacking = sent.join(needed, KEY).where(~F.array_contains("keys", F.col("field")))
    return lacking.groupBy(*KEY).agg(F.min(F.struct("entry_seq", "field")).alias("m")).select(*KEY, F.col("m.field").alias("field"))


def rules(e: dict[str, Column]) -> list[tuple[Column, Column, str, str]]:
    """(condition, status, evidence, confidence) in order of precedence for a status."""
    medium = "medium"
    return [
        (e["has_param"], F.lit(404), "path parameter", medium),
        (e["has_body"], F.when(e["has_422"], 422).otherwise(400), "request body", medium),
        (e["auth_rate"] >= AUTH_SHARE, F.lit(401), "authentication", medium),
        (e["auth_rate"] >= AUTH_SHARE, F.lit(403), "authentication", medium),
        (e["changes_state"] | (e["has_409"] & e["method"].isin("POST", "PUT", "PATCH")), F.lit(409), "state change", medium),
        (e["is_unique"], F.lit(409), "unique field", medium),
        (e["has_429"], F.lit(429), "rate limits elsewhere", medium),
        (F.size(e["siblings"]) > 0, F.lit(405), "other methods of the path", "low"),
        (F.lit(True), F.lit(500), "any server", "low"),
    ]


def inferred_responses(entries: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """method, template, status, evidence, confidence of responses that were not observed."""
    facts = endpoint_evidence(entries, observed).crossJoin(F.broadcast(api_evidence(entries)))  # one row
    e = {c: F.col(c) for c in facts.columns}
    offers = F.filter(F.array(*[F.when(cond, F.struct(status.alias("status"), F.lit(k).alias("rule"), F.lit(why).alias("evidence"), F.when(F.lit(conf == "medium") & e["has_envelope"], "medium").otherwise("low").alias("confidence"))) for k, (cond, status, why, conf) in enumerate(rules(e))]), lambda x: x.isNotNull())
    each = facts.select(*KEY, "statuses", F.explode(offers).alias("o")).where(~F.array_contains("statuses", F.col("o.status")))
    first = F.row_number().over(Window.partitionBy(*KEY, "o.status").orderBy("o.rule"))
    return each.withColumn("_k", first).where("_k = 1").select(*KEY, F.col("o.status").alias("status"), F.col("o.evidence").alias("evidence"), F.col("o.confidence").alias("confidence"))


# The envelope of APIs that never showed one (RFC 9457), and the fields that hold a message.
PROBLEM_DETAILS = [("detail", "string", False), ("status", "integer", True), ("title", "string", True), ("type", "string", False)]
MESSAGE_FIELDS = ["message", "detail", "title"]


def envelope_profile(observed: DataFrame) -> DataFrame:
    """The profile of all error bodies of the API as one scope (`error`); of problem details where there are none."""
    spark, one = observed.sparkSession, {"method": F.lit("*"), "template": F.lit("*"), "scope": F.lit("error")}
    errors = observed.where(F.col("scope") != "request").where(F.col("scope").cast("int") >= 400).withColumns(one)
    found = field_profile(errors)
    rows = [("*", "*", "error", None, "", ["object"], False)] + [("*", "*", "error", "", name, [kind], needed) for name, kind, needed in PROBLEM_DETAILS]
    known = spark.createDataFrame(rows, "method string, template string, scope string, parent string, path string, types array<string>, required boolean")
    none = known.join(found.select(*SCOPE).distinct(), SCOPE, "left_anti")
    out = found.unionByName(none, allowMissingColumns=True)
    return out.withColumns({"nullable": F.coalesce("nullable", F.lit(False)), "observed_types": F.coalesce("observed_types", "types"), "ambiguity": F.coalesce("ambiguity", F.array().cast("array<string>"))})


def example_value(field: Column, message: Column) -> Column:
    """A value (JSON) of an envelope's field (path, types, enum); null where nothing is known of it."""
    only = lambda kind: (F.size(field["types"]) == 1) & F.array_contains(field["types"], kind)
    said = field["path"].isin(*MESSAGE_FIELDS) & (F.array_contains(field["types"], "string") | (F.size(field["types"]) == 0))
    text = F.coalesce(F.get(field["enum"], F.lit(0)), F.lit("error"))
    return F.when(said, quoted(message)).when(only("integer"), "400").when(only("string"), quoted(text)).when(only("boolean"), "false").when(only("array"), "[]").when(only("object"), "{}")


def error_examples(inferred: DataFrame, envelope: DataFrame, mined: DataFrame) -> DataFrame:
    """inferred with example (JSON): the envelope's fields, one by one, with a message that says what the evidence does.

    mined: method, template, field that a rejected request lacked (`validation_evidence`); where there
    is one, the body's rule says that it is required.
    """
    top = envelope.where("parent = '' and path <> '' and not endswith(path, '[]')").select("path", "types", "enum")
    fields = top.agg(F.array_sort(F.collect_list(F.struct("path", "types", "enum"))).alias("_fields"))  # one row, of the envelope's size
    lacking = F.when((F.col("evidence") == "request body") & F.col("field").isNotNull(), F.concat(F.lit("'"), F.col("field"), F.lit("' is required")))
    rows = inferred.join(mined.select(*KEY, "field"), KEY, "left").crossJoin(F.broadcast(fields)).withColumn("_message", F.coalesce(lacking, F.col("evidence")))
    members = F.transform("_fields", lambda f: F.concat(quoted(f["path"]), F.lit(":"), example_value(f, F.col("_message"))))
    return rows.withColumn("example", F.concat(F.lit("{"), F.array_join(F.array_compact(members), ","), F.lit("}"))).drop("_fields", "_message", "field")


def observed_status_rate(entries: DataFrame) -> DataFrame:
    """Share of each error status of an endpoint (for chaos in mocks)."""
    keyed = with_template(entries)
    total = keyed.groupBy(*KEY).agg(F.count("*").alias("total"))
    return keyed.where("status >= 400").groupBy(*KEY, "status").agg(F.count("*").alias("n")).join(total, KEY).select(*KEY, "status", (F.col("n").cast("double") / F.col("total")).alias("rate"))


def thin_endpoints(entries: DataFrame, least: int = 20) -> DataFrame:
    """Endpoints with few samples: the example of their lowest success."""
    keyed = with_template(entries)
    ok = is_success(F.col("status")) & F.col("response_body").isNotNull()
    return keyed.groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("response_body", F.when(ok, F.struct("status", "entry_seq"))).alias("example")).where(F.col("n") < least)
