"""Contracts end to end: profiles, documents, differences, tracking and the continuous build."""

import json

import pytest
from pyspark.sql import functions as F

from specloom.operators import diff, noise, quality
from specloom.plans import render
from specloom.plans.build import build
from specloom.sources.logs import accepted, parse_lines
from specloom.streaming import tracker
from specloom.streaming.watch import read_changes, watch


def log(spark, bodies, method="GET", path="/users/1", status=200, start=0):
    lines = [(start + k, json.dumps({"method": method, "path": path, "status": status, "response_body": b, "headers": {"Authorization": "Bearer x"}, "timestamp": f"2024-01-{k % 28 + 1:02d}"})) for k, b in enumerate(bodies)]
    return accepted(parse_lines(spark.createDataFrame(lines, "entry_seq long, value string")))


BODIES = [{"id": k, "role": "admin" if k % 2 else "user", "name": None if k == 3 else f"n{k}", "tags": [{"a": 1}] if k % 2 else [], "ratio": 1 if k % 2 else 1.5, **({"rare": True} if k < 5 else {}), "mixed": "x" if k == 0 else k} for k in range(40)]


@pytest.fixture(scope="module")
def contract(spark):
    return build(log(spark, BODIES), infer_errors=True)


def test_profile(contract):
    rows = {r["path"]: r for r in contract.profile.collect()}
    assert rows["id"]["types"] == ["integer"] and (rows["id"]["lo"], rows["id"]["hi"], rows["id"]["required"]) == (0, 39, True)
    assert rows["role"]["enum"] == ["admin", "user"] and rows["role"]["enum_confidence"] == 0.67
    assert rows["name"]["nullable"] and rows["name"]["null_rate"] == 0.025 and rows["name"]["enum"] is None
    assert rows["ratio"]["types"] == ["number"] and rows["tags[].a"]["n"] == 20 and rows["tags[]"]["types"] == ["object"]
    assert rows["rare"]["ambiguity"] == ["rare_field"] and not rows["rare"]["required"]
    assert rows["mixed"]["types"] == ["integer"] and rows["mixed"]["ambiguity"] == ["type_conflict"] and rows["mixed"]["observed_types"] == ["integer", "string"]


def test_document(contract, tmp_path):
    spec = contract.spec()
    assert render.validate_spec(spec) == []
    op = spec["paths"]["/users/{id}"]["get"]
    assert op["operationId"] == "get_users_by_id" and op["security"] and {"200", "401", "403", "404", "500"} == set(op["responses"])
    schema = op["responses"]["200"]["content"]["application/json"]["schema"]
    assert schema["properties"]["name"]["nullable"] and "rare" not in schema["required"] and schema["additionalProperties"] is False
    files = render.write_spec(spec, str(tmp_path / "out.json"))
    assert all(render.load_spec(f) for f in files) and render.mock_spec(spec)["paths"]["/users/{id}"]["get"]["responses"]["200"]["content"]["application/json"]["schema"]["properties"]["id"]["maximum"] == 39
    assert render.validate_spec({"paths": {"x": {"get": {}}}}) and render.load_spec(str(tmp_path / "none")) is None
    assert contract.quality().first()["confidence"] == "low"


def test_differences(spark, contract):
    new = build(log(spark, [{"id": str(k), "role": "user", "name": "x", "tags": [], "ratio": 1.5, "mixed": k, "extra": {"deep": 1}} for k in range(40)]))
    rows = {(r["kind"], r["location"]): r["breaking"] for r in diff.diff_fields(contract.profile, new.profile).collect()}
    assert rows[("type_changed", "response.200.body.id")] and rows[("field_removed", "response.200.body.rare")] and rows[("field_added", "response.200.body.extra")] is False
    assert ("field_added", "response.200.body.extra.deep") not in rows and not any(k[1].endswith("tags[].a") for k in rows if k[0] == "field_removed") is None


def test_scores(spark, contract):
    row = quality.scorecard(contract.profile, contract.profile).first()
    assert (row["precision"], row["recall"], row["required_accuracy"], row["fp"], row["fn"]) == (1.0, 1.0, 1.0, 0, 0)
    lines = spark.createDataFrame([(k, '{"a":1,"status":200}') for k in range(500)], "entry_seq long, value string")
    once, again = (noise.mutate_lines(lines, 5).orderBy("entry_seq").collect() for _ in range(2))
    assert once == again and 20 < sum(r["value"] != '{"a":1,"status":200}' for r in once) < 180


def test_tracking(spark):
    rows = [{"name": "x", "k": 1}] * 15 + [{"full_name": "x", "k": 1}] * 12
    states = tracker.field_states(build(log(spark, rows)).observed)
    assert [tuple(r)[3:] for r in tracker.rename_pairs(states).collect()] == [("name", "full_name", 0.5, True)]
    state = states.where("path = 'name'").first()
    assert (state["first_seen"], state["present"], state["missing_streak"], state["missing_since"]) == (1, 15, 12, 16)


def test_bursts_and_releases(spark):
    rows = [(f"2024-01-01 00:00:{s:02d}", b) for s, b in [(0, True), (5, False), (40, False), (59, False)]]
    changes = spark.createDataFrame(rows, "t string, breaking boolean").select(F.col("t").cast("timestamp").alias("detected_at"), "breaking")
    got = [(r["changes"], r["breaking"]) for r in tracker.change_bursts(changes).orderBy("burst_start").collect()]
    assert got == [(2, True), (1, False), (1, False)]
    named = spark.createDataFrame([(1, True), (2, False), (3, True)], "burst int, breaking boolean")
    assert [r["version"] for r in diff.releases(named).orderBy("burst").collect()] == ["2.0.0", "2.1.0", "3.0.0"]


def test_continuous_build(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "api.json")
    folder.mkdir()
    line = lambda b: json.dumps({"method": "GET", "path": "/a", "status": 200, "response_body": b})
    (folder / "1.jsonl").write_text("\n".join(line({"x": k}) for k in range(12)) + "\n")
    watch(spark, str(folder), out, once=True).awaitTermination()
    assert render.load_spec(out)["paths"]["/a"]
    (folder / "2.jsonl").write_text("\n".join(line({"x": k, "y": 1}) for k in range(3)) + "\n")
    watch(spark, str(folder), out, once=True).awaitTermination()
    changes = read_changes(spark, str(tmp_path / "api.state")).collect()
    assert [(c["kind"], c["location"], c["breaking"]) for c in changes] == [("field_added", "response.200.body.y", False)]


def test_versions_and_mixes(spark):
    from specloom.operators import endpoints

    rows = [{"id": k, "full_name": "x", "mail": "m"} for k in range(30)] + [{"id": k, "name": "x", "email": "m"} for k in range(20)]
    plain = log(spark, rows)
    mix = endpoints.version_mix(plain, endpoints.endpoints(plain))
    assert [len(r["clusters"]) for r in mix.collect()] == [2]
    assert [(r["old"], r["new"]) for r in endpoints.rename_candidates(mix, plain).collect()] == [("full_name", "name")]
    named = log(spark, rows, path="/v2/users/1")
    assert endpoints.endpoints(named).first()["api_version"] == "v2" and endpoints.version_mix(named, endpoints.endpoints(named)).isEmpty()
    other = [{"id": k, "full_name": 1, "mail": "m"} for k in range(30)] + rows[30:]
    assert endpoints.rename_candidates(endpoints.version_mix(log(spark, other)), log(spark, other)).isEmpty()


def test_a_removal_is_reported(spark, tmp_path):
    """A field that was required once is reported when it has been away for ten calls, though its share has long fallen."""
    folder, out = tmp_path / "in", str(tmp_path / "api.json")
    folder.mkdir()
    line = lambda b: json.dumps({"method": "GET", "path": "/a", "status": 200, "response_body": b})
    kinds = []
    for k, rows in enumerate([[{"x": 1, "kept": 1}] * 12, [{"kept": 1}] * 11]):
        (folder / f"{k}.jsonl").write_text("\n".join(map(line, rows)) + "\n")
        watch(spark, str(folder), out, once=True).awaitTermination()
        kinds = [(c["kind"], c["location"]) for c in read_changes(spark, str(tmp_path / "api.state")).collect()] if k else []
    assert kinds.count(("field_removed", "response.200.body.x")) == 1


def test_document_differences(spark):
    from specloom.plans import documents

    def doc(props, required=(), status="200", params=()):
        schema = {"type": "object", "properties": props, "required": list(required)}
        op = {"parameters": [{"in": "query", "name": n, "required": r, "schema": {"type": t}} for n, r, t in params], "responses": {status: {"content": {"application/json": {"schema": schema}}}, "404": {"x-inferred": True}}}
        return spark.createDataFrame([("d", json.dumps({"paths": {"/a": {"get": op}, "/b": 3}}))], "doc string, spec string")

    old = doc({"id": {"type": "integer"}, "name": {"type": "string"}, "list": {"anyOf": [{"type": "array", "items": {"type": "object", "properties": {"z": {"type": "string"}}}}, {"type": "null"}]}}, ["id", "name"], params=[("q", False, "integer")])
    new = doc({"id": {"type": "string"}, "name": {"type": "string"}, "list": {"type": "array", "items": {"type": "object", "properties": {}}}, "more": {"type": "object", "properties": {"deep": {"type": "string"}}}}, ["id"], params=[("q", True, "integer"), ("r", True, "string")])
    rows = lambda *a, **k: sorted((r["kind"], r["location"], r["breaking"]) for r in documents.diff_documents(*a, **k).collect())
    every = [("became_optional", "response.200.body.name", False), ("became_required", "query.q", True), ("field_added", "response.200.body.more", False), ("field_removed", "response.200.body.list[].z", True), ("param_added", "query.r", True), ("type_changed", "response.200.body.id", True)]
    assert rows(old, new) == every
    cold = spark.createDataFrame([("GET", "/a", "201")], "method string, template string, scope string")
    assert rows(old, new, warm=cold) == [c for c in every if c[0] in ("field_removed", "type_changed")]
    assert rows(old, old) == [] and [r[0] for r in rows(old, doc({}, status="500"))] == ["param_removed", "status_added", "status_removed"]
    assert rows(spark.createDataFrame([("x", "nonsense")], "doc string, spec string"), old) == [("endpoint_added", "endpoint", False)]


def test_summaries_and_hints(spark):
    rows = spark.createDataFrame([("field_removed", "GET", "/a", "response.200.body.x", "", True), ("field_added", "GET", "/b", "request.query.q", "", False)], "kind string, method string, template string, location string, detail string, breaking boolean")
    assert rows.select(diff.rule_summary(rows).select("summary").first()["summary"] == F.lit("1 breaking changes at GET /a: field removed; 1 other changes")).first()[0]
    got = [tuple(r) for r in rows.select(diff.where_label(F.col("location")), diff.migration_hint(F.col("kind"), F.col("location"), F.col("detail"), F.col("breaking"))).collect()]
    assert got == [("200 response body", "Do without `x` in the 200 response body."), ("query parameter", "`q` is there to be used.")]


def test_documents_of_any_depth(spark):
    """Six arrays, four alternatives, statuses that are words, and things that are no schemas."""
    from specloom.plans import documents

    schema = {"type": "object", "required": ["deep"], "properties": {"deep": {"anyOf": [{"oneOf": [{"anyOf": [{"anyOf": [{"type": ["string", "null"]}]}]}]}, {"type": "integer"}]}, "odd": 3, "none": {"type": "object", "properties": [], "required": "x"}}}
    for _ in range(6):
        schema = {"type": "array", "items": schema}
    spec = {"paths": {"/a": {"get": {"parameters": [{"in": "query", "name": "q", "schema": {"anyOf": [{"anyOf": [{"anyOf": [{"type": "number"}]}]}]}}, 5], "responses": {"default": {"content": {"application/json": {"schema": schema}}}, "200": {"content": []}}}}}}
    docs = spark.createDataFrame([("d", json.dumps(spec))], "doc string, spec string")
    found = documents.fields(documents.operations(docs))
    rows = {r["path"]: r for r in found.collect()}
    assert rows["[][][][][][].deep"]["types"] == ["integer", "string"] and rows["[][][][][][].deep"]["required"] and rows["[][][][][][].odd"]["types"] == [] and rows["[][][][][][].none"]["types"] == ["object"]
    assert [r["path"] for r in documents.required_paths(found).collect()] == ["[][][][][][].deep"]
    assert documents.schema_at(found, "GET", "/a", "default", "[][][][][][]").first()["types"] == ["object"]
    assert documents.params(documents.operations(docs)).first()["type"] == "number"
    other = json.dumps({"paths": {"/a": {"get": {"responses": {"2XX": {}, "404": {}}}}}})
    changes = documents.diff_documents(docs, spark.createDataFrame([("d", other)], "doc string, spec string")).collect()
    assert {(c["kind"], c["location"], c["breaking"]) for c in changes} == {("status_removed", "response.default", False), ("status_removed", "response.200", True), ("status_added", "response.2XX", False), ("status_added", "response.404", False), ("param_removed", "query.q", True)}


def test_a_document_folded_from_tables(spark, contract):
    """The fold gives the document that the driver assembles, and flattens to the rows that it was folded from."""
    from specloom.plans import documents, fold

    row = fold.contract_document(contract).first()
    spec, want = json.loads(row["spec"]), contract.spec()
    strip = lambda v: {k: strip(x) for k, x in v.items()} if isinstance(v, dict) else sorted(map(strip, v), key=str) if isinstance(v, list) else v
    assert render.validate_spec(spec) == []
    for own in (spec, want):
        for item in own["paths"].values():
            for op in item.values():
                for answer in op["responses"].values():
                    answer.pop("content", {}) if answer.get("x-inferred") else None
    assert strip(spec) == strip(want)
    found = documents.fields(documents.operations(spark.createDataFrame([("d", row["spec"])], "doc string, spec string")))
    flat = {(r["scope"], r["path"]): (r["types"], r["required"]) for r in found.collect()}
    assert flat == {(r["scope"], r["path"]): (sorted(r["types"]), bool(r["required"])) for r in contract.profile.collect()}


def test_texts_are_carried_over_without_a_broadcast(spark):
    """Spark takes the nodes of documents for no more than their table: no side of the joins may be sent through the driver for that."""
    from specloom.plans import documents

    spec = """concat('{"paths":{"/', id, '":{"get":{"responses":{"200":{"content":{"application/json":{"schema":{"type":"object","properties":{"a":{"type":"string"', @, '},"b":{"type":"boolean"}}}}}}}}}}}')"""
    side = lambda text: documents.fields(documents.operations(spark.range(40).selectExpr("id AS doc", f"{spec.replace('@', text)} AS spec")))
    new = side("CASE WHEN id % 4 = 0 THEN ',\"description\":\"own\"' ELSE '' END")
    out = documents.carry_over(new, side("""',"description":"old"'"""), new.where("path = 'b'").withColumn("text", F.lit("rule")))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(k, path): text for k in range(40) for path, text in (("", None), ("a", "old" if k % 4 else "own"), ("b", "rule"))}
    rows = out.collect()
    assert len(rows) == len(want) and {(r["doc"], r["path"]): r["text"] for r in rows} == want
