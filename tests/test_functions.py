"""Column functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from specloom.functions import paths, text

TEMPLATES = [
    ("/", "/", []), ("/users", "/users", []), ("/users/42", "/users/{id}", ["42"]), ("/users/42/orders/7", "/users/{userId}/orders/{orderId}", ["42", "7"]),
    ("/categories/1/boxes/2", "/categories/{categoryId}/boxes/{boxId}", ["1", "2"]), ("/a/1/2", "/a/{aId}/{id}", ["1", "2"]), ("/1/2/3", "/{id}/{id2}/{id3}", ["1", "2", "3"]), ("/a/1/a/2/a2/3", "/a/{aId}/a/{aId2}/a2/{a2Id}", ["1", "2", "3"]), ("/.-/1/x/2", "/.-/{idId}/x/{xId}", ["1", "2"]),
    ("/users/550e8400-e29b-41d4-a716-446655440000?x=1", "/users/{id}", ["550e8400-e29b-41d4-a716-446655440000"]), ("/v1/health-check", "/v1/health-check", []),
    ("/day/2024-01-01", "/day/{id}", ["2024-01-01"]), ("//users//9/", "/users/{id}", ["9"]), ("/api-keys/1/user_groups/2", "/api-keys/{apiKeyId}/user_groups/{userGroupId}", ["1", "2"]),
]
URLS = [
    ("https://h.example/a/b?x=1#f", "/a/b", "x=1"), ("//h.example/a", "/a", ""), ("h.example:80/a?y", "/a", "y"), ("/a?u=http://x/y", "/a", "u=http://x/y"), ("a/b", "/a/b", ""), ("https://h.example", "/", ""), ("v1.2/x", "/x", ""),
]


def test_templates(spark):
    rows = spark.createDataFrame([(p,) for p, _, _ in TEMPLATES], "p string").select("p", paths.path_template(F.col("p")).alias("t")).collect()
    got = {r["p"]: (r["t"]["template"], [x["value"] for x in r["t"]["params"]]) for r in rows}
    assert got == {p: (t, v) for p, t, v in TEMPLATES}


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string").select("u", paths.split_url(F.col("u")).alias("s")).collect()
    assert {r["u"]: tuple(r["s"]) for r in rows} == {u: (p, q) for u, p, q in URLS}


def test_query_params(spark):
    rows = spark.createDataFrame([("a=1&b=&a=2&c=%C3%A9+x",), ("plain",), ("?k",), ("&&x=%zz",), ("",)], "q string").select("q", paths.query_params(F.col("q")).alias("m")).collect()
    assert {r["q"]: r["m"] for r in rows} == {"a=1&b=&a=2&c=%C3%A9+x": {"a": "2", "b": "", "c": "é x"}, "plain": {}, "?k": {}, "&&x=%zz": {"x": "%zz"}, "": {}}


@pytest.mark.parametrize("key,want", [("ID", "id"), ("UserID", "user_id"), ("user-name", "user_name"), ("HTTPServer", "http_server"), ("__", "__"), ("a b", "a_b")])
def test_canonical_keys(spark, key, want):
    assert spark.range(1).select(text.canonical_key(F.lit(key)).alias("k")).first()["k"] == want


def test_small_functions(spark):
    row = spark.range(1).select(
        text.name_similarity(F.lit("fullName"), F.lit("name")).alias("s"), text.wilson_lower_bound(F.lit(10), F.lit(10)).alias("w"), text.wilson_lower_bound(F.lit(0), F.lit(0)).alias("z"),
        paths.path_version(F.lit("/v2/x")).alias("v"), paths.path_version(F.lit("/vx/2")).alias("n"), paths.operation_id(F.lit("GET"), F.lit("/users/{id}")).alias("o"), paths.operation_id(F.lit("GET"), F.lit("/")).alias("r"),
        text.mask_header(F.lit("Authorization"), F.lit("Bearer abc")).alias("m"), F.rlike(F.lit("/users/9"), paths.template_regex(F.lit("/users/{id}"))).alias("t"), paths.resource_prefix(F.lit("/a/{id}/b")).alias("p"),
    ).first()
    assert (row["s"], row["z"], row["v"], row["n"], row["o"], row["r"], row["m"], row["t"], row["p"]) == (0.5, 0.0, "v2", None, "get_users_by_id", "get_root", "Bearer <redacted>", True, "/a")
    assert abs(row["w"] - 0.7225) < 1e-3


FORMATS = [
    ("email", ["a@b.co", "x.y@z.example"], True), ("email", ["a@b.c1"], False), ("uri", ["http://a.b/c", "https://x"], True), ("uri", ["ftp://a.b"], False), ("uri", ["http:///x"], False),
    ("date-time", ["2024-01-01T25:61"], False), ("date-time", ["2024-01-01t10:00:00z", "2024-01-01 10:00", "2024-01-01T10:00:00.123456+05:30"], True), ("date-time", ["2024-02-30T10:00"], False), ("date", ["2024-02-29"], True), ("date", ["2023-02-29"], False),
]


@pytest.mark.parametrize("name,values,fits", FORMATS)
def test_formats(spark, name, values, fits):
    from specloom.operators.profile import matches_format

    row = spark.createDataFrame([(v,) for v in values], "v string").agg(F.bool_and(matches_format(F.col("v"), name)).alias("ok")).first()
    assert row["ok"] == fits


def test_bodies_of_any_depth(spark):
    """A body 500 deep, doubled keys, and both ways on the same bodies."""
    import json

    from specloom.operators import observe as O

    deep = {"leaf": 1}
    for k in range(500):
        deep = {"aB": deep} if k % 2 else {"list": [deep, k]}
    own = [{"id": 1, "userID": "x", "n": [1, 2.0, 10**25, 10**50, None, True, {"É-k": []}]}, [[["a"]], {}], "text", 7]
    texts = [json.dumps(x) for x in own] + ['{"a":1,"a":"two"}', "nonsense", json.dumps(deep)]
    rows = spark.createDataFrame([("GET", "/a", "200", k, t) for k, t in enumerate(texts)], "method string, template string, scope string, entry_seq long, body string")
    found: dict = {}
    for r in O.observe(rows).collect():
        found.setdefault(r["entry_seq"], []).append(tuple(r[c] for c in O.OBSERVATION))
    assert set(found) == {0, 1, 2, 3, 4, 6} and ("a", "", "a", "string", "two", None) in found[4]
    for k, text in enumerate(texts):
        assert sorted(found.get(k, []), key=str) == sorted(O.values_in(text), key=str), k
    assert len(found[6]) == 1 + 250 * 3 + 250 + 1
