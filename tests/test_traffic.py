"""Dependent traffic and as-of lookups: against a walk in order."""

import random

from specloom.operators import asof
from specloom.sources import traffic


def test_as_of(spark, monkeypatch):
    monkeypatch.setattr(asof, "STRETCH", 16)
    rng = random.Random(1)
    marks = [(rng.randrange(-50, 400), k) for k in range(30)] + [(None, 99)]
    points = [(rng.randrange(-100, 500), k) for k in range(300)] + [(None, 1), (7, 2), (7, 2)]
    found = asof.as_of(spark.createDataFrame(points, "seq long, k long"), spark.createDataFrame(marks, "seq long, mark long"), "seq", "mark")
    want = [(s, k, None if s is None else max(((a, m) for a, m in marks if a is not None and a <= s), default=(0, None))[1]) for s, k in points]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert asof.as_of(spark.createDataFrame(points, "seq long, k long"), spark.createDataFrame([], "seq long, mark long"), "seq", "mark").where("mark is not null").isEmpty()


def test_calls_depend_on_earlier_ones(spark):
    schedule = spark.createDataFrame([(1000, 1), (2000, 2), (2500, 3), (3500, 4)], "id long, version int")
    found = traffic.calls(spark.range(4000), schedule)
    rows = sorted(found.collect())
    made, names = set(), [r["scenario"] for r in rows]
    for r in rows:
        if r["scenario"] == "create":
            made.add(r["id"])
        assert r["scenario"] == "list" or r["application"] in made
        assert r["version"] == sum(r["id"] >= k for k in (1000, 2000, 2500, 3500))
    for name, share in traffic.SCENARIOS:
        assert abs(names.count(name) / 4000 - share / 100) < 0.03
    part = {r["id"]: r for r in traffic.calls(spark.range(1500, 2500), schedule).where("id > 1700").collect()}
    assert all(part[r["id"]] == r for r in rows if 1700 < r["id"] < 2500)  # any part comes out the same, but for its first calls
    log = traffic.entries(found).collect()
    assert {r["status"] for r in log} == {200, 201, 204} and all(("citizenship" in r["response_body"]) == (r["entry_seq"] >= 1000) for r in log if r["response_body"])
