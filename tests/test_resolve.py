"""Template resolver: against every template tried one by one."""

import itertools
import re

from specloom.operators.resolve import resolve


def brute(path, templates):
    own = [s for s in re.sub(r"[?#].*", "", path).split("/") if s]

    def rank(template):
        steps = [s for s in template.split("/") if s]
        kinds = ""
        for step, text in zip(steps, own):
            pure = re.fullmatch(r"\{[^}]*\}", step)
            mixed = not pure and "{" in step
            if not pure and not re.fullmatch("(.+)".join(map(re.escape, re.split(r"\{[^}]*\}", step))), text):
                return None
            kinds += "2" if pure else "1" if mixed else "0"
        return kinds if len(steps) == len(own) else None

    fits = [(r, t) for t in templates if (r := rank(t)) is not None]
    return min(fits)[1] if fits else None


def test_every_path(spark):
    templates = ["/", "/a", "/{x}", "/a/b", "/a/{x}", "/{x}/b", "/{x}/{y}", "/{z}/{y}", "/a/v{n}.json", "/a/{x}/c", "/{x}/b/c", "/d.e/{x}", "/{p}-{q}/b"]
    parts = ["a", "b", "c", "d.e", "dxe", "v1.json", "v.json", "u-v"]
    paths = ["/", "", "//a//", "/a?x=1", "/a/b#f", *("/" + "/".join(c) for k in (1, 2, 3, 4) for c in itertools.product(parts, repeat=k) if k < 4 or c[0] == "a")]
    df = spark.createDataFrame([(p, 7) for p in paths] + [(None, 7), ("/a", 8)], "path string, template_id int")
    found = resolve(df, spark.createDataFrame([(t,) for t in templates], "template string"))
    rows = found.collect()
    assert len(rows) == len(paths) + 2
    for r in rows:
        assert r["template"] == (None if r["path"] is None else brute(r["path"], templates)), r["path"]
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_methods_part_templates(spark):
    paths = spark.createDataFrame([("GET", "/a/1"), ("POST", "/a/1"), ("PUT", "/a/1")], "method string, path string")
    templates = spark.createDataFrame([("GET", "/a/{id}"), ("POST", "/a/1"), ("GET", "/a")], "method string, template string")
    assert {r["method"]: r["template"] for r in resolve(paths, templates, ["method"]).collect()} == {"GET": "/a/{id}", "POST": "/a/1", "PUT": None}
    assert [r["template"] for r in resolve(paths, templates.where("false"), ["method"]).collect()] == [None] * 3
