"""Paths met with the templates they fit: a trie of segments, walked level by level as joins.

Every template is a way down a trie: an edge is a segment, literal or with placeholders. Distinct
paths go down together, a join a level: by node and text over literal edges, by node alone over the
others, of which a node has few. Of the templates that a path ends at the most literal counts: from the
left, a literal segment goes before one with a placeholder in it, that before a placeholder alone.

Cases: empty segments count for nothing; a path that no template fits has none (null); of templates
that differ in their placeholders' names alone the first by text counts; null paths fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, "[?#].*$", ""), "/"), lambda s: s != "")


def _steps(template: Column) -> Column:
    """The template's segments: kind (0 literal, 1 mixed, 2 placeholder), text, and the pattern of mixed ones."""
    pattern = lambda s: F.concat(F.lit("^\\Q"), F.regexp_replace(s, "\\{[^}]*\\}", "\\\\E.+\\\\Q"), F.lit("\\E$"))
    kind = lambda s: F.when(s.rlike("^\\{[^}]*\\}$"), 2).when(s.rlike("\\{[^}]*\\}"), 1).otherwise(0)
    shape = lambda s: F.regexp_replace(s, "\\{[^}]*\\}", "{}")
    return F.transform(segments(template), lambda s: F.struct(kind(s).alias("kind"), shape(s).alias("text"), F.when(kind(s) == 1, pattern(s)).alias("pattern")))


def resolve(paths: DataFrame, templates: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """paths (by, path, more) with `template`; templates: by and template. by: what both must share, such as a method."""
    own = templates.select(*by, "template").where("template is not null").distinct().withColumn("steps", _steps(F.col("template")))
    node = lambda k: F.array_join(F.transform(F.slice("steps", 1, k), lambda s: s["text"]), "/")
    at = own.select(*by, "steps", F.explode(F.sequence(F.lit(1), F.greatest(F.size("steps"), F.lit(1)))).alias("_k")).where("_k <= size(steps)")
    step = F.get("steps", F.col("_k") - 1)
    edges = at.select(*by, (F.col("_k") - 1).alias("_level"), node(F.col("_k") - 1).alias("_node"), node(F.col("_k")).alias("_child"), step["kind"].alias("_kind"), step["text"].alias("_text"), step["pattern"].alias("_pattern")).distinct()
    ends = own.groupBy(*by, node(F.size("steps")).alias("_node"), F.size("steps").alias("_size")).agg(F.min("template").alias("_template"))
    deepest = own.agg(F.max(F.size("steps"))).first()[0] or 0  # joins, as many as the deepest template has segments
    asked = paths.select(*by, "path").where("path is not null").distinct().withColumn("_s", segments(F.col("path"))).where(F.size("_s") <= deepest)
    root = F.substring("path", 1, 0)  # the root's name, as a column: a constant would make the first join one without a key
    there = asked.select(*by, "path", "_s", root.alias("_node"), F.lit("").alias("_rank"))
    found = None
    for level in range(deepest + 1):
        done = there.where(F.size("_s") == level).join(ends.where(F.col("_size") == level), [*by, "_node"]).select(*by, "path", "_rank", "_template")
        found = done if found is None else found.unionByName(done)
        if level == deepest:
            break
        on, text = there.where(F.size("_s") > level), F.get("_s", F.lit(level))
        here = edges.where(F.col("_level") == level).drop("_level")
        literal = on.withColumn("_text", text).join(here.where("_kind = 0"), [*by, "_node", "_text"])
        other = on.withColumn("_own", text).join(here.where("_kind > 0"), [*by, "_node"]).where("_kind = 2 or _own rlike _pattern")
        there = literal.select(*by, "path", "_s", "_child", "_rank", "_kind").unionByName(other.select(*by, "path", "_s", "_child", "_rank", "_kind"))
        there = there.select(*by, "path", "_s", F.col("_child").alias("_node"), F.concat("_rank", F.col("_kind").cast("string")).alias("_rank"))
    best = found.groupBy(*by, "path").agg(F.min(F.struct("_rank", "_template"))["_template"].alias("template"))
    return paths.join(best, [*by, "path"], "left")
