"""Column functions over URLs and paths: splitting, query parameters, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an id looks like.
DIGITS = "^[0-9]+$"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX24 = "^[0-9a-fA-F]{24}$"
TOKEN = "^(?=.*[0-9])[A-Za-z0-9_-]{8,}$"
ID_SEGMENT = "|".join([DIGITS, UUID, HEX24, TOKEN])


def split_url(url: Column) -> Column:
    """struct(path, query) of a full URL, a URL without scheme, or a path."""
    remote = url.contains("://") | url.startswith("//")
    rest = F.when(remote, F.regexp_replace(url, "^(?:[^/?#]*:)?//[^/?#]*", "")).otherwise(url)
    rest = F.regexp_replace(rest, "(?s)#.*$", "")
    path = F.regexp_replace(rest, "(?s)\\?.*$", "")
    path = F.when(~remote & path.rlike("^[^/]*[.:][^/]*/"), F.regexp_replace(path, "^[^/]+", "")).otherwise(path)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.struct(path.alias("path"), F.regexp_extract(rest, "(?s)\\?(.*)$", 1).alias("query"))


def query_params(query: Column) -> Column:
    """map of a query string: blanks kept, the last of equal names wins; empty without any `=`."""
    parts = F.filter(F.split(F.regexp_replace(query, "^\\?+", ""), "&"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(parts, lambda p: F.struct(decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(query.contains("="), F.map_from_entries(last)).otherwise(F.map_from_entries(F.filter(last, lambda p: F.lit(False))))


def is_id_segment(segment: Column) -> Column:
    return segment.rlike(ID_SEGMENT)


def singular(word: Column) -> Column:
    n, low = F.length(word), F.lower(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(low.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y")))
        .when(low.endswith("sses") | low.endswith("xes") | low.endswith("ches") | low.endswith("shes"), cut(2))
        .when(low.endswith("s") & ~low.endswith("ss") & (n > 1), cut(1))
        .otherwise(word)
    )


def camel(word: Column) -> Column:
    parts = F.filter(F.split(word, "[-_.]"), lambda p: p != "")
    up = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))
    joined = F.concat(F.lower(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), up), ""))
    return F.when(joined == "", F.lit("id")).otherwise(joined)


def path_template(path: Column) -> Column:
    """struct(template, params): ids become named placeholders, unique within the path.

    A single id is `{id}`; of several each is named after the segment before it, or `id` where
    that is missing or an id itself; a name that is taken gets 2, 3, ... . One pass over the
    segments: each is tested once and carries what is known of those before it.
    """
    parts = F.filter(F.split(F.regexp_replace(path, "(?s)[?#].*$", ""), "/"), lambda p: p != "")
    marked = F.transform(parts, lambda p: F.struct(p.alias("text"), is_id_segment(p).alias("is_id")))
    nothing = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<struct<text:string,base:string,name:string>>").alias("out"), nothing.alias("before"))

    def step(seen: Column, part: Column) -> Column:
        base = F.when(seen["before"].isNull(), F.lit("id")).otherwise(F.concat(camel(singular(seen["before"])), F.lit("Id")))
        plain = F.struct(part["text"].alias("text"), nothing.alias("base"), nothing.alias("name"))
        named = F.element_at(F.transform(F.array(base), lambda b: F.struct(part["text"].alias("text"), b.alias("base"), _free_name(b, seen["out"]).alias("name"))), 1)
        return F.struct(F.concat(seen["out"], F.array(F.when(part["is_id"], named).otherwise(plain))).alias("out"), F.when(~part["is_id"], part["text"]).alias("before"))

    def finish(seen: Column) -> Column:
        ids = F.filter(seen["out"], lambda o: o["name"].isNotNull())
        name = lambda o: F.when(F.size(ids) == 1, F.lit("id")).otherwise(o["name"])
        text = F.transform(seen["out"], lambda o: F.when(o["name"].isNull(), o["text"]).otherwise(F.concat(F.lit("{"), name(o), F.lit("}"))))
        return F.struct(F.concat(F.lit("/"), F.array_join(text, "/")).alias("template"), F.transform(ids, lambda o: F.struct(name(o).alias("name"), o["text"].alias("value"))).alias("params"))

    return F.aggregate(marked, start, step, finish)


def _free_name(base: Column, out: Column) -> Column:
    """base, or base with the least number from 2 on, that no earlier segment is named."""
    names = F.transform(out, lambda o: o["name"])
    numbered = F.transform(F.sequence(F.lit(1), F.size(out) + 1), lambda k: F.when(k == 1, base).otherwise(F.concat(base, k.cast("string"))))
    return F.element_at(F.filter(numbered, lambda n: ~F.coalesce(F.array_contains(F.array_compact(names), n), F.lit(False))), 1)


def path_version(path: Column) -> Column:
    """v<N> of a leading version segment; null without one."""
    n = F.regexp_extract(path, "(?i)^/*v([0-9]+)(?:/|$)", 1)
    return F.when(n != "", F.concat(F.lit("v"), n))


def template_regex(template: Column) -> Column:
    """A pattern that a template's concrete paths match."""
    quoted = F.regexp_replace(template, "([.+*?^$()\\[\\]|\\\\])", "\\\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, "\\{[^}]*\\}", "[^/]+"), F.lit("$"))


def resource_prefix(template: Column) -> Column:
    """The template up to its first placeholder."""
    return F.regexp_replace(template, "/\\{.*$", "")


def operation_id(method: Column, template: Column) -> Column:
    """get_users_by_id, get_root."""
    parts = F.filter(F.split(template, "/"), lambda p: p != "")
    words = F.transform(parts, lambda p: F.regexp_replace(F.when(p.startswith("{"), F.concat(F.lit("by_"), F.regexp_replace(p, "[{}]", ""))).otherwise(p), "[^A-Za-z0-9_]", "_"))
    return F.when(F.size(parts) == 0, F.concat(F.lower(method), F.lit("_root"))).otherwise(F.concat_ws("_", F.lower(method), F.array_join(words, "_")))
