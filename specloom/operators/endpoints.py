"""Endpoint rollups: counts, parameters, examples, versions and evidence of authentication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import DIGITS, UUID, path_version
from ..functions.text import name_similarity
from .observe import KEY, SCOPE, bodies, is_success, type_of, with_template

# Headers that carry versions and credentials; limits of version mixes.
VERSION_HEADERS = ["accept-version", "x-api-version"]
AUTH_HEADERS = ["authorization", "x-api-key", "cookie"]
MIX_SHARE, MIX_CLUSTERS = 0.20, 4


def _has_header(headers: Column, names: list[str]) -> Column:
    return F.exists(F.map_keys(headers), lambda k: F.lower(k).isin(*names))


def endpoint_parts(entries: DataFrame) -> DataFrame:
    """Per endpoint and set of version headers: counts, times, statuses and evidence."""
    keyed = with_template(entries)
    when, version = F.when(F.col("timestamp") != "", F.col("timestamp")), path_version(F.col("path"))
    has_body = F.when(is_success(F.col("status")), F.col("request_body").isNotNull())
    own = keyed.select(*KEY, "entry_seq", "status", when.alias("_when"), version.alias("_v"), has_body.alias("_body"), _has_header(F.col("headers"), AUTH_HEADERS).cast("long").alias("_auth"), _versions(F.col("headers")).alias("names"))
    return own.groupBy(*KEY, "names").agg(
        F.count("*").alias("n"), F.min("_when").alias("first_seen"), F.max("_when").alias("last_seen"), F.array_sort(F.collect_set("status")).alias("statuses"), F.sum("_auth").alias("auth"),
        F.bool_and("_body").alias("bodies"), F.min(F.when(F.col("_v").isNotNull(), F.struct("entry_seq", F.col("_v").alias("version")))).alias("versioned"), F.min("entry_seq").alias("first"),
    )


def endpoints_of(parts: DataFrame) -> DataFrame:
    out = parts.groupBy(*KEY).agg(
        F.sum("n").alias("sample_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("statuses")))).alias("statuses"),
        (F.sum("auth").cast("double") / F.sum("n")).alias("auth_rate"), F.coalesce(F.bool_and("bodies"), F.lit(False)).alias("request_required"),
        F.min("versioned")["version"].alias("_path"), F.collect_list(F.when(F.size("names") > 0, F.struct(F.col("names").alias("_names"), "n", "first"))).alias("_headers"),
    )
    return out.withColumn("api_version", F.coalesce("_path", _commonest(F.col("_headers")))).drop("_path", "_headers")


def endpoints(entries: DataFrame) -> DataFrame:
    """One row an endpoint, by template and method: all in one shuffle, summed by version header first."""
    return endpoints_of(endpoint_parts(entries))


def _versions(headers: Column) -> Column:
    """The version headers' values of a call, stripped; blank ones say nothing."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]).isin(*VERSION_HEADERS))
    return F.filter(F.transform(named, lambda e: F.trim(e["value"])), lambda v: v != "")


def _commonest(groups: Column) -> Column:
    """Of groups (_names, n, first) the name of most calls; of equals the first seen."""
    names = F.array_distinct(F.flatten(F.transform(groups, lambda g: g["_names"])))

    def counted(name: Column) -> Column:
        own = F.filter(groups, lambda g: F.array_contains(g["_names"], name))
        times = lambda g: g["n"] * F.size(F.filter(g["_names"], lambda v: v == name))
        return F.struct(F.aggregate(own, F.lit(0).cast("long"), lambda a, g: a + times(g)).alias("n"), (-F.array_min(F.transform(own, lambda g: g["first"]))).alias("first"), name.alias("name"))

    return F.array_max(F.transform(names, counted))["name"]


def header_version(entries: DataFrame) -> DataFrame:
    """The commonest version header of each endpoint; of equals the first seen."""
    each = with_template(entries).select(*KEY, "entry_seq", F.explode(_versions(F.col("headers"))).alias("value"))
    counted = each.groupBy(*KEY, "value").agg(F.count("*").alias("n"), F.min("entry_seq").alias("first"))
    return counted.groupBy(*KEY).agg(F.max_by("value", F.struct("n", (-F.col("first")).alias("f"))).alias("header_version"))


def auth_rate(entries: DataFrame) -> DataFrame:
    return with_template(entries).groupBy(*KEY).agg(F.avg(_has_header(F.col("headers"), AUTH_HEADERS).cast("double")).alias("auth_rate"))


def example_parts(entries: DataFrame) -> DataFrame:
    """The first body of each status of an endpoint, with its place."""
    keyed = with_template(entries).where("response_body is not null")
    return keyed.groupBy(*KEY, "status").agg(F.min(F.struct("entry_seq", "response_body")).alias("example"))


def examples_of(parts: DataFrame) -> DataFrame:
    return parts.select(*KEY, "status", F.col("example.response_body").alias("example"))


def examples(entries: DataFrame) -> DataFrame:
    """The first body of each status of an endpoint."""
    return examples_of(example_parts(entries))


def path_param_parts(entries: DataFrame) -> DataFrame:
    """Path parameters by their place in the template, and what all their values are."""
    each = with_template(entries).select(*KEY, F.posexplode("params").alias("place", "p"))
    value = F.col("p.value")
    return each.groupBy(*KEY, F.col("p.name").alias("name")).agg(F.min("place").alias("place"), F.bool_and(value.rlike(DIGITS)).alias("digits"), F.bool_and(value.rlike(UUID)).alias("uuids"))


def path_params_of(parts: DataFrame) -> DataFrame:
    kind = F.when(F.col("digits"), "integer").when(F.col("uuids"), "string/uuid").otherwise("string")
    return parts.select(*KEY, "name", "place", kind.alias("type"))


def path_params(entries: DataFrame) -> DataFrame:
    """Path parameters by their place in the template; all are required."""
    return path_params_of(path_param_parts(entries))


#: What all values of a query parameter may be, in order of preference.
VALUE_TYPES = ["integer", "number", "boolean"]


def _is_value(value: Column, kind: str) -> Column:
    if kind == "integer":
        return value.rlike("^[+-]?[0-9]+$")
    if kind == "boolean":
        return F.lower(value).isin("true", "false")
    number = value.try_cast("double")
    return F.coalesce(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & ~F.lower(value).rlike("[df]$"), F.lit(False))


def query_param_parts(entries: DataFrame) -> DataFrame:
    """Per endpoint and parameter, of all calls (`all`) and of those that succeeded (`ok`): how many have it, and what all values are. The nameless row counts the calls themselves."""
    keyed = with_template(entries).withColumn("ok", is_success(F.col("status")))
    named = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))), F.transform(F.map_entries("query"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    each = keyed.select(*KEY, "entry_seq", "ok", F.explode(named).alias("p")).select(*KEY, "entry_seq", "ok", "p.*")
    kinds = [F.bool_and(F.when(own, _is_value(F.col("value"), kind))).alias(f"{kind}_{tag}") for tag, own in (("all", F.lit(True)), ("ok", F.col("ok"))) for kind in VALUE_TYPES]
    return each.groupBy(*KEY, "name").agg(F.min("entry_seq").alias("first"), F.count("*").alias("n_all"), F.count_if("ok").alias("n_ok"), *kinds)


def query_params_of(parts: DataFrame) -> DataFrame:
    """Query parameters: typed, and required, by the calls that succeeded where there are any."""
    calls = parts.where("name is null").select(*KEY, F.col("n_all").alias("calls"), F.col("n_ok").alias("ok_calls"))
    kind = lambda tag: F.coalesce(*[F.when(F.col(f"{k}_{tag}"), F.lit(k)) for k in VALUE_TYPES], F.lit("string"))
    required = F.when(F.col("ok_calls") > 0, F.col("n_ok") == F.col("ok_calls")).otherwise(F.col("n_all") == F.col("calls"))
    out = parts.where("name is not null").join(calls, KEY)
    return out.select(*KEY, "name", F.when(F.col("n_ok") > 0, kind("ok")).otherwise(kind("all")).alias("type"), required.alias("required"), "first")


def query_params(entries: DataFrame) -> DataFrame:
    return query_params_of(query_param_parts(entries))


def status_histogram(entries: DataFrame) -> DataFrame:
    """Counts by endpoint and status, status, class, and all: grouping sets in one pass."""
    keyed = with_template(entries).withColumn("class", F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    g = keyed.groupingSets([["method", "template", "status"], ["status"], ["class"], []], "method", "template", "status", "class")
    return g.agg(F.count("*").alias("count"))


def key_sets(entries: DataFrame) -> DataFrame:
    """By top-level keys (raw) of the bodies that are objects: how many of a scope's bodies have just these (n), by endpoint and scope."""
    keys = bodies(with_template(entries)).where(F.col("body").startswith("{")).select(*SCOPE, F.array_sort(F.json_object_keys("body")).alias("keys"))
    return keys.groupBy(*SCOPE, "keys").agg(F.count("*").alias("n"))


def version_mix(entries: DataFrame, versioned: DataFrame | None = None) -> DataFrame:
    return version_mix_of(key_sets(entries), versioned)


def version_mix_of(sets: DataFrame, versioned: DataFrame | None = None) -> DataFrame:
    """Scopes whose bodies fall into disjoint groups of extra keys: clusters, the commonest first. Endpoints that name a version (api_version in `versioned`) have none."""
    sets = sets.withColumn("total", F.sum("n").over(Window.partitionBy(*SCOPE)))  # a row a set of keys
    if versioned is not None:
        sets = sets.join(versioned.where("api_version is not null").select(*KEY), KEY, "left_anti")
    each = sets.select(*SCOPE, F.explode("keys").alias("k"), "n", "total").groupBy(*SCOPE, "k").agg(F.sum("n").alias("with"), F.first("total").alias("total"))
    core = each.where("`with` = total").groupBy(*SCOPE).agg(F.collect_set("k").alias("core"))
    own = F.array_sort(F.array_except("keys", F.coalesce("core", F.array().cast("array<string>"))))
    clusters = sets.join(core, SCOPE, "left").withColumn("own", own).where(F.size("own") > 0).groupBy(*SCOPE, "own").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.desc("n"), "own"))
    top = clusters.where(F.col("n").cast("double") / F.col("total") >= MIX_SHARE).withColumn("rank", rank).where(F.col("rank") <= MIX_CLUSTERS)
    found = top.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("rank", "own", "n"))).alias("c")).where(F.size("c") >= 2)
    disjoint = F.forall("c", lambda x: F.forall("c", lambda y: (x["rank"] == y["rank"]) | ~F.arrays_overlap(x["own"], y["own"])))
    return found.where(disjoint).select(*SCOPE, F.transform("c", lambda x: F.struct(x["own"].alias("keys"), x["n"].alias("n"))).alias("clusters"))


def greedy(pairs: Column) -> Column:
    """Of pairs (likeness, old, new, more), the likeliest first, those whose ends no pair before them took."""
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["likeness"] > b["likeness"], -1).when(a["likeness"] < b["likeness"], 1).when(a["old"] < b["old"], -1).when(a["old"] > b["old"], 1).when(a["new"] < b["new"], -1).when(a["new"] > b["new"], 1).otherwise(0))
    free = lambda seen, p: ~F.exists(seen, lambda s: (s["old"] == p["old"]) | (s["new"] == p["new"]))
    return F.reduce(ordered, F.slice(ordered, 1, 0), lambda seen, p: F.when(free(seen, p), F.concat(seen, F.array(p))).otherwise(seen))


def rename_candidates(mix: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of keys of the two commonest clusters that share a word and the type of their first value, matched greedily by likeness."""
    pairs = mix.select(*SCOPE, F.explode(F.element_at("clusters", 1)["keys"]).alias("old"), F.element_at("clusters", 2)["keys"].alias("_n")).select(*SCOPE, "old", F.explode("_n").alias("new"))
    scored = pairs.withColumn("likeness", name_similarity(F.col("old"), F.col("new"))).where("likeness > 0")
    wanted = scored.select(*SCOPE, F.col("old").alias("key")).union(scored.select(*SCOPE, "new")).distinct()
    values = bodies(with_template(entries)).where(F.col("body").startswith("{")).select(*SCOPE, "entry_seq", F.explode(F.map_entries(F.try_variant_get(F.try_parse_json("body"), "$", "map<string,variant>"))).alias("e"))
    typed = values.select(*SCOPE, "entry_seq", F.col("e.key").alias("key"), type_of(F.col("e.value")).alias("type")).where("type <> 'null'").join(wanted, [*SCOPE, "key"], "left_semi")
    first = typed.groupBy(*SCOPE, "key").agg(F.min_by("type", "entry_seq").alias("type"))
    both = scored.join(first.select(*SCOPE, F.col("key").alias("old"), F.col("type").alias("_old")), [*SCOPE, "old"]).join(first.select(*SCOPE, F.col("key").alias("new"), F.col("type").alias("_new")), [*SCOPE, "new"])
    chosen = both.where("_old = _new").groupBy(*SCOPE).agg(greedy(F.collect_list(F.struct("likeness", "old", "new"))).alias("p"))
    return chosen.select(*SCOPE, F.explode("p").alias("p")).select(*SCOPE, "p.old", "p.new", "p.likeness")
