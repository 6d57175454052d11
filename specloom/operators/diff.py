"""Differences between two contracts, as anti-joins and full outer joins of their tables.

A contract is two tables: `fields` (method, template, scope, path, types, required) and `params`
(method, template, name, location, type, required); endpoints and statuses are read off `fields`'
roots. `scope` is `request` or a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .observe import KEY

CHANGE = ["kind", "method", "template", "location", "detail", "breaking"]


def _change(kind: Column | str, location: Column, detail: Column, breaking: Column | bool) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [as_col(kind).alias("kind"), F.col("method"), F.col("template"), location.alias("location"), detail.alias("detail"), as_col(breaking).alias("breaking")]


def fmt_types(types: Column) -> Column:
    named = F.array_sort(F.filter(types, lambda t: t != "null"))
    return F.when(F.size(named) > 0, F.array_join(named, "|")).otherwise("any")


def location(scope: Column, path: Column) -> Column:
    return F.concat(F.when(scope == "request", F.lit("request.body")).otherwise(F.concat(F.lit("response."), scope, F.lit(".body"))), F.when(path == "", F.lit("")).when(path.startswith("[]"), path).otherwise(F.concat(F.lit("."), path)))


def top_most(rows: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """rows without those that lie under another row's path of the same group."""
    upper = rows.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(path).alias("_above")).distinct()
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    under = F.col(path).startswith(F.concat("_above", F.lit("."))) | F.col(path).startswith(F.concat("_above", F.lit("[]"))) | ((F.col("_above") == "") & (F.col(path) != ""))
    return rows.join(upper, same & under, "left_anti")


def in_warm(rows: DataFrame, warm: DataFrame | None, scope: Column) -> DataFrame:
    """rows with `_warm`: whether their scope had enough samples; true of all where nothing is said about samples."""
    if warm is None:
        return rows.withColumn("_warm", F.lit(True))
    known = warm.select(*[F.col(c).alias(f"_w_{c}") for c in KEY], F.col("scope").alias("_w_scope")).distinct()
    same = (F.col("method") == F.col("_w_method")) & (F.col("template") == F.col("_w_template")) & (scope == F.col("_w_scope"))
    return rows.join(known, same, "left").withColumn("_warm", F.col("_w_scope").isNotNull()).drop("_w_method", "_w_template", "_w_scope")


#: Kinds that say nothing while a scope warms up.
WARM_KINDS = ["field_added", "param_added", "became_required", "became_optional"]


def diff_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.select(*KEY).distinct(), new.select(*KEY).distinct()
    gone = a.join(b, KEY, "left_anti").select(*_change("endpoint_removed", F.lit("endpoint"), F.lit("endpoint removed"), True))
    return gone.unionByName(b.join(a, KEY, "left_anti").select(*_change("endpoint_added", F.lit("endpoint"), F.lit("endpoint added"), False)))


def in_both(old: DataFrame, new: DataFrame) -> DataFrame:
    """method and template of the endpoints that both tables have."""
    return old.select(*KEY).distinct().join(new.select(*KEY).distinct(), KEY, "left_semi")


def diff_statuses(old: DataFrame, new: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Statuses of the shared endpoints, those that both tables have if none are named (columns method, template, status)."""
    shared = in_both(old, new) if shared is None else shared
    a, b = (df.select(*KEY, "status").distinct().join(shared, KEY, "left_semi") for df in (old, new))
    place = F.concat(F.lit("response."), F.col("status").cast("string"))
    gone = a.join(b, [*KEY, "status"], "left_anti").select(*_change("status_removed", place, F.lit("status removed"), F.col("status").cast("string").startswith("2")))
    return gone.unionByName(b.join(a, [*KEY, "status"], "left_anti").select(*_change("status_added", place, F.lit("status added"), False)))


def diff_fields(old: DataFrame, new: DataFrame, warm: DataFrame | None = None) -> DataFrame:
    """Field changes in scopes that both have; nothing is said below a change of type or a field that came or went.

    warm (method, template, scope): where additions and changes of what is required are told; everywhere without it.
    """
    by = [*KEY, "scope"]
    shared = old.select(*by).distinct().join(new.select(*by).distinct(), by, "left_semi")
    side = lambda df, tag: df.join(shared, by, "left_semi").select(*by, "path", fmt_types(F.col("types")).alias(f"t{tag}"), F.coalesce("required", F.lit(False)).alias(f"r{tag}"), F.lit(True).alias(f"in{tag}"))
    both = side(old, 1).join(side(new, 2), [*by, "path"], "full_outer")
    known = (F.col("t1") != "any") & (F.col("t2") != "any")
    kind = (
        F.when(F.col("in2").isNull(), "field_removed").when(F.col("in1").isNull(), "field_added").when(known & (F.col("t1") != F.col("t2")), "type_changed")
        .when(F.col("path").endswith("[]") | (F.col("path") == ""), F.lit(None)).when(~F.col("r1") & F.col("r2"), "became_required").when(F.col("r1") & ~F.col("r2"), "became_optional")
    )
    changes = both.withColumn("kind", kind).where("kind is not null")
    cutting = changes.where("kind in ('field_removed', 'field_added', 'type_changed')")
    kept = top_most(cutting, by).unionByName(_not_under(changes.where("kind in ('became_required', 'became_optional')"), cutting, by))
    kept = in_warm(kept, warm, F.when(F.col("scope") == "request", F.lit("2xx")).otherwise(F.col("scope"))).where(F.col("_warm") | ~F.col("kind").isin(*WARM_KINDS))
    breaking = F.col("kind").isin("field_removed", "type_changed", "became_required") | ((F.col("kind") == "field_added") & (F.col("scope") == "request") & F.coalesce("r2", F.lit(False)))
    detail = F.when(F.col("kind") == "type_changed", F.concat_ws(" -> ", "t1", "t2")).when(F.col("kind") == "field_added", F.col("t2")).otherwise(F.col("t1"))
    return kept.select(*_change(F.col("kind"), location(F.col("scope"), F.col("path")), detail, breaking))


def _not_under(rows: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
    upper = above.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("path").alias("_above"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    under = F.col("path").startswith(F.concat("_above", F.lit("."))) | F.col("path").startswith(F.concat("_above", F.lit("[]")))
    return rows.join(upper, same & under, "left_anti")


def diff_params(old: DataFrame, new: DataFrame, warm: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Parameters of the shared endpoints; without `shared` an endpoint that has none on one side is passed over."""
    shared = in_both(old, new) if shared is None else shared
    by = [*KEY, "location", "name"]
    side = lambda df, tag: df.join(shared, KEY, "left_semi").select(*by, F.col("type").alias(f"t{tag}"), F.col("required").alias(f"r{tag}"))
    both = side(old, 1).join(side(new, 2), by, "full_outer")
    kind = (
        F.when(F.col("t2").isNull(), "param_removed").when(F.col("t1").isNull(), "param_added").when(F.col("t1") != F.col("t2"), "type_changed")
        .when(~F.col("r1") & F.col("r2"), "became_required").when(F.col("r1") & ~F.col("r2"), "became_optional")
    )
    found = in_warm(both.withColumn("kind", kind).where("kind is not null"), warm, F.lit("*")).where(F.col("_warm") | ~F.col("kind").isin(*WARM_KINDS))
    breaking = F.col("kind").isin("param_removed", "type_changed", "became_required") | ((F.col("kind") == "param_added") & F.col("r2"))
    detail = F.when(F.col("kind") == "type_changed", F.concat_ws(" -> ", "t1", "t2")).otherwise(F.coalesce("t2", "t1"))
    return found.select(*_change(F.col("kind"), F.concat_ws(".", F.col("location"), F.col("name")), detail, breaking))


def diff_bodies(old: DataFrame, new: DataFrame, warm: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Bodies that came or went at scopes of shared endpoints (columns method, template, scope)."""
    shared = in_both(old, new) if shared is None else shared
    by = [*KEY, "scope"]
    a, b = (df.select(*by).distinct().join(shared, KEY, "left_semi") for df in (old, new))
    gone = a.join(b, by, "left_anti").select(*_change("field_removed", location(F.col("scope"), F.lit("")), F.lit("body removed"), True))
    came = in_warm(b.join(a, by, "left_anti"), warm, F.when(F.col("scope") == "request", F.lit("2xx")).otherwise(F.col("scope"))).where("_warm")
    return gone.unionByName(came.select(*_change("field_added", location(F.col("scope"), F.lit("")), F.lit("body added"), False)))


def field_name(place: Column) -> Column:
    return F.regexp_extract(place, "([^.]*)$", 1)


def where_label(place: Column) -> Column:
    """A place in words: 200 response body, request body, query parameter, endpoint."""
    second = F.regexp_extract(place, "^[^.]*\\.([^.]*)", 1)
    return (
        F.when((place == "") | place.isNull() | (place == "endpoint"), "endpoint").when(place.startswith("request.body"), "request body").when(place.startswith("request."), F.concat(second, F.lit(" parameter")))
        .when(place == "request", "request").when(place.startswith("response."), F.concat(second, F.lit(" response body"))).otherwise(place)
    )


def kind_label(kind: Column) -> Column:
    words = F.regexp_replace(kind, "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def migration_hint(kind: Column, place: Column, detail: Column | None = None, breaking: Column | None = None) -> Column:
    """What a client does about a change."""
    name, asked = F.concat(F.lit("`"), field_name(place), F.lit("`")), place.startswith("request")
    told, breaks = F.lit("") if detail is None else F.coalesce(detail, F.lit("")), F.lit(False) if breaking is None else breaking
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    new = F.regexp_extract(told, "renamed to (\\S+)", 1)
    new = F.when(new == "", "the new name").otherwise(say("`", new, "`"))
    return (
        F.when((kind == "field_renamed") & asked, say("Send ", new, " instead of ", name, ": the old name is refused.")).when(kind == "field_renamed", say("Read ", new, " instead of ", name, ": the old name is gone."))
        .when(kind.isin("field_removed", "param_removed") & asked, say("Stop sending ", name, ".")).when(kind == "field_removed", say("Do without ", name, " in the ", where_label(place), "."))
        .when(kind == "type_changed", say("Read and check ", name, " by its new type: ", told, ".")).when(kind.isin("field_added", "param_added") & breaks, say("Send ", name, " with every request: others are refused."))
        .when((kind == "became_required") & asked, say("Always send ", name, ".")).when(kind == "became_required", say(name, " can be relied on now.")).when(kind == "became_optional", say("Be ready for answers without ", name, "."))
        .when(kind == "endpoint_removed", "Stop calling this endpoint.").when(kind == "endpoint_added", "Nothing to do: the endpoint is new.")
        .when(kind == "status_added", say("Be ready for this status (", told, ").")).when(kind == "status_removed", "Nothing to do: the status is no longer seen.").when(kind.isin("field_added", "param_added"), say(name, " is there to be used.")).otherwise("Look at this change.")
    )


def rule_summary(changes: DataFrame, shown: int = 4) -> DataFrame:
    """One row: how many changes break clients, at which endpoints (the first few) and of which kinds."""
    end = F.when(F.col("breaking"), F.concat_ws(" ", "method", "template"))
    out = changes.agg(F.count_if("breaking").alias("breaking"), F.count_if(~F.col("breaking")).alias("other"), F.array_sort(F.collect_set(end)).alias("_e"), F.array_sort(F.collect_set(F.when(F.col("breaking"), F.lower(kind_label(F.col("kind")))))).alias("_k"))
    at = F.concat(F.lit(" at "), F.array_join(F.slice("_e", 1, shown), ", "), F.when(F.size("_e") > shown, F.concat(F.lit(" and "), (F.size("_e") - shown).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    text = F.concat(F.col("breaking").cast("string"), F.lit(" breaking changes"), F.when(F.size("_e") > 0, at).otherwise(F.lit("")), F.when(F.size("_k") > 0, F.concat(F.lit(": "), F.array_join("_k", ", "))).otherwise(F.lit("")), F.lit("; "), F.col("other").cast("string"), F.lit(" other changes"))
    return out.select("breaking", "other", F.size("_e").alias("endpoints"), text.alias("summary"))


def releases(changes: DataFrame) -> DataFrame:
    """changes (burst, breaking) as versions from 1.0.0: a breaking burst lifts the major, any other the minor number."""
    from pyspark.sql import Window

    bursts = changes.groupBy("burst").agg(F.bool_or("breaking").alias("breaking"), F.count("*").alias("changes"))
    upto = Window.orderBy("burst")  # one row a release
    majors = F.sum(F.col("breaking").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    out = bursts.withColumn("major", majors + 1)
    minor = F.row_number().over(Window.partitionBy("major").orderBy("burst")) - F.when(F.col("major") > 1, 1).otherwise(0)
    return out.withColumn("minor", minor).select("burst", "breaking", "changes", F.concat_ws(".", F.col("major").cast("string"), F.col("minor").cast("string"), F.lit("0")).alias("version"))
