"""Evidence for every field: presence, nulls, types, formats, enums, ranges and spellings.

All statistics are sums, minima and conjunctions: `*_parts` gathers them from observations, parts of
several batches merge (`plans/partial.py`), and the decisions are projections of them, so a contract
of merged parts is the contract of all observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wilson_lower_bound
from .observe import SCOPE

# Thresholds of the decisions.
REQUIRED_SHARE, LOW_COUNT = 0.98, 10
RARE_SHARE, RARE_COUNT = 0.50, 20
MAJORITY = 0.95
MINORITY_SPELLING = 0.10
ENUM_VALUES, ENUM_SAMPLES, ENUM_REPEAT, ENUM_CONFIDENT, ENUM_LENGTH = 8, 5, 2.0, 20, 24
FREE_TEXT = ["name", "title", "street", "city", "zip", "postal", "email", "message", "description", "url", "id"]
TYPES = ["boolean", "integer", "number", "string", "array", "object"]
FORMATS = {
    "uuid": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date-time": "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?$",
    "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "email": "^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$",
    "uri": "^https?://[^\\s/?#]+[^\\s]*$",
}
#: The time of a date-time that is one: hours to 23, minutes and seconds to 59, an offset below a day.
CLOCK = "^.{11}([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\\.[0-9]+)?)?([Zz]|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])?$"


def matches_format(text: Column, name: str) -> Column:
    fits = text.rlike(FORMATS[name])
    if name in ("date", "date-time"):
        fits = fits & F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull() & ~text.startswith("0000")
    return fits & text.rlike(CLOCK) if name == "date-time" else fits


def add_ambiguity(*kinds: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*kinds)))


def field_parts(observed: DataFrame) -> DataFrame:
    """Per field: seen, nulls, counts by type, and the range of its integers."""
    return observed.groupBy(*SCOPE, "parent", "path").agg(
        F.count("*").alias("seen"), F.count_if(F.col("type") == "null").alias("nulls"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES],
        F.min("int_value").alias("lo"), F.max("int_value").alias("hi"),
    )


def presence_of(fields: DataFrame) -> DataFrame:
    """Per field, with n (objects that could have it) and present."""
    objects = fields.select(*SCOPE, F.col("path").alias("parent"), F.col("n_object").alias("_n"))
    out = fields.join(objects, [*SCOPE, "parent"], "left")
    item = F.col("path").endswith("[]") | (F.col("path") == "")
    return out.withColumn("n", F.when(item, F.col("seen")).otherwise(F.col("_n"))).withColumn("present", F.least("seen", "n")).drop("_n")


def presence(observed: DataFrame) -> DataFrame:
    """Per field: n, present, nulls, and counts by type; the base of all decisions."""
    return presence_of(field_parts(observed))


def decide(fields: DataFrame) -> DataFrame:
    """Presence, nullability, types, conflicts and ranges of each field."""
    share = F.col("present").cast("double") / F.col("n")
    counts = F.array(*[F.struct(F.col(f"n_{t}").alias("count"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, t in enumerate(sorted(TYPES))])
    named = F.filter(counts, lambda c: c["count"] > 0)
    both = (F.col("n_integer") > 0) & (F.col("n_number") > 0)
    types = F.transform(F.filter(named, lambda c: ~(both & (c["type"] == "integer"))), lambda c: c["type"])
    total = F.aggregate(F.filter(named, lambda c: ~(both & (c["type"] == "integer"))), F.lit(0).cast("long"), lambda a, c: a + c["count"])
    top = F.array_max(F.filter(named, lambda c: ~(both & (c["type"] == "integer"))))
    scalar = (F.col("n_object") == 0) & (F.col("n_array") == 0)
    conflict = scalar & (F.size(types) >= 2) & (top["count"].cast("double") / total >= MAJORITY)
    optional = F.col("path").endswith("[]") | (F.col("path") == "")
    required = ~optional & (share >= REQUIRED_SHARE)
    rare = ~optional & (share < RARE_SHARE) & (F.col("n") >= RARE_COUNT)
    return fields.select(
        *SCOPE, "parent", "path", "n", "present", "nulls", "seen", F.array_sort(types).alias("observed_types"),
        F.when(conflict, F.map_from_entries(F.array_sort(F.transform(F.filter(named, lambda c: ~(both & (c["type"] == "integer"))), lambda c: F.struct(c["type"], c["count"]))))).alias("type_counts"),
        F.when(conflict, F.array(top["type"])).otherwise(F.array_sort(types)).alias("types"),
        F.round(wilson_lower_bound(F.col("present"), F.col("n")), 4).alias("presence_lb"), required.alias("required"), (F.col("nulls") > 0).alias("nullable"),
        F.round(F.col("nulls").cast("double") / F.col("seen"), 4).alias("null_rate"), F.when(required & (F.col("n") < LOW_COUNT), "low").alias("confidence"),
        add_ambiguity(F.when(rare, "rare_field"), F.when(conflict, "type_conflict")).alias("ambiguity"),
        F.when((F.col("n_integer") > 0) & (F.col("n_number") == 0) & (F.col("lo") < F.col("hi")), F.col("lo")).alias("lo"),
        F.when((F.col("n_integer") > 0) & (F.col("n_number") == 0) & (F.col("lo") < F.col("hi")), F.col("hi")).alias("hi"),
        F.when((F.col("n_integer") > 0) & (F.col("n_number") == 0) & (F.col("lo") >= 0), F.lit(0)).alias("minimum"),
    )


def text_parts(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per field with texts: how many, what all of them are (`is_<format>`, plain), and whether their values are too `many` to be told; and the values (text, n) of fields that may be an enum."""
    by = [*SCOPE, "path"]
    distinct = observed.where("type = 'string'").groupBy(*by, "text").agg(F.count("*").alias("n"))
    plain = (F.col("text") != "") & ~F.col("text").contains(" ") & (F.length("text") <= ENUM_LENGTH)
    fits = [F.bool_and(matches_format(F.col("text"), name)).alias(f"is_{name}") for name in FORMATS]
    stats = distinct.groupBy(*by).agg(F.sum("n").alias("texts"), F.bool_and(plain).alias("plain"), (F.count("*") > ENUM_VALUES).alias("many"), *fits)
    return stats, few_values(stats, distinct)


def few_values(stats: DataFrame, values: DataFrame) -> DataFrame:
    """The values (text, n) of the fields that may be an enum."""
    return values.join(stats.where("plain and not many").select(*SCOPE, "path"), [*SCOPE, "path"], "left_semi")


def strings_of(stats: DataFrame, values: DataFrame) -> DataFrame:
    """Per field with texts: their format (the first that all have), or the enum they look like."""
    by = [*SCOPE, "path"]
    few = values.groupBy(*by).agg(F.array_sort(F.collect_list("text")).alias("enum"))  # at most `ENUM_VALUES` a field
    name = F.regexp_extract(F.regexp_replace("path", "(\\[\\])+$", ""), "([^.]*)$", 1)
    form = F.coalesce(*[F.when(F.col(f"`is_{name}`"), F.lit(name)) for name in FORMATS])
    is_enum = F.col("format").isNull() & ~name.isin(*FREE_TEXT) & (F.col("texts") >= ENUM_SAMPLES) & (F.col("texts").cast("double") / F.size("enum") >= ENUM_REPEAT)
    confidence = F.round(F.least(F.lit(1.0), F.col("texts").cast("double") / F.lit(3.0 * ENUM_CONFIDENT)), 2)
    out = stats.join(few, by, "left").withColumn("format", form).withColumn("_enum", F.coalesce(is_enum, F.lit(False)))
    return out.select(*by, "format", F.when(F.col("_enum"), F.col("enum")).alias("enum"), F.when(F.col("_enum"), confidence).alias("enum_confidence"))


def strings(observed: DataFrame) -> DataFrame:
    return strings_of(*text_parts(observed))


def spelling_parts(observed: DataFrame) -> DataFrame:
    return observed.where("raw_key is not null").groupBy(*SCOPE, "path", "raw_key").agg(F.count("*").alias("n"))


def aliases_of(each: DataFrame) -> DataFrame:
    """Fields with more than one spelling (path, raw_key, n): spellings by count, and whether a lesser one is common."""
    by = [*SCOPE, "path"]
    found = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "raw_key"))).alias("s"), F.sum("n").alias("total"), F.max("n").alias("most")).where(F.size("s") > 1)
    mixed = (F.col("total") - F.col("most")).cast("double") / F.col("total") > MINORITY_SPELLING
    return found.select(*by, F.transform("s", lambda x: x["raw_key"]).alias("aliases"), F.when(mixed, "inconsistent_casing").alias("_casing"))


def aliases(observed: DataFrame) -> DataFrame:
    return aliases_of(spelling_parts(observed))


def profile_of(fields: DataFrame, texts: DataFrame, values: DataFrame, spellings: DataFrame) -> DataFrame:
    """Every field of every scope with all its decisions."""
    by = [*SCOPE, "path"]
    out = decide(presence_of(fields)).join(strings_of(texts, values), by, "left").join(aliases_of(spellings), by, "left")
    text = (F.size("types") == 1) & (F.get("types", F.lit(0)) == "string")
    for c in ("format", "enum", "enum_confidence"):
        out = out.withColumn(c, F.when(text, F.col(c)))
    return out.withColumn("ambiguity", F.array_distinct(F.array_compact(F.concat("ambiguity", F.array("_casing"))))).drop("_casing")


def field_profile(observed: DataFrame) -> DataFrame:
    return profile_of(field_parts(observed), *text_parts(observed), spelling_parts(observed))
