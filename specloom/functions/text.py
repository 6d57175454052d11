"""Column functions over keys, names and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(key: Column) -> Column:
    """snake_case of any spelling of a key; the key itself where nothing is left."""
    snake = F.regexp_replace(F.regexp_replace(key, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    flat = F.regexp_replace(F.lower(F.regexp_replace(snake, "[- ]", "_")), "^_+|_+$", "")
    plain = key.rlike(r"\A[a-z0-9]([a-z0-9_]*[a-z0-9])?\z")  # most keys are, and one look is cheaper than five
    return F.when(plain | (flat == ""), key).otherwise(flat)


def name_tokens(name: Column) -> Column:
    """Distinct lower-cased words of a name in camel, snake or kebab case."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the two names' words; 0 without words."""
    x, y = name_tokens(a), name_tokens(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def wilson_lower_bound(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share at confidence z; 0 without observations."""
    k, m, one, zz = successes.cast("double"), n.cast("double"), F.lit(1.0), F.lit(z * z)
    p = k / m
    centre = p + zz / (F.lit(2.0) * m)
    spread = F.lit(z) * F.sqrt((p * (one - p) + zz / (F.lit(4.0) * m)) / m)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (one + zz / m)))


def mask_header(name: Column, value: Column) -> Column:
    """A header's value with its secret taken out; a bearer scheme stays readable."""
    secret = F.lower(name).isin("authorization", "x-api-key", "cookie")
    return F.when(secret, F.when(F.lower(value).startswith("bearer "), F.lit("Bearer <redacted>")).otherwise(F.lit("<redacted>"))).otherwise(value)


def quoted(text: Column) -> Column:
    """A text as JSON; null of null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.array(text)), "(?s)^.(.*).$", 1))
