"""Bodies held against a contract: every value that breaks it, with its place and why.

Cases: endpoints and scopes that the contract doesn't know are passed over; a value below an
unknown field is not told apart from it; null breaks a field that is not nullable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import top_most
from .observe import SCOPE


def problems(observed: DataFrame, profile: DataFrame) -> DataFrame:
    """The scope, entry_seq, path, problem (missing, unknown_field, wrong_type, not_in_enum, below_minimum) and count of each field of a body that breaks the contract.

    profile has a row a field: its size is the contract's, and Spark broadcasts it or not by what it measures.
    """
    by = [*SCOPE, "entry_seq", "path"]
    known = profile.select(*SCOPE, "path", "types", "nullable", "enum", "minimum", F.lit(True).alias("_known"))
    scopes = profile.select(*SCOPE).distinct()
    seen = observed.join(scopes, SCOPE, "left_semi")
    each = seen.where("path <> ''").join(known, [*SCOPE, "path"], "left")
    fits = F.array_contains("types", F.col("type")) | ((F.col("type") == "integer") & F.array_contains("types", "number")) | ((F.col("type") == "null") & F.col("nullable"))
    why = (
        F.when(F.col("_known").isNull(), "unknown_field").when((F.size("types") > 0) & ~fits, "wrong_type")
        .when((F.col("type") == "string") & F.col("enum").isNotNull() & ~F.array_contains("enum", F.col("text")), "not_in_enum")
        .when((F.col("type") == "integer") & (F.col("int_value") < F.col("minimum")), "below_minimum")
    )
    wrong = each.withColumn("problem", why).where("problem is not null").groupBy(*by, "problem").agg(F.count("*").alias("count"))
    unknown = top_most(wrong.where("problem = 'unknown_field'"), [*SCOPE, "entry_seq"])
    needed = profile.where("required and parent is not null").select(*SCOPE, F.col("parent").alias("_at"), "path")
    objects = seen.where("type = 'object'").groupBy(*SCOPE, "entry_seq", F.col("path").alias("_at")).agg(F.count("*").alias("_objects"))
    have = seen.groupBy(*by).agg(F.count("*").alias("_have"))
    lacking = objects.join(needed, [*SCOPE, "_at"]).join(have, by, "left").withColumn("count", F.col("_objects") - F.coalesce("_have", F.lit(0)))
    missing = lacking.where("count > 0").select(*by, F.lit("missing").alias("problem"), "count")
    return wrong.where("problem <> 'unknown_field'").unionByName(unknown).unionByName(missing)
