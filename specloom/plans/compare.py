"""All differences of two contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff
from .build import Contract


def diff_contracts(old: Contract, new: Contract, warm: DataFrame | None = None) -> DataFrame:
    """warm: as in diff.diff_fields."""
    statuses = lambda c: c.endpoints.select("method", "template", F.explode("statuses").alias("status"))
    shared = diff.in_both(old.endpoints, new.endpoints)
    out = diff.diff_endpoints(old.endpoints, new.endpoints).unionByName(diff.diff_statuses(statuses(old), statuses(new), shared))
    key = ["method", "template"]
    answered = statuses(old).join(statuses(new), [*key, "status"]).select(*key, F.col("status").cast("string").alias("scope"))
    scopes = answered.unionByName(shared.withColumn("scope", F.lit("request")))  # a status that came or went is told as such alone
    bodies = [c.profile.where("path = ''").join(scopes, [*key, "scope"], "left_semi") for c in (old, new)]
    for more in (diff.diff_params(old.params(), new.params(), warm, shared), diff.diff_bodies(*bodies, warm, shared), diff.diff_fields(old.profile, new.profile, warm)):
        out = out.unionByName(more)
    return out.withColumn("hint", diff.migration_hint(F.col("kind"), F.col("location"), F.col("detail"), F.col("breaking")))
