"""From a log to its contract: all tables of one build, and the document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import endpoints as E
from ..operators import errors, quality
from ..operators.observe import bodies, observe, with_template
from ..operators.profile import profile_of
from . import render
from .partial import Parts, parts_of


@dataclass
class Contract:
    """The tables of a contract, as lazy DataFrames over the accepted entries, or over merged parts (then without entries)."""

    entries: DataFrame | None
    observed: DataFrame | None
    endpoints: DataFrame
    profile: DataFrame
    path_params: DataFrame
    query_params: DataFrame
    examples: DataFrame
    mixes: DataFrame
    inferred: DataFrame | None

    def params(self) -> DataFrame:
        from pyspark.sql import functions as F

        key = ["method", "template"]
        a = self.path_params.select(*key, "name", F.lit("path").alias("location"), "type", F.lit(True).alias("required"))
        return a.unionByName(self.query_params.select(*key, "name", F.lit("query").alias("location"), "type", "required"))

    def release(self) -> None:
        """Gives back what the build keeps."""
        for kept in (self.observed, self.entries):
            if kept is not None:
                kept.unpersist()

    def quality(self) -> DataFrame:
        return quality.endpoint_confidence(self.endpoints, self.profile, self.mixes)

    def spec(self, title: str = "Observed API") -> dict:
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()] if df is not None else []  # noqa: E731  of the contract's size
        return render.build_spec(rows(self.endpoints), rows(self.profile), rows(self.path_params), rows(self.query_params), rows(self.inferred), rows(self.examples), title)


def contract_of(parts: Parts, entries: DataFrame | None = None, observed: DataFrame | None = None, inferred: DataFrame | None = None) -> Contract:
    """The contract that parts add up to."""
    found = E.endpoints_of(parts.endpoints)
    profile = profile_of(parts.fields, parts.texts, parts.values, parts.spellings)
    return Contract(entries, observed, found, profile, E.path_params_of(parts.path_params), E.query_params_of(parts.query_params), E.examples_of(parts.examples), E.version_mix_of(parts.key_sets, found), inferred)


def build(entries: DataFrame, infer_errors: bool = False, depth: int | None = None) -> Contract:
    keyed = with_template(entries).persist(StorageLevel.MEMORY_AND_DISK)  # read by every table; release() gives it back
    observed = observe(bodies(keyed), depth).persist(StorageLevel.MEMORY_AND_DISK)
    inferred = errors.inferred_responses(keyed, observed) if infer_errors else None
    return contract_of(parts_of(keyed, observed), keyed, observed, inferred)
