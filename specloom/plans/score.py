"""A damaged log's contract held against the clean log's, and what error responses it knows of.

`split` deals the lines of a log into training and holdout by their own text, so both halves of a
clean and of a damaged copy are of the same calls if they are dealt before the damage. The truth about
error responses is what the holdout observed.

Cases: a build that fails is a row of the result (`crash_count`), not an exception; two empty logs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import errors, quality
from ..operators.endpoints import endpoints
from ..operators.observe import KEY, with_template
from .build import build


def in_holdout(line: Column, share: float = 0.2, seed: int = 0) -> Column:
    """Whether a line is held out; the same for the same line."""
    return F.pmod(F.xxhash64(F.lit(seed), line), F.lit(1_000_000)) < int(share * 1_000_000)


def split(lines: DataFrame, share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and holdout of lines (entry_seq, value)."""
    held = in_holdout(F.col("value"), share, seed)
    return lines.where(~held), lines.where(held)


def observed_statuses(entries: DataFrame) -> DataFrame:
    return endpoints(with_template(entries)).select(*KEY, F.explode("statuses").alias("status"))


def coverage(entries: DataFrame, holdout: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Two rows: how many of the holdout's statuses the entries' contract has, as observed and with inferred responses."""
    truth, seen = observed_statuses(holdout), observed_statuses(entries)
    inferred = errors.inferred_responses(entries, observed).select(*KEY, "status")
    rows = [quality.status_coverage(truth, found).select(F.lit(name).alias("responses"), "covered", "total") for name, found in (("observed", seen), ("inferred", seen.unionByName(inferred)))]
    share = F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 4)).otherwise(F.lit(1.0))
    return rows[0].unionByName(rows[1]).withColumn("coverage", share)


def run(clean: DataFrame, noisy: DataFrame, holdout: DataFrame | None = None) -> dict:
    """The whole scorecard of three sets of accepted entries."""
    found: dict = {"crash_count": 0}
    built = {}
    for name, log in (("clean", clean), ("noisy", noisy)):
        try:
            built[name] = build(log)
            built[name].profile.count()
        except Exception as error:  # a crash is a result
            return found | {"crash_count": 1, f"{name}_build_error": f"{type(error).__name__}: {str(error)[:200]}"}
    ends = {name: c.endpoints.select(*KEY) for name, c in built.items()}
    found |= {"endpoints_clean": ends["clean"].count(), "endpoints_noisy": ends["noisy"].count(), "endpoints_shared": ends["clean"].join(ends["noisy"], KEY, "left_semi").count()}
    found |= quality.scorecard(built["clean"].profile, built["noisy"].profile).first().asDict()
    if holdout is not None:
        try:
            for r in coverage(built["noisy"].entries, holdout, built["noisy"].observed).collect():
                found[f"error_coverage_{r['responses']}"] = {"covered": r["covered"], "total": r["total"], "coverage": r["coverage"]}
        except Exception as error:
            found |= {"crash_count": 1, "holdout_build_error": f"{type(error).__name__}: {str(error)[:200]}"}
    for c in built.values():
        c.release()
    return found
