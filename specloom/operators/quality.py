"""Quality of inferred contracts: confidence of endpoints, scores against a clean log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .observe import KEY

# Limits of confidence.
LOW_SAMPLES, MEDIUM_SAMPLES = 10, 30
SERIOUS = ["type_conflict", "possible_version_mix", "inconsistent_casing"]


def ambiguities(profile: DataFrame) -> DataFrame:
    """Every ambiguity with its place."""
    return profile.select(*KEY, "scope", "path", F.explode("ambiguity").alias("kind"))


def endpoint_confidence(endpoints: DataFrame, profile: DataFrame, mixes: DataFrame | None = None) -> DataFrame:
    """high, medium or low for each endpoint."""
    marks = profile.groupBy(*KEY).agg(F.coalesce(F.bool_or(F.col("confidence") == "low"), F.lit(False)).alias("low_field"), F.bool_or(F.arrays_overlap("ambiguity", F.array(*map(F.lit, SERIOUS)))).alias("serious"), F.sum(F.size("ambiguity")).alias("ambiguities"))
    out = endpoints.select(*KEY, "sample_count").join(marks, KEY, "left")
    if mixes is not None:
        out = out.join(mixes.select(*KEY, F.lit(True).alias("_mix")).distinct(), KEY, "left").withColumn("serious", F.coalesce("serious", F.lit(False)) | F.coalesce("_mix", F.lit(False))).drop("_mix")
    low = F.coalesce("serious", F.lit(False)) | F.coalesce("low_field", F.lit(False)) | (F.col("sample_count") < LOW_SAMPLES)
    confidence = F.when(low, "low").when(F.col("sample_count") < MEDIUM_SAMPLES, "medium").otherwise("high")
    return out.select(*KEY, "sample_count", F.coalesce("ambiguities", F.lit(0)).cast("long").alias("ambiguities"), confidence.alias("confidence"))


def parse_rate(entries: DataFrame) -> DataFrame:
    """One row: lines read, skipped, and the share read (1 of none)."""
    read, skipped = F.count_if(F.col("skip_reason").isNull()), F.count_if(F.col("skip_reason").isNotNull())
    return entries.agg(read.alias("read"), skipped.alias("skipped"), F.round(F.coalesce(F.try_divide(read.cast("double"), (read + skipped).cast("double")), F.lit(1.0)), 4).alias("parse_rate"))


def scorecard(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """One row: the noisy log's field profile held against the clean one's, over the endpoints that both have."""
    by = [*KEY, "scope", "path"]
    shared = clean.select(*KEY).distinct().join(noisy.select(*KEY).distinct(), KEY, "left_semi")
    side = lambda df, tag: df.where("path <> '' and not endswith(path, '[]')").join(shared, KEY, "left_semi").select(*by, F.col("required").alias(f"r{tag}"), F.col("nullable").alias(f"n{tag}"), F.col("enum").isNotNull().alias(f"e{tag}"), F.lit(True).alias(f"in{tag}"))
    both = side(clean, 1).join(side(noisy, 2), by, "full_outer")
    hit = F.col("in1") & F.col("in2")
    counts = both.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("in1").isNull()).alias("fp"), F.count_if(F.col("in2").isNull()).alias("fn"), F.count_if(hit & (F.col("r1") == F.col("r2"))).alias("_r"), F.count_if(hit & (F.col("n1") == F.col("n2"))).alias("_n"), F.count_if(hit & F.col("e2") & ~F.col("e1")).alias("false_enums"))
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a.cast("double") / b)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(F.col("_r"), tp).alias("required_accuracy"), ratio(F.col("_n"), tp).alias("nullable_accuracy"), "false_enums")


def status_coverage(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many (endpoint, status) of the truth were found."""
    by = [*KEY, "status"]
    return truth.select(*by).distinct().join(found.select(*by).distinct().withColumn("_hit", F.lit(True)), by, "left").agg(F.count_if("_hit").alias("covered"), F.count("*").alias("total"))
