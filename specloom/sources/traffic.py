"""Traffic of an applications service, in which calls depend on earlier ones and the contract drifts.

A call comes of its number alone: what it does by a hash of the number, the application that it is
about by an as-of lookup of the call that made it, and the contract version in force by an as-of
lookup in a schedule. Any part of a log, of any table's numbers, comes out the same on any cluster.

Cases: a call about an application before any was made asks for the list instead; repeated numbers
are repeated calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import as_of

# What calls do, by their share of a hundred; how far back a call looks for its application.
SCENARIOS = [("create", 15), ("list", 20), ("read", 40), ("update", 15), ("withdraw", 10)]
BACK = 40
#: Versions of the contract, each with what it changes: a field renamed, of another type, dropped, or added.
VERSIONS = {0: "as at first", 1: "nationality becomes citizenship", 2: "pages is a text", 3: "updated_at is gone", 4: "tracking_number is new"}


def _roll(number: Column, what: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(what), number), F.lit(100)).cast("int")


def scenario(number: Column) -> Column:
    roll, out, upto = _roll(number, "scenario"), F.lit(None).cast("string"), 0
    for name, share in SCENARIOS:
        out, upto = F.when((roll >= upto) & (roll < upto + share), name).otherwise(out), upto + share
    return out


def calls(numbers: DataFrame, schedule: DataFrame) -> DataFrame:
    """id, scenario, application and version of a call for each number (id); schedule: id (from which on) and version."""
    own = numbers.select(F.col("id").cast("long").alias("id")).withColumn("scenario", scenario(F.col("id")))
    own = as_of(own, schedule.select("id", F.col("version").cast("int").alias("version")), "id", "version")
    made = own.where("scenario = 'create'").select("id", F.col("id").alias("application"))
    asked = own.withColumn("_from", F.when(F.col("scenario").isin("read", "update", "withdraw"), F.col("id") - 1 - F.pmod(F.xxhash64(F.lit("back"), "id"), F.lit(BACK))))
    out = as_of(asked, made, "id", "application", at="_from").drop("_from")
    out = out.withColumn("application", F.when(F.col("scenario") == "create", F.col("id")).otherwise(F.col("application")))
    lost = F.col("scenario").isin("read", "update", "withdraw") & F.col("application").isNull()
    return out.select("id", F.when(lost, F.lit("list")).otherwise(F.col("scenario")).alias("scenario"), "application", F.coalesce("version", F.lit(0)).alias("version"))


def body(application: Column, version: Column) -> Column:
    """An application as its contract's version shows it (JSON)."""
    since = lambda k: version >= k
    land = F.element_at(F.array(*map(F.lit, ["NL", "DE", "FR", "ES"])), (F.pmod(application, F.lit(4)) + 1).cast("int"))
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.lit("{"), F.concat_ws(
        ",", member("id", text(F.concat(F.lit("PA-"), application.cast("string")))), F.when(since(1), member("citizenship", text(land))).otherwise(member("nationality", text(land))),
        F.when(since(2), member("pages", text(F.lit("32")))).otherwise(member("pages", F.lit("32"))), F.when(~since(3), member("updated_at", text(F.lit("2024-01-02T03:04:05Z")))), F.when(since(4), member("tracking_number", text(application.cast("string")))),
    ), F.lit("}"))


def entries(found: DataFrame) -> DataFrame:
    """Log entries of calls."""
    kind, at = F.col("scenario"), F.concat(F.lit("/applications/"), F.col("application").cast("string"))
    method = F.when(kind == "create", "POST").when(kind == "update", "PATCH").when(kind == "withdraw", "DELETE").otherwise("GET")
    none = F.create_map().cast("map<string,string>")
    return found.select(
        F.col("id").alias("entry_seq"), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), method.alias("method"),
        F.when(kind.isin("create", "list"), F.lit("/applications")).otherwise(at).alias("path"), none.alias("query"), F.when(kind == "create", 201).when(kind == "withdraw", 204).otherwise(200).alias("status"),
        F.when(kind == "create", body(F.col("application"), F.col("version"))).alias("request_body"), F.when(kind.isin("create", "read", "update"), body(F.col("application"), F.col("version"))).alias("response_body"),
        none.alias("headers"), F.array().cast("array<string>").alias("flags"),
    )
