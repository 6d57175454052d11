"""A synthetic shop's log: as many lines as asked for, each made from its own number alone.

Lines are column expressions over a range, so any part of a log of any size comes out the same on
any cluster. Endpoints, statuses and optional fields follow fixed shares of a running number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endpoints by their share of twenty calls.
ENDPOINTS = [("GET", "/users", 4), ("GET", "/users/{n}", 5), ("POST", "/users", 2), ("GET", "/products", 4), ("GET", "/orders/{n}", 3), ("POST", "/orders", 2)]


def lines(spark: SparkSession, n: int, changed: bool = False) -> DataFrame:
    """entry_seq and value of n calls."""
    return lines_of(spark.range(n), changed)


def lines_of(numbers: DataFrame, changed: bool = False) -> DataFrame:
    """entry_seq and value of a call for each number (id); `changed`: users have a full_name instead of a name and no email."""
    i, r = F.col("id"), F.pmod(F.col("id") * 7919 + 13, F.lit(100))
    k, start, method, path = F.pmod(i, F.lit(20)), 0, F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, template, share in ENDPOINTS:
        here = (k >= start) & (k < start + share)
        method, path = F.when(here, verb).otherwise(method), F.when(here, F.replace(F.lit(template), F.lit("{n}"), F.pmod(i, F.lit(997)).cast("string"))).otherwise(path)
        start += share
    status = F.when(r < 3, 500).when(r < 9, 400).when(r < 17, 404).when(r % 4 == 0, 201).otherwise(200)
    person = F.concat(F.lit("person "), F.pmod(i, F.lit(89)).cast("string"))
    name = F.struct(i.alias("id"), person.alias("full_name"), F.when(i % 3 == 0, F.lit("en")).alias("language")) if changed else F.struct(i.alias("id"), person.alias("name"), F.concat(F.lit("p"), i.cast("string"), F.lit("@shop.example")).alias("email"), F.when(i % 3 == 0, F.lit("en")).alias("language"))
    good = F.to_json(name)
    bad = F.to_json(F.struct(F.when(status == 404, "not_found").when(status == 400, "validation_error").otherwise("internal_error").alias("error"), F.concat(F.lit("call "), i.cast("string")).alias("message")))
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + i * 31), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    asked = F.when(method == "POST", F.parse_json(F.to_json(F.struct(person.alias("name"), F.pmod(i, F.lit(5)).alias("count")))))
    headers = F.when(i % 10 < 7, F.create_map(F.lit("Authorization"), F.lit("Bearer <redacted>"))).otherwise(F.create_map().cast("map<string,string>"))
    row = F.struct(when.alias("timestamp"), method.alias("method"), path.alias("path"), status.alias("status"), headers.alias("headers"), asked.alias("request_body"), F.parse_json(F.when(status < 300, good).otherwise(bad)).alias("response_body"))
    return numbers.select(i.alias("entry_seq"), F.to_json(row).alias("value"))


def replay(log: DataFrame, folder: str, chunk: int) -> int:
    """Deals a log (entry_seq, value) into folders of `chunk` lines each below a folder, in order; returns how many lines."""
    log.withColumn("_part", F.floor(F.col("entry_seq") / chunk)).sortWithinPartitions("_part", "entry_seq").select("_part", "value").write.mode("overwrite").partitionBy("_part").text(folder)
    return log.count()
