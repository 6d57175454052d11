"""The test tables as HTTP logs: one event is one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread

#: The same body in both dialects: fields come and go with event_id.
_BODY = """concat('{"id":', event_id, ',"type":"', event_type, '"', CASE WHEN event_id % 5 <> 0 THEN concat(',"cents":', CAST(round(value * 100) AS BIGINT)) ELSE '' END,
 CASE WHEN event_id % 7 = 0 THEN ',"note":null' WHEN event_id % 7 = 1 THEN '' ELSE concat(',"note":"n', event_id % 3, '"') END,
 CASE WHEN event_id % 40 = 0 THEN ',"level":"high"' ELSE concat(',"level":', event_id % 4) END, ',"user":{"userId":', user_id, CASE WHEN event_id % 2 = 0 THEN ',"day":"2024-01-02"' ELSE '' END, '}}')"""

FIELDS = """event_id AS entry_seq, CAST(ts AS @TEXT) AS timestamp, CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
 CASE event_type WHEN 'view' THEN concat('/users/', user_id) WHEN 'click' THEN concat('/users/', user_id, '/events/', event_id) WHEN 'signup' THEN '/users' WHEN 'purchase' THEN '/orders' ELSE concat('/orders/', event_id) END AS path,
 CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'error' THEN 500 ELSE 201 END AS status,
 CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS request_body, @BODY AS response_body""".replace("@BODY", _BODY)

#: The view `logs` for DuckDB, with the templates of the five paths.
LOGS_SQL = "WITH logs AS (SELECT *, regexp_replace(regexp_replace(path, '^/users/[0-9]+/events/[0-9]+$', '/users/{userId}/events/{eventId}'), '^/(users|orders)/[0-9]+$', '/\\1/{id}') AS template FROM (SELECT " + FIELDS.replace("@TEXT", "VARCHAR") + " FROM events))"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr(*_split(FIELDS.replace("@TEXT", "STRING")))
    headers = F.when(F.col("entry_seq") % 4 != 0, F.create_map(F.lit("Authorization"), F.lit("Bearer x"))).otherwise(F.create_map().cast("map<string,string>"))
    return raw.withColumns({"query": F.create_map().cast("map<string,string>"), "headers": headers, "flags": F.array().cast("array<string>")})


def _split(fields: str) -> list[str]:
    """A list of SQL expressions, cut at the commas outside brackets and quotes."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(fields):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]
