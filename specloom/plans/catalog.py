"""Registered queries over the test tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import asof, conform, diff, endpoints, errors, noise, quality, reads, resolve
from ..operators.observe import SCOPE, bodies, observe, with_template
from ..operators.profile import aliases, field_profile, presence, strings
from ..sources import shop, traffic
from ..sources.logs import parse_lines, skip_tally
from ..sources.spread import spread
from ..scratch import scratch
from ..streaming import state, tracker
from ..streaming.watch import recent_changes
from . import documents as D
from . import fold, partial, score
from .adapter import LOGS_SQL, entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEPTH = 2  # of the adapter's bodies


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe(bodies(entries(spark, sf_dir)), DEPTH).persist(StorageLevel.MEMORY_AND_DISK)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


_PATHS = {"id": "", "type": "", "cents": "", "note": "", "level": "", "user": "", "user.user_id": "user", "user.day": "user"}
_RAW = {"user.user_id": "user.userId"}
#: Observations of the adapter's bodies, with DuckDB's JSON functions.
_OBS = LOGS_SQL + ", obs AS (" + " UNION ALL ".join(
    f"SELECT method, template, CAST(status AS VARCHAR) AS scope, entry_seq, '{p}' AS path, '{parent}' AS parent, json_type(response_body, '$.{_RAW.get(p, p)}') AS jt, response_body->>'$.{_RAW.get(p, p)}' AS txt FROM logs WHERE json_type(response_body, '$.{_RAW.get(p, p)}') IS NOT NULL"
    for p, parent in _PATHS.items()
) + " UNION ALL SELECT method, template, 'request', entry_seq, 'k', '', json_type(request_body, '$.k'), request_body->>'$.k' FROM logs WHERE json_type(request_body, '$.k') IS NOT NULL)"
_KIND = "CASE jt WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' ELSE 'array' END"
_FIELDS = _OBS + f""", calls AS (SELECT method, template, CAST(status AS VARCHAR) AS scope, count(*) AS n FROM logs GROUP BY ALL UNION ALL SELECT method, template, 'request', count(*) FROM logs WHERE request_body IS NOT NULL AND status BETWEEN 200 AND 299 GROUP BY ALL),
fields AS (SELECT method, template, scope, path, n, count(*) AS present, count(*) FILTER ({_KIND} = 'null') AS nulls, count(*) FILTER ({_KIND} = 'integer') AS ints, count(*) FILTER ({_KIND} = 'string') AS texts, min(CASE WHEN {_KIND} = 'integer' THEN CAST(txt AS BIGINT) END) AS lo, max(CASE WHEN {_KIND} = 'integer' THEN CAST(txt AS BIGINT) END) AS hi FROM obs JOIN calls USING (method, template, scope) GROUP BY method, template, scope, path, n)"""
_ID = "({0} SIMILAR TO '[0-9]+' OR regexp_full_match({0}, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') OR regexp_full_match({0}, '[0-9a-fA-F]{{24}}') OR (regexp_full_match({0}, '[A-Za-z0-9_-]{{8,}}') AND regexp_matches({0}, '[0-9]')))"
_SPLIT = "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[^/?#]*://[^/?#]*', ''), '#.*$', ''), '\\?.*$', '') AS rest, regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) AS query FROM pages"


@query(LOGS_SQL + " SELECT method, template, count(*) AS sample_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, list_sort(list_distinct(list(status))) AS statuses FROM logs GROUP BY method, template")
def endpoint_inventory(spark, sf_dir):
    return endpoints.endpoints(entries(spark, sf_dir)).select("method", "template", "sample_count", "first_seen", "last_seen", F.transform("statuses", lambda s: s).alias("statuses"))


@query(f"SELECT page_id, CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS path, query FROM ({_SPLIT})")
def url_split(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("u", P.split_url(F.col("url"))).select("page_id", "u.path", "u.query")


@query(f"SELECT page_id, replace(url_decode(replace(split_part(p, '=', 1), '+', ' ')), '', '') AS name, url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' ')) AS value FROM (SELECT page_id, unnest(string_split(query, '&')) AS p FROM ({_SPLIT}) WHERE query LIKE '%=%') WHERE p <> ''")
def query_params(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("u", P.split_url(F.col("url")))
    return pages.select("page_id", F.explode(P.query_params(F.col("u.query"))).alias("name", "value"))


@query(f"SELECT page_id, segment, {_ID.format('segment')} AS is_id FROM (SELECT page_id, unnest(string_split(rest, '/')) AS segment FROM ({_SPLIT})) WHERE segment <> ''")
def id_segments(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("u", P.split_url(F.col("url")))
    return pages.select("page_id", F.explode(F.filter(F.split("u.path", "/"), lambda s: s != "")).alias("segment")).withColumn("is_id", P.is_id_segment(F.col("segment")))


_LOW = "lower(b.before)"
_SINGULAR = f"""CASE WHEN {_LOW} LIKE '%ies' AND length(b.before) > 3 THEN b.before[:-4] || 'y' WHEN {_LOW} LIKE '%sses' OR {_LOW} LIKE '%xes' OR {_LOW} LIKE '%ches' OR {_LOW} LIKE '%shes' THEN b.before[:-3]
 WHEN {_LOW} LIKE '%s' AND {_LOW} NOT LIKE '%ss' AND length(b.before) > 1 THEN b.before[:-2] ELSE b.before END"""
_CAMEL = "CASE WHEN len(w) = 0 THEN 'id' ELSE lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') END"
#: The segments of each page's path, and the templates: names by the segment before, numbered within a path.
_TEMPLATES = f"""WITH p AS (SELECT page_id, list_filter(string_split(rest, '/'), lambda s: s <> '') AS parts FROM ({_SPLIT})),
 g AS (SELECT page_id, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS i FROM p),
 m AS (SELECT *, {_ID.format('text')} AS is_id, lag(text) OVER (PARTITION BY page_id ORDER BY i) AS last FROM g),
 b AS (SELECT *, count(*) FILTER (is_id) OVER (PARTITION BY page_id) AS ids, CASE WHEN last IS NOT NULL AND NOT {_ID.format('last')} THEN last END AS before FROM m),
 w AS (SELECT *, list_filter(string_split_regex({_SINGULAR}, '[-_.]'), lambda x: x <> '') AS w FROM b),
 n AS (SELECT *, CASE WHEN ids = 1 OR before IS NULL THEN 'id' ELSE {_CAMEL} || 'Id' END AS name FROM w),
 u AS (SELECT *, row_number() OVER (PARTITION BY page_id, is_id, name ORDER BY i) AS k FROM n),
 t AS (SELECT page_id, string_agg(CASE WHEN is_id THEN '{{' || name || CASE WHEN k > 1 THEN CAST(k AS VARCHAR) ELSE '' END || '}}' ELSE text END, '/' ORDER BY i) AS t FROM u GROUP BY page_id)"""


@query(_TEMPLATES + " SELECT page_id, '/' || coalesce(t, '') AS template FROM p LEFT JOIN t USING (page_id)")
def path_template(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("t", P.path_template(P.split_url(F.col("url"))["path"])).select("page_id", "t.template")


_LONGER = "CASE WHEN page_id % 3 = 0 THEN '/users/' || page_id || '/line-items/' || (page_id * 7) || rest WHEN page_id % 3 = 1 THEN '/' || page_id || '/' || page_id || rest ELSE '/boxes/' || page_id || '/boxes/ab-' || (100000 + page_id) || rest END"


@query(_TEMPLATES.replace(f"FROM ({_SPLIT})", f"FROM (SELECT page_id, {_LONGER} AS rest FROM ({_SPLIT}))") + " SELECT page_id, '/' || coalesce(t, '') AS template FROM p LEFT JOIN t USING (page_id)")
def path_template_of_many_ids(spark, sf_dir):
    """Paths of two ids and more: the pages' own, below others."""
    rest = F.expr(_LONGER.replace("'/users/' || page_id || '/line-items/'", "concat('/users/', page_id, '/line-items/')").replace("rest", "u.path"))
    pages = _pages(spark, sf_dir).withColumn("u", P.split_url(F.col("url")))
    return pages.withColumn("t", P.path_template(rest)).select("page_id", "t.template")


@query(LOGS_SQL + ", s AS (SELECT *, CAST(status // 100 AS VARCHAR) || 'xx' AS class FROM logs) SELECT method, template, status, class, count(*) AS count FROM s GROUP BY GROUPING SETS ((method, template, status), (status), (class), ())")
def status_histogram(spark, sf_dir):
    return endpoints.status_histogram(entries(spark, sf_dir))


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'non_object' WHEN 2 THEN 'no_method' ELSE 'no_status' END AS skip_reason, count(*) AS count FROM events WHERE event_id % 5 <> 4 GROUP BY 1")
def parse_skip_tally(spark, sf_dir):
    line = "CASE event_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"path\":\"/a\",\"status\":200}' WHEN 3 THEN '{\"verb\":\"get\",\"url\":\"/a\",\"status\":\"none\"}' ELSE '{\"httpMethod\":\"get\",\"uri\":\"/a?x=1\",\"statusCode\":\"200 OK\"}' END AS value"
    return skip_tally(parse_lines(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS entry_seq", line)))


@query("SELECT event_id AS entry_seq, 'POST' AS method, '/users/' || user_id AS path, 200 + CAST(event_id % 4 AS INTEGER) AS status, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'status_coerced' ELSE '' END AS flags, '{\"k\":' || CAST(user_id AS VARCHAR) || '}' AS request_body FROM events")
def line_parse(spark, sf_dir):
    line = "concat('{\"request\":{\"httpMethod\":\"post\",\"url\":\"http://h.example/users/', user_id, '?kind=', event_type, '\",\"body\":\"{\\\\\"k\\\\\":', user_id, '}\"},\"response\":{\"statusCode\":', CASE WHEN event_id % 2 = 0 THEN concat('\"', 200 + event_id % 4, ' Fine\"') ELSE cast(200 + event_id % 4 AS STRING) END, '}}') AS value"
    out = parse_lines(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS entry_seq", line))
    return out.select("entry_seq", "method", "path", "status", F.col("query")["kind"].alias("kind"), F.array_join("flags", ",").alias("flags"), "request_body")


@query(_FIELDS + " SELECT method, template, scope, path, CASE WHEN path LIKE 'user.%' THEN n ELSE n END AS n, present, nulls FROM fields")
def field_presence(spark, sf_dir):
    return presence(_observed(spark, sf_dir)).where("path <> ''").select("method", "template", "scope", "path", "n", "present", "nulls")


_WILSON = "greatest(0.0::DOUBLE, (present::DOUBLE / n::DOUBLE + (1.96 * 1.96)::DOUBLE / (2.0::DOUBLE * n::DOUBLE) - 1.96::DOUBLE * sqrt((present::DOUBLE / n::DOUBLE * (1.0::DOUBLE - present::DOUBLE / n::DOUBLE) + (1.96 * 1.96)::DOUBLE / (4.0::DOUBLE * n::DOUBLE)) / n::DOUBLE)) / (1.0::DOUBLE + (1.96 * 1.96)::DOUBLE / n::DOUBLE))"


@query(_FIELDS + f" SELECT method, template, scope, path, round({_WILSON}, 6) AS presence_lb FROM fields")
def wilson_presence(spark, sf_dir):
    return presence(_observed(spark, sf_dir)).where("path <> ''").select("method", "template", "scope", "path", F.round(T.wilson_lower_bound(F.col("present"), F.col("n")), 6).alias("presence_lb"))


@query(_FIELDS + """ SELECT method, template, scope, path, present::DOUBLE / n >= 0.98 AS required, nulls > 0 AS nullable, CASE WHEN ints > 0 AND lo < hi THEN lo END AS lo, CASE WHEN ints > 0 AND lo < hi THEN hi END AS hi,
 CASE WHEN ints > 0 AND texts > 0 AND greatest(ints, texts)::DOUBLE / (ints + texts) >= 0.95 THEN CASE WHEN ints > texts THEN 'integer' ELSE 'string' END WHEN ints > 0 AND texts > 0 THEN 'integer|string' WHEN ints > 0 THEN 'integer' WHEN texts > 0 THEN 'string' WHEN path = 'user' THEN 'object' ELSE '' END AS types FROM fields""")
def field_decisions(spark, sf_dir):
    out = field_profile(_observed(spark, sf_dir)).where("path <> ''")
    return out.select("method", "template", "scope", "path", "required", "nullable", "lo", "hi", F.array_join("types", "|").alias("types"))


@query(_OBS + """, s AS (SELECT method, template, scope, path, txt, count(*) AS c FROM obs WHERE jt = 'VARCHAR' GROUP BY ALL), g AS (SELECT method, template, scope, path, sum(c) AS n, count(*) AS d, bool_and(txt <> '' AND NOT contains(txt, ' ') AND length(txt) <= 24) AS plain, bool_and(regexp_full_match(txt, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS is_date, list_sort(list(txt)) AS vs FROM s GROUP BY ALL)
 SELECT method, template, scope, path, CASE WHEN is_date THEN 'date' END AS format, CASE WHEN NOT is_date AND plain AND n >= 5 AND d <= 8 AND n::DOUBLE / d >= 2.0 THEN array_to_string(vs, ',') END AS enum, CASE WHEN NOT is_date AND plain AND n >= 5 AND d <= 8 AND n::DOUBLE / d >= 2.0 THEN round(least(1.0::DOUBLE, n::DOUBLE / 60.0::DOUBLE), 2) END AS enum_confidence FROM g""")
def enum_and_format(spark, sf_dir):
    return strings(_observed(spark, sf_dir)).select("method", "template", "scope", "path", "format", F.array_join("enum", ",").alias("enum"), "enum_confidence")


@query("SELECT 'GET' AS method, '/x' AS template, '200' AS scope, 'user_id' AS path, string_agg(k, ',' ORDER BY n DESC, k) AS aliases, (sum(n) - max(n))::DOUBLE / sum(n) > 0.10 AS inconsistent FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'user_id' ELSE 'userId' END AS k, count(*) AS n FROM events GROUP BY 1) HAVING count(*) > 1")
def alias_casing(spark, sf_dir):
    body = "CASE WHEN event_id % 3 = 0 THEN concat('{\"user_id\":', user_id, '}') ELSE concat('{\"userId\":', user_id, '}') END AS body"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("'GET' AS method", "'/x' AS template", "'200' AS scope", "event_id AS entry_seq", body)
    out = aliases(observe(rows, 1))
    return out.select("method", "template", "scope", "path", F.array_join("aliases", ",").alias("aliases"), (F.col("_casing") == "inconsistent_casing").alias("inconsistent"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def table_profile(spark, sf_dir):
    """Any table's rows as bodies: the segments of customers are an enum."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("GET").alias("method"), F.lit("/customers").alias("template"), F.lit("200").alias("scope"), F.col("c_custkey").alias("entry_seq"), F.to_json(F.struct("c_mktsegment")).alias("body"))
    return observe(rows, 1).where("path = 'c_mktsegment'").groupBy(F.col("text").alias("value")).agg(F.count("*").alias("n"))


@query(LOGS_SQL + " SELECT method, template, name, 'integer' AS type FROM (SELECT DISTINCT method, template, unnest(regexp_extract_all(template, '\\{([a-zA-Z]+)\\}', 1)) AS name FROM logs)")
def path_param_types(spark, sf_dir):
    return endpoints.path_params(entries(spark, sf_dir)).select("method", "template", "name", "type")


@query(LOGS_SQL + " SELECT method, template, round(avg(CASE WHEN entry_seq % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auth_rate FROM logs GROUP BY ALL")
def auth_rate(spark, sf_dir):
    return endpoints.auth_rate(entries(spark, sf_dir)).withColumn("auth_rate", F.round("auth_rate", 6))


@query(LOGS_SQL + ", h AS (SELECT method, template, 'v' || CAST(entry_seq % 3 AS VARCHAR) AS v, count(*) AS n, min(entry_seq) AS f FROM logs WHERE entry_seq % 3 > 0 GROUP BY ALL) SELECT method, template, arg_max(v, n * 1000000000 - f) AS header_version FROM h GROUP BY ALL")
def header_versions(spark, sf_dir):
    log = with_template(entries(spark, sf_dir))
    version = F.when(F.col("entry_seq") % 3 > 0, F.create_map(F.lit("Accept-Version"), F.concat(F.lit("v"), (F.col("entry_seq") % 3).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return endpoints.header_version(log.withColumn("headers", version))


@query(LOGS_SQL + " SELECT method, template, status, arg_min(response_body, entry_seq) AS example FROM logs GROUP BY ALL")
def first_examples(spark, sf_dir):
    return endpoints.examples(entries(spark, sf_dir))


_MIXED = "CASE WHEN event_id % 5 < 3 THEN concat('{\"id\":', event_id, ',\"full_name\":\"x\",\"mail\":\"y\",\"user_age\":1}') ELSE concat('{\"id\":', event_id, ',\"name\":\"x\",\"email\":\"y\",\"age_of_user\":\"', event_type, '\"}') END"
#: Groups of extra keys of the mixed bodies, the commonest first.
_CLUSTERS = f"""WITH b AS (SELECT event_id, {_MIXED} AS body FROM events), k AS (SELECT list_sort(json_keys(body)) AS ks, count(*) AS n FROM b GROUP BY 1), e AS (SELECT ks, n, unnest(ks) AS x FROM k),
 core AS (SELECT x FROM e GROUP BY x HAVING sum(n) = (SELECT sum(n) FROM k)), o AS (SELECT n, list(x ORDER BY x) AS own FROM e WHERE x NOT IN (SELECT x FROM core) GROUP BY ks, n),
 c AS (SELECT own, sum(n) AS n, row_number() OVER (ORDER BY sum(n) DESC, own) AS r FROM o GROUP BY own HAVING sum(n)::DOUBLE / (SELECT sum(n) FROM k) >= 0.20)"""


def _mixed(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("event_id AS entry_seq", "'GET' AS method", "'/m' AS path", "200 AS status", "CAST(NULL AS STRING) AS request_body", f"{_MIXED} AS response_body")


@query(_CLUSTERS + " SELECT 'GET' AS method, '/m' AS template, '200' AS scope, array_to_string(x.own, ',') AS a, array_to_string(y.own, ',') AS b FROM c x JOIN c y ON x.r = 1 AND y.r = 2 AND len(list_intersect(x.own, y.own)) = 0")
def version_mix(spark, sf_dir):
    keys = lambda k: F.array_join(F.element_at("clusters", k)["keys"], ",")
    return endpoints.version_mix(_mixed(spark, sf_dir)).select("method", "template", "scope", keys(1).alias("a"), keys(2).alias("b"))


_WORDS = "list_distinct(list_filter(string_split(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '_'), lambda w: w <> ''))"
_LIKE = f"len(list_intersect({_WORDS.format('o')}, {_WORDS.format('n')}))::DOUBLE / len(list_distinct(list_concat({_WORDS.format('o')}, {_WORDS.format('n')})))"


@query(_CLUSTERS + f""", p AS (SELECT unnest(x.own) AS o, y.own AS ns FROM c x JOIN c y ON x.r = 1 AND y.r = 2), q AS (SELECT o, unnest(ns) AS n FROM p),
 t AS (SELECT x, arg_min(json_type(body, '$.' || x), event_id) AS t FROM (SELECT event_id, body, unnest(json_keys(body)) AS x FROM b) GROUP BY x)
 SELECT o AS old, n AS new, {_LIKE} AS likeness FROM q JOIN t a ON a.x = o JOIN t z ON z.x = n WHERE {_LIKE} > 0 AND replace(a.t, 'UB', 'B') = replace(z.t, 'UB', 'B')""")
def version_renames(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    return endpoints.rename_candidates(endpoints.version_mix(rows), rows).select("old", "new", "likeness")


@query(_OBS + ", e AS (SELECT count(*) AS total FROM logs WHERE status >= 400) SELECT path, count(*) AS n, round(count(*)::DOUBLE / any_value(total), 6) AS share FROM obs, e WHERE scope = '500' AND parent = '' GROUP BY path")
def error_envelope(spark, sf_dir):
    return errors.error_envelope(_observed(spark, sf_dir)).select("path", "n", F.round("share", 6).alias("share"))


@query(LOGS_SQL + " SELECT coalesce(bool_or(status = 422), false) AS has_422, coalesce(bool_or(status = 409), false) AS has_409, coalesce(bool_or(status = 429), false) AS has_429, coalesce(bool_or(status >= 400), false) AS has_envelope FROM logs")
def api_evidence(spark, sf_dir):
    return errors.api_evidence(entries(spark, sf_dir))


@query(LOGS_SQL + """, e AS (SELECT method, template, bool_or(request_body IS NOT NULL) AS body, avg(CASE WHEN entry_seq % 4 <> 0 THEN 1.0 ELSE 0.0 END) AS auth, list(DISTINCT status) AS seen FROM logs GROUP BY ALL),
 m AS (SELECT template, count(DISTINCT method) AS methods FROM logs GROUP BY 1),
 r AS (SELECT method, template, seen, unnest([CASE WHEN contains(template, '{') THEN 404 END, CASE WHEN body THEN 400 END, CASE WHEN auth >= 0.5 THEN 401 END, CASE WHEN auth >= 0.5 THEN 403 END, CASE WHEN methods > 1 THEN 405 END, 500]) AS status FROM e JOIN m USING (template))
 SELECT method, template, CAST(status AS INTEGER) AS status, CASE WHEN status IN (405, 500) THEN 'low' ELSE 'medium' END AS confidence FROM r WHERE status IS NOT NULL AND NOT list_contains(seen, status)""")
def error_rules(spark, sf_dir):
    return errors.inferred_responses(entries(spark, sf_dir), _observed(spark, sf_dir)).select("method", "template", "status", "confidence")


@query(LOGS_SQL + """, e AS (SELECT method, template, bool_or(request_body IS NOT NULL) AS body, avg(CASE WHEN entry_seq % 4 <> 0 THEN 1.0 ELSE 0.0 END) AS auth, list(DISTINCT status) AS seen FROM logs GROUP BY ALL), m AS (SELECT template, count(DISTINCT method) AS methods FROM logs GROUP BY 1),
 r AS (SELECT method, template, seen, unnest([CASE WHEN contains(template, '{') THEN 404 END, CASE WHEN body THEN 400 END, CASE WHEN auth >= 0.5 THEN 401 END, CASE WHEN auth >= 0.5 THEN 403 END, CASE WHEN methods > 1 THEN 405 END, 500]) AS status FROM e JOIN m USING (template))
 SELECT method, template, CAST(status AS INTEGER) AS status, CASE status WHEN 404 THEN 'path parameter' WHEN 400 THEN chr(39) || 'k' || chr(39) || ' is required' WHEN 401 THEN 'authentication' WHEN 403 THEN 'authentication' WHEN 405 THEN 'other methods of the path' ELSE 'any server' END AS message, 400 AS code FROM r WHERE status IS NOT NULL AND NOT list_contains(seen, status)""")
def error_examples(spark, sf_dir):
    """An example for each inferred response, of the envelope that this log's failing calls show (message, code), the body's rule with what rejected requests lacked."""
    log = with_template(entries(spark, sf_dir))
    shown = F.when(F.col("status") >= 400, F.concat(F.lit('{"message":"m'), F.col("entry_seq").cast("string"), F.lit('","code":'), F.col("entry_seq").cast("string"), F.lit("}"))).otherwise(F.col("response_body"))
    seen = observe(bodies(log.withColumn("response_body", shown)), DEPTH).persist(StorageLevel.MEMORY_AND_DISK)
    refused = log.where("request_body is not null").withColumns({"status": F.lit(400), "request_body": F.lit('{"other":1}')})
    mined = errors.validation_evidence(refused, field_profile(seen))
    out = errors.error_examples(errors.inferred_responses(log, seen), errors.envelope_profile(seen), mined)
    return out.select("method", "template", "status", F.get_json_object("example", "$.message").alias("message"), F.get_json_object("example", "$.code").cast("int").alias("code"))


@query(LOGS_SQL + """, t(template, pattern, rank) AS (VALUES ('/users/7', '/users/7', 0), ('/users/{id}', '/users/[^/]+', 2), ('/{kind}/{id}', '/[^/]+/[^/]+', 5), ('/{kind}', '/[^/]+', 2), ('/users/{userId}/events/{eventId}', '/users/[^/]+/events/[^/]+', 3), ('/users/{userId}/{what}/1{rest}', '/users/[^/]+/[^/]+/1[^/]+', 4), ('/orders', '/orders', 0))
 SELECT entry_seq, (SELECT arg_min(template, rank) FROM t WHERE regexp_full_match(path, pattern)) AS template FROM logs""")
def template_resolver(spark, sf_dir):
    """Every call's path met with its most literal template of a mock's document."""
    named = ["/users/7", "/users/{id}", "/{kind}/{id}", "/{kind}", "/users/{userId}/events/{eventId}", "/users/{userId}/{what}/1{rest}", "/orders"]
    known = spark.createDataFrame([(t,) for t in named], "template string")
    return resolve.resolve(entries(spark, sf_dir).select("entry_seq", "path"), known).select("entry_seq", "template")


@query(LOGS_SQL + ", t AS (SELECT method, template, count(*) AS total FROM logs GROUP BY ALL) SELECT method, template, status, round(count(*)::DOUBLE / any_value(total), 6) AS rate FROM logs JOIN t USING (method, template) WHERE status >= 400 GROUP BY method, template, status")
def observed_status_rate(spark, sf_dir):
    return errors.observed_status_rate(entries(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


_THIN = "CASE WHEN event_id % 2 = 0 THEN concat('/b', event_id // 25) ELSE concat('/c', event_id // 60) END"


@query(f"SELECT method, path AS template, count(*) AS n, arg_min(body, event_id) AS example FROM (SELECT event_id, 'GET' AS method, {_THIN} AS path, CAST(event_id AS VARCHAR) AS body FROM events) GROUP BY ALL HAVING count(*) < 20")
def thin_endpoints(spark, sf_dir):
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("event_id AS entry_seq", "'GET' AS method", _THIN.replace("event_id // 25", "event_id DIV 25").replace("event_id // 60", "event_id DIV 60") + " AS path", "200 AS status", "CAST(event_id AS STRING) AS response_body")
    return errors.thin_endpoints(rows)


@query(_FIELDS + """, c AS (SELECT method, template, count(*) AS sample_count FROM logs GROUP BY ALL),
 s AS (SELECT method, template, bool_or(ints > 0 AND texts > 0 AND greatest(ints, texts)::DOUBLE / (ints + texts) >= 0.95) AS serious, bool_or(present::DOUBLE / n >= 0.98 AND n < 10) AS low FROM fields GROUP BY ALL)
 SELECT method, template, sample_count, CASE WHEN sample_count < 10 OR coalesce(serious OR low, false) THEN 'low' WHEN sample_count < 30 THEN 'medium' ELSE 'high' END AS confidence FROM c LEFT JOIN s USING (method, template)""")
def endpoint_confidence(spark, sf_dir):
    log = with_template(entries(spark, sf_dir))
    return quality.endpoint_confidence(endpoints.endpoints(log), field_profile(_observed(spark, sf_dir))).select("method", "template", "sample_count", "confidence")


@query("SELECT count(*) - sum(bad) AS read, sum(bad) AS skipped, round((count(*) - sum(bad))::DOUBLE / count(*), 4) AS parse_rate FROM (SELECT CAST(event_id % 10 = 0 AS BIGINT) AS bad FROM events)")
def parse_rate(spark, sf_dir):
    line = "CASE WHEN event_id % 10 = 0 THEN 'oops' ELSE '{\"method\":\"GET\",\"path\":\"/\",\"status\":200}' END AS value"
    return quality.parse_rate(parse_lines(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS entry_seq", line)))


@query()
def scorecard(spark, sf_dir):
    clean = entries(spark, sf_dir)
    return quality.scorecard(field_profile(observe(bodies(clean), DEPTH).persist(StorageLevel.MEMORY_AND_DISK)), field_profile(observe(bodies(noise.mutate(clean, 7)), DEPTH).persist(StorageLevel.MEMORY_AND_DISK)))


def _roll_sql(kind: str) -> str:
    return f"CAST('0x' || substr(md5('3:' || CAST(entry_seq AS VARCHAR) || ':response_body:{kind}'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


_NOISE = LOGS_SQL + f""", a AS (SELECT entry_seq, list_sort(json_keys(response_body)) AS ks, response_body AS b FROM logs),
 d AS (SELECT *, {_roll_sql('truncate_body')} < 0.1 AS cut, {_roll_sql('drop_field')} < 0.1 AS dropped, CAST(floor({_roll_sql('pick1')} * len(ks)) AS BIGINT) + 1 AS p1 FROM a),
 e AS (SELECT *, CASE WHEN dropped THEN list_filter(ks, lambda k, i: i <> p1) ELSE ks END AS f FROM d),
 n AS (SELECT *, CASE WHEN {_roll_sql('null_field')} < 0.1 THEN f[CASE WHEN dropped THEN CAST(floor({_roll_sql('pick2')} * len(f)) AS BIGINT) + 1 ELSE p1 END] END AS nulled, f[CAST(floor({_roll_sql('pick3')} * len(f)) AS BIGINT) + 1] AS own FROM e),
 m AS (SELECT *, CASE WHEN {_roll_sql('key_casing')} < 0.1 THEN CASE WHEN {_roll_sql('upper')} < 0.5 THEN upper(own) ELSE upper(own[1]) || substr(own, 2) END WHEN {_roll_sql('version_mix')} < 0.1 THEN own || '_v2' ELSE own END AS other FROM n)
 SELECT entry_seq, cut, CASE WHEN NOT cut THEN array_to_string(list_sort(list_transform(f, lambda k: CASE WHEN k = own THEN other ELSE k END)), ',') END AS keys,
  CASE WHEN NOT cut THEN coalesce(array_to_string(list_sort(list_transform(list_filter(f, lambda k: k = nulled OR json_type(b, '$.' || k) = 'NULL'), lambda k: CASE WHEN k = own THEN other ELSE k END)), ','), '') END AS nulls FROM m"""


@query(_NOISE)
def noise_mutations(spark, sf_dir):
    """What the damage left of each response body: its keys, and those that are null; a body that was cut is a text."""
    out, cut = noise.mutate(entries(spark, sf_dir), 3), F.col("response_body").startswith('"')
    entry = F.map_entries(F.try_variant_get(F.try_parse_json("response_body"), "$", "map<string,variant>"))
    names = F.transform(F.filter(entry, lambda e: F.schema_of_variant(e["value"]) == "VOID"), lambda e: e["key"])
    return out.select("entry_seq", cut.alias("cut"), F.when(~cut, F.array_join(F.array_sort(F.json_object_keys("response_body")), ",")).alias("keys"), F.when(~cut, F.array_join(F.array_sort(names), ",")).alias("nulls"))


@query(LOGS_SQL + """, h AS (SELECT *, entry_seq >= (SELECT count(*) FROM events) // 2 AS late FROM logs WHERE template <> '/orders' OR entry_seq < (SELECT count(*) FROM events) // 2)
 SELECT CASE WHEN NOT bool_or(late) THEN 'endpoint_removed' ELSE 'endpoint_added' END AS kind, method, template, NOT bool_or(late) AS breaking FROM h GROUP BY method, template HAVING bool_and(late) OR NOT bool_or(late)""")
def spec_diff_endpoints(spark, sf_dir):
    half = spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2
    log = entries(spark, sf_dir)
    old, new = endpoints.endpoints(log.where(F.col("entry_seq") < half)), endpoints.endpoints(log.where((F.col("entry_seq") >= half) & (F.col("path") != "/orders")))
    return diff.diff_endpoints(old, new).select("kind", "method", "template", "breaking")


_OLD = "concat('{\"id\":', event_id, ',\"type\":\"t\",\"cents\":1', CASE WHEN event_id % 3 = 0 THEN ',\"note\":\"n\"' ELSE '' END, '}')"
_NEW = "concat('{\"id\":\"', event_id, '\",\"extra\":{\"a\":1}', CASE WHEN event_id % 2 = 0 THEN ',\"cents\":1' ELSE '' END, ',\"note\":\"n\"}')"
_SIDE = "SELECT k, count(*)::DOUBLE / (SELECT count(*) FROM events) >= 0.98 AS r, string_agg(DISTINCT replace(json_type(body, '$.' || k), 'UB', 'B'), '|') AS t FROM (SELECT body, unnest(json_keys(body)) AS k FROM (SELECT {0} AS body FROM events)) GROUP BY k"


@query(f"""WITH o AS ({_SIDE.format(_OLD)}), n AS ({_SIDE.format(_NEW)}), d AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'field_removed' WHEN o.k IS NULL THEN 'field_added' WHEN o.t <> n.t THEN 'type_changed' WHEN NOT o.r AND n.r THEN 'became_required' WHEN o.r AND NOT n.r THEN 'became_optional' END AS kind FROM o FULL JOIN n ON o.k = n.k)
 SELECT kind, 'response.200.body.' || k AS location, kind IN ('field_removed', 'type_changed', 'became_required') AS breaking FROM d WHERE kind IS NOT NULL""")
def spec_diff_fields(spark, sf_dir):
    raw = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    side = lambda body: raw.selectExpr("event_id AS entry_seq", "'GET' AS method", "'/d' AS path", "200 AS status", "CAST(NULL AS STRING) AS request_body", f"{body} AS response_body")
    profile = lambda df: field_profile(observe(bodies(df), DEPTH).persist(StorageLevel.MEMORY_AND_DISK))
    return diff.diff_fields(profile(side(_OLD)), profile(side(_NEW))).select("kind", "location", "breaking")


@query(_OBS + """, i AS (SELECT method, template, CAST(status AS VARCHAR) AS scope, entry_seq, row_number() OVER (PARTITION BY method, template, status ORDER BY entry_seq) AS idx FROM logs),
 f AS (SELECT method, template, scope, path, min(idx) AS first_seen, max(idx) AS last_seen, count(*) AS present FROM obs JOIN i USING (method, template, scope, entry_seq) WHERE scope <> 'request' GROUP BY ALL),
 t AS (SELECT method, template, scope, max(idx) AS n FROM i GROUP BY ALL)
 SELECT method, template, scope, path, first_seen, present, n - last_seen AS missing_streak, CASE WHEN n > last_seen THEN last_seen + 1 END AS missing_since FROM f JOIN t USING (method, template, scope)""")
def missing_streaks(spark, sf_dir):
    out = tracker.field_states(observe(bodies(entries(spark, sf_dir)), DEPTH)).where("scope <> 'request'")  # read whole once: nothing to persist
    return out.select("method", "template", "scope", "path", F.col("first_seen").cast("long"), "present", "missing_streak", F.col("missing_since").cast("long"))


@query(_OBS + """, c AS (SELECT method, template, CAST(status AS VARCHAR) AS scope, entry_seq FROM logs UNION ALL SELECT method, template, 'request', entry_seq FROM logs WHERE request_body IS NOT NULL),
 i AS (SELECT *, row_number() OVER (PARTITION BY method, template, scope ORDER BY entry_seq) - 1 AS idx FROM c),
 f AS (SELECT method, template, scope, path, min(idx) AS first, max(idx) AS last, count(*) AS present FROM obs JOIN i USING (method, template, scope, entry_seq) GROUP BY ALL), t AS (SELECT method, template, scope, max(idx) AS n FROM i GROUP BY ALL)
 SELECT method, template, scope, path, first, present, n - last AS streak, CASE WHEN n > last THEN last + 1 END AS since, first >= 10 AS is_new, present = n - first + 1 AS unbroken FROM f JOIN t USING (method, template, scope)""")
def tracking_state(spark, sf_dir):
    """The tracking state after two batches of uneven size: that of the whole log in one."""
    log, own = with_template(entries(spark, sf_dir)), state.empty_state(spark)
    for k, part in enumerate((log.where("entry_seq < 3000"), log.where("entry_seq >= 3000"))):
        own = state.fold(own, part, observe(bodies(part), DEPTH)).write(scratch(spark, f"state-{k}"))
    return own.fields.select(*SCOPE, "path", "first", "present", "streak", "since", "is_new", "unbroken")


_DRIFT = "CASE WHEN event_id < @HALF THEN concat('{\"id\":', event_id, ',\"name\":\"x\",\"gone\":1}') ELSE concat('{\"id\":', event_id, ',\"full_name\":\"x\",\"more\":true}') END"


@query("""WITH h AS (SELECT max(event_id) // 2 AS half FROM events), e AS (SELECT event_type, count(*) FILTER (event_id < half) AS a, count(*) FILTER (event_id >= half) AS b FROM events, h GROUP BY 1)
 SELECT kind, 'GET' AS method, '/t/' || event_type AS template, 'response.200.body.' || name AS location, breaking FROM e, (VALUES ('field_renamed', 'name', true), ('field_removed', 'gone', true), ('field_added', 'more', false)) v(kind, name, breaking) WHERE a >= 10 AND b >= 10""")
def traffic_decisions(spark, sf_dir):
    """Two batches, between which each endpoint renames a field, drops one and gets one: each told once, and no field that became optional on the way."""
    raw = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    half = raw.agg(F.max("event_id")).first()[0] // 2
    log = with_template(raw.selectExpr("event_id AS entry_seq", "'GET' AS method", "concat('/t/', event_type) AS path", "200 AS status", "CAST(NULL AS STRING) AS request_body", f"{_DRIFT.replace('@HALF', str(half))} AS response_body"))
    own, contracts, before = state.empty_state(spark), [], []
    for k, part in enumerate((log.where(F.col("entry_seq") < half), log.where(F.col("entry_seq") >= half))):
        seen = observe(bodies(part), 1).persist(StorageLevel.MEMORY_AND_DISK)
        before.append(seen)
        counted = state.fold(own, part, seen).write(scratch(spark, f"counted-{k}"))
        home = scratch(spark, "profile")
        field_profile(before[0] if not k else before[0].unionByName(seen)).write.parquet(home)
        contracts.append(spark.read.parquet(home))
        if not k:
            own = state.mark(counted, counted.fields, contracts[0].where("required"), contracts[0]).write(scratch(spark, "marked"))
    told = diff.diff_fields(*contracts, state.warm_scopes(counted))

    def keep(df, name):
        folder = scratch(spark, name)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    return state.decide(counted, keep(told, "told"), contracts[1], diff.in_both(*contracts), keep).changes.select("kind", "method", "template", "location", "breaking")


@query(f"""WITH b AS (SELECT row_number() OVER (ORDER BY event_id) AS i, CASE WHEN event_id < (SELECT quantile_cont(event_id, 0.5) FROM events) THEN 'name' ELSE 'full_name' END AS k FROM events),
 f AS (SELECT k, min(i) AS first, max(i) AS last, (SELECT max(i) FROM b) AS total FROM b GROUP BY k), q AS (SELECT x.k AS o, y.k AS n, x.total - x.last AS gone FROM f x JOIN f y ON x.last < x.total AND y.first > 10 AND abs(y.first - x.last - 1) <= 2)
 SELECT o AS old, n AS new, {_LIKE} AS likeness, gone >= 10 AS complete FROM q""")
def rename_candidates(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = raw.agg(F.percentile("event_id", 0.5)).first()[0]
    rows = raw.select(F.col("event_id").alias("entry_seq"), F.lit("GET").alias("method"), F.lit("/r").alias("template"), F.lit("200").alias("scope"), F.when(F.col("event_id") < half, F.lit('{"name":"x"}')).otherwise(F.lit('{"full_name":"x"}')).alias("body"))
    return tracker.rename_pairs(tracker.field_states(observe(spread(rows), 1))).select("old", "new", "likeness", "complete")


@query("SELECT sum(c) AS changes, count(*) AS bursts FROM (SELECT g, count(*) AS c FROM (SELECT ts, sum(brk) OVER (ORDER BY ts) AS g FROM (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts - lag(ts) OVER (ORDER BY ts) >= INTERVAL 12 SECOND THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY g)")
def change_bursts(spark, sf_dir):
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("detected_at"), (F.col("event_id") % 2 == 0).alias("breaking"))
    return tracker.change_bursts(changes).agg(F.sum("changes").alias("changes"), F.count("*").alias("bursts"))


@query(LOGS_SQL + " SELECT entry_seq, method, template, status FROM logs WHERE method = 'GET' AND template = '/users/{id}' ORDER BY entry_seq DESC LIMIT 10")
def recent_samples(spark, sf_dir):
    """A top-k report: the newest calls of an endpoint."""
    return with_template(entries(spark, sf_dir)).where("method = 'GET' and template = '/users/{id}'").orderBy(F.desc("entry_seq")).limit(10).select("entry_seq", "method", "template", "status")


@query(LOGS_SQL + " SELECT DISTINCT substr(path, 9) AS id FROM logs WHERE template = '/orders/{id}' AND NOT EXISTS (SELECT 1 FROM logs k WHERE k.template = '/orders' AND k.response_body->>'$.id' = substr(logs.path, 9))")
def unknown_ids(spark, sf_dir):
    log = with_template(entries(spark, sf_dir))
    known = log.where("template = '/orders'").select(F.get_json_object("response_body", "$.id").alias("id")).distinct()
    return log.where("template = '/orders/{id}'").select(F.explode("params").alias("p")).select(F.col("p.value").alias("id")).distinct().join(known, "id", "left_anti")


@query(_FIELDS + " SELECT method, template, scope, path, n - present AS lacking FROM fields WHERE present < n")
def conformance(spark, sf_dir):
    """How many bodies lack each field that others of their scope have."""
    return presence(_observed(spark, sf_dir)).where("present < n and path <> ''").select("method", "template", "scope", "path", (F.col("n") - F.col("present")).alias("lacking"))


@query(LOGS_SQL + " SELECT DISTINCT method, template, lower(method) || '_' || replace(replace(regexp_replace(substr(template, 2), '\\{([a-zA-Z]+)\\}', 'by_\\1', 'g'), '/', '_'), '-', '_') AS operation_id FROM logs")
def operation_ids(spark, sf_dir):
    return with_template(entries(spark, sf_dir)).select("method", "template").distinct().withColumn("operation_id", P.operation_id(F.col("method"), F.col("template")))


_KINDS = "CASE WHEN path = '' THEN 'object' WHEN ints > 0 AND texts > 0 AND greatest(ints, texts)::DOUBLE / (ints + texts) < 0.95 THEN 'integer,string' WHEN ints > texts THEN 'integer' WHEN texts > 0 THEN 'string' WHEN path = 'user' THEN 'object' ELSE '' END"


@query(_FIELDS + f" SELECT method, template, scope, path, {_KINDS} AS types, present::DOUBLE / n >= 0.98 AS required FROM fields UNION ALL SELECT method, template, CAST(status AS VARCHAR), '', 'object', false FROM logs GROUP BY ALL UNION ALL SELECT method, template, 'request', '', 'object', false FROM logs WHERE request_body IS NOT NULL GROUP BY ALL")
def rendered_spec(spark, sf_dir):
    """The log's contract folded into a document, and that document flattened again."""
    ops = _folded(spark, sf_dir)
    return D.fields(D.operations(fold.documents(ops))).select("method", "template", "scope", "path", F.array_join("types", ",").alias("types"), "required")


def _folded(spark, sf_dir):
    log = with_template(entries(spark, sf_dir)).withColumn("doc", F.lit("api"))
    named = lambda df: df.withColumn("doc", F.lit("api"))
    bodies_of = fold.schemas(named(field_profile(_observed(spark, sf_dir))))
    params = endpoints.path_params(log).select("method", "template", "name", F.lit("path").alias("location"), "type", F.lit(True).alias("required"), F.col("place").cast("long").alias("place"))
    return fold.operations(named(endpoints.endpoints(log)), bodies_of, named(params), named(endpoints.examples(log)))


@query(LOGS_SQL + """, e AS (SELECT method, template, count(*) AS n, min(timestamp) AS f, avg(CASE WHEN entry_seq % 4 <> 0 THEN 1.0 ELSE 0.0 END) AS a, bool_or(request_body IS NOT NULL) AS b, string_agg(DISTINCT CAST(status AS VARCHAR), ',' ORDER BY CAST(status AS VARCHAR)) AS s FROM logs GROUP BY ALL)
 SELECT method, template, lower(method) || '_' || replace(replace(regexp_replace(substr(template, 2), '\\{([a-zA-Z]+)\\}', 'by_\\1', 'g'), '/', '_'), '-', '_') AS operation_id, n AS samples, f AS first_seen, a >= 0.5 AS secured, b AS asks, s AS statuses,
  coalesce(array_to_string(regexp_extract_all(template, '\\{([a-zA-Z]+)\\}', 1), ','), '') AS params FROM e""")
def rendered_operations(spark, sf_dir):
    """The operations of the folded document."""
    ops = D.operations(fold.documents(_folded(spark, sf_dir)))
    at = lambda path, kind="string": F.try_variant_get("op", path, kind)
    names = F.transform(F.coalesce(at("$.parameters", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.name", "string"))
    return ops.select(
        "method", "template", at("$.operationId").alias("operation_id"), at("$['x-sample-count']", "long").alias("samples"), at("$['x-first-seen']").alias("first_seen"), at("$.security", "variant").isNotNull().alias("secured"),
        at("$.requestBody", "variant").isNotNull().alias("asks"), F.array_join(F.array_sort(F.map_keys(at("$.responses", "map<string,variant>"))), ",").alias("statuses"), F.array_join(names, ",").alias("params"),
    )


@query(LOGS_SQL + """ SELECT method, template, CAST(status AS VARCHAR) AS scope, entry_seq, 'cents' AS path, 'missing' AS problem, 1 AS count FROM logs WHERE entry_seq % 5 = 0
 UNION ALL SELECT method, template, CAST(status AS VARCHAR), entry_seq, 'level', 'wrong_type', 1 FROM logs WHERE entry_seq % 40 = 0""")
def conformance_problems(spark, sf_dir):
    """The whole log against the contract of the calls whose number five doesn't divide."""
    seen = _observed(spark, sf_dir)
    return conform.problems(seen, field_profile(seen.where("entry_seq % 5 <> 0"))).select(*SCOPE, "entry_seq", "path", "problem", "count")


_SPEC = """concat('{"paths":{"/x/', event_type, '":{"get":{"parameters":[{"in":"query","name":"q', event_id % 3, '","required":true,"schema":{"type":"integer"}}],"responses":{"200":{"content":{"application/json":{"schema":{"type":"object","required":["id"],"properties":{"id":{"type":"integer"}',
 CASE WHEN event_id % 3 = 0 THEN ',"tags":{"anyOf":[{"type":"array","items":{"type":"object","properties":{"a":{"type":"string"}}}},{"type":"string"}]}' ELSE '' END, '}}}}},"404":{"x-inferred":true}}},"note":1}}}')"""


def _documents(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("event_id AS doc", f"{_SPEC} AS spec")


@query("""WITH d AS (SELECT event_id AS doc, 'GET' AS method, '/x/' || event_type AS template, '200' AS scope FROM events)
 SELECT *, '' AS path, 'object' AS types, false AS required FROM d UNION ALL SELECT *, 'id', 'integer', true FROM d
 UNION ALL SELECT *, 'tags', 'array,string', false FROM d WHERE doc % 3 = 0 UNION ALL SELECT *, 'tags[]', 'object', false FROM d WHERE doc % 3 = 0 UNION ALL SELECT *, 'tags[].a', 'string', false FROM d WHERE doc % 3 = 0""")
def document_fields(spark, sf_dir):
    """One document an event, flattened."""
    return D.fields(D.operations(_documents(spark, sf_dir))).select("doc", "method", "template", "scope", "path", F.array_join("types", ",").alias("types"), "required")


#: Documents of one path, whose responses `default` and `2XX` come and go, with arrays in arrays and anyOf inside anyOf inside anyOf.
_NESTED = """concat('{"paths":{"/n":{"post":{"responses":{"default":{"content":{"application/json":{"schema":{"type":"array","items":{"type":"array","items":{"type":"array","items":{"type":"object","required":["k"],"properties":{"k":{"anyOf":[{"anyOf":[{"oneOf":[{"type":"null"},{"type":"',
 CASE WHEN @ODD THEN 'integer' ELSE 'string' END, '"}]}]}]}', CASE WHEN @ODD THEN ',"extra":{"type":"boolean"}' ELSE '' END, '}}}}}}}}', CASE WHEN @ODD THEN '' ELSE ',"2XX":{}' END, '}}}}}')"""


@query("""WITH d AS (SELECT event_id AS doc, event_id % 2 = 1 AS odd FROM events) SELECT d.doc, n.path, CASE WHEN n.path = '[][][].k' THEN CASE WHEN odd THEN 'integer' ELSE 'string' END ELSE n.types END AS types, n.path = '[][][].k' AS required
 FROM d, (VALUES ('', 'array'), ('[]', 'array'), ('[][]', 'array'), ('[][][]', 'object'), ('[][][].k', ''), ('[][][].extra', 'boolean')) n(path, types) WHERE odd OR n.path <> '[][][].extra'""")
def nested_document_fields(spark, sf_dir):
    """Schemas below three arrays and three alternatives, of a response by the name of `default`."""
    docs = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("event_id AS doc", _NESTED.replace("@ODD", "event_id % 2 = 1") + " AS spec")
    return D.fields(D.operations(docs)).where("scope = 'default'").select("doc", "path", F.array_join("types", ",").alias("types"), "required")


@query("""WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), c AS (SELECT * FROM (VALUES ('status_removed', 'response.2XX', true, 0), ('type_changed', 'response.default.body[][][].k', true, 0), ('field_added', 'response.default.body[][][].extra', false, 0)) v(kind, location, breaking, z))
 SELECT kind, 'POST' AS method, '/n/' || event_type AS template, location, breaking FROM e, c UNION ALL SELECT 'endpoint_removed', 'POST', '/n/' || event_type, 'endpoint', true FROM e""")
def document_differences(spark, sf_dir):
    """Two documents of one path an event type and one that goes: wide statuses, deep types, new fields."""
    kinds = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_type").distinct()
    path = lambda odd: F.replace(F.regexp_extract(F.expr(_NESTED.replace("@ODD", odd)), '^."paths":.(.*)..$', 1), F.lit("/n"), F.concat(F.lit("/n/"), F.col("event_type")))
    whole = lambda paths: F.concat(F.lit('{"paths":{'), F.array_join(F.array_sort(F.collect_list(paths)), ","), F.lit("}}"))
    put = F.concat(F.lit('"/n/'), F.col("event_type"), F.lit('":{"post":{"responses":{}}}'))
    old, new = kinds.agg(whole(path("false")).alias("spec")), kinds.agg(whole(path("true")).alias("spec"))
    gone = kinds.agg(whole(F.replace(put, F.lit('"/n/'), F.lit('"/gone/'))).alias("spec"))
    both = D.diff_documents(old.withColumn("doc", F.lit("a")), new.withColumn("doc", F.lit("b")))
    lost = D.diff_documents(gone.withColumn("doc", F.lit("a")), new.withColumn("doc", F.lit("b"))).where("kind = 'endpoint_removed'").withColumn("template", F.replace("template", F.lit("/gone/"), F.lit("/n/")))
    return both.unionByName(lost).select("kind", "method", "template", "location", "breaking")


@query("SELECT event_id AS doc, 'GET' AS method, '/x/' || event_type AS template, 'query' AS location, 'q' || CAST(event_id % 3 AS VARCHAR) AS name, 'integer' AS type, true AS required FROM events")
def document_params(spark, sf_dir):
    return D.params(D.operations(_documents(spark, sf_dir)))


@query("SELECT event_type AS template, count(*) AS documents, count(DISTINCT event_id % 3) AS params FROM events GROUP BY 1")
def document_statuses(spark, sf_dir):
    """Observed responses alone: the inferred 404 takes no part."""
    ops = D.operations(_documents(spark, sf_dir))
    named = D.params(ops).groupBy("template").agg(F.countDistinct("name").alias("params"))
    return D.statuses(ops).groupBy("template").agg(F.count("*").alias("documents")).join(named, "template").select(F.substring("template", 4, 100).alias("template"), "documents", "params")


_THIRDS = """, z AS (SELECT max(entry_seq) AS z FROM logs), s AS (SELECT method, template, scope, path, count(*) FILTER (jt = 'VARCHAR') AS texts, count(DISTINCT txt) FILTER (jt = 'VARCHAR') AS d, list_sort(list(DISTINCT txt) FILTER (jt = 'VARCHAR')) AS vs, min(CASE WHEN jt LIKE '%BIGINT' THEN CAST(txt AS BIGINT) END) AS lo, max(CASE WHEN jt LIKE '%BIGINT' THEN CAST(txt AS BIGINT) END) AS hi, count(*) AS seen, count(*) FILTER (jt = 'NULL') AS nulls FROM obs GROUP BY ALL)
 SELECT method, template, scope, path, seen, nulls, lo, hi, texts, CASE WHEN texts > 0 THEN d > 8 END AS many, CASE WHEN d <= 8 AND texts > 0 THEN array_to_string(vs, ',') END AS vals FROM s"""


@query(_OBS + _THIRDS)
def merged_parts(spark, sf_dir):
    """The log in three pieces of uneven size: what their parts merge to."""
    log, third = with_template(entries(spark, sf_dir)), F.col("entry_seq") % 7
    pieces = [log.where(third < 1), log.where((third >= 1) & (third < 3)), log.where(third >= 3)]
    out = partial.merge([partial.parts_of(p, observe(bodies(p), DEPTH).persist(StorageLevel.MEMORY_AND_DISK)) for p in pieces])
    few = out.values.groupBy(*SCOPE, "path").agg(F.array_join(F.array_sort(F.collect_list("text")), ",").alias("vals"))
    rows = out.fields.where("path <> ''").join(out.texts, [*SCOPE, "path"], "left").join(few, [*SCOPE, "path"], "left")
    return rows.select(*SCOPE, "path", "seen", "nulls", "lo", "hi", F.coalesce("texts", F.lit(0).cast("long")).alias("texts"), "many", "vals")


@query(_OBS + """, c AS (SELECT method, template, CAST(status AS VARCHAR) AS scope, entry_seq, entry_seq // 1000 AS batch FROM logs), n AS (SELECT method, template, scope, batch, sum(k) OVER (PARTITION BY method, template, scope ORDER BY batch) AS n FROM (SELECT method, template, scope, batch, count(*) AS k FROM c GROUP BY ALL)),
 p AS (SELECT method, template, scope, path, batch, sum(k) OVER (PARTITION BY method, template, scope, path ORDER BY batch) AS present FROM (SELECT method, template, scope, path, batch, count(*) AS k FROM obs JOIN c USING (method, template, scope, entry_seq) WHERE parent = '' AND scope <> 'request' GROUP BY ALL))
 SELECT DISTINCT method, template, scope, path FROM p JOIN n USING (method, template, scope, batch) WHERE n >= 10 AND present::DOUBLE / n >= 0.98""")
def ever_required(spark, sf_dir):
    """Fields that were required at the end of any thousand of calls."""
    found = tracker.ever_required(_observed(spark, sf_dir), F.floor(F.col("entry_seq") / 1000))
    return found.where("scope <> 'request' and instr(path, '.') = 0").select("method", "template", "scope", "path")


@query(LOGS_SQL + " SELECT method, template, count(*) AS sample_count, string_agg(DISTINCT CAST(status AS VARCHAR), ',' ORDER BY CAST(status AS VARCHAR)) AS statuses FROM logs GROUP BY ALL")
def endpoint_listing(spark, sf_dir):
    return reads.endpoint_listing(endpoints.endpoints(entries(spark, sf_dir))).select("method", "template", "sample_count", F.array_join("statuses", ",").alias("statuses"))


@query("SELECT count(*) AS total_changes, count(*) FILTER (event_id % 2 = 0) AS breaking_changes, max(ts) AS last_updated FROM events")
def change_summary(spark, sf_dir):
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("detected_at"), (F.col("event_id") % 2 == 0).alias("breaking"))
    return reads.summary(changes)


@query("SELECT event_id AS seq FROM events QUALIFY sum(length(CAST(event_id AS VARCHAR)) + 1) OVER (ORDER BY event_id DESC) <= 10000")
def log_tail(spark, sf_dir):
    """A bounded tail: the newest lines of at most ten thousand bytes."""
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("value"))
    return reads.tail_of(lines, "seq", 10_000).select("seq")


@query("WITH n AS (SELECT o_orderkey AS i, (o_orderkey * 7919 + 13) % 100 AS r FROM orders) SELECT CASE WHEN r < 3 THEN 500 WHEN r < 9 THEN 400 WHEN r < 17 THEN 404 WHEN r % 4 = 0 THEN 201 ELSE 200 END AS status, count(*) AS n FROM n GROUP BY 1")
def shop_statuses(spark, sf_dir):
    """What the synthetic shop answers to a call for each order, parsed from its own lines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return parse_lines(shop.lines_of(orders)).groupBy("status").agg(F.count("*").alias("n"))


@query(LOGS_SQL + """, k AS (SELECT DISTINCT method, template, status FROM logs WHERE entry_seq % 3 <> 0 AND entry_seq % 11 <> 1 AND NOT (template = '/orders/{id}' AND status = 500)), h AS (SELECT DISTINCT method, template, status FROM logs),
 ends AS (SELECT DISTINCT method, template FROM k), t AS (SELECT h.*, EXISTS (SELECT 1 FROM k WHERE k.method = h.method AND k.template = h.template AND k.status = h.status) AS hit, EXISTS (SELECT 1 FROM ends WHERE ends.method = h.method AND ends.template = h.template) AND h.status = 500 AS guess FROM h)
 SELECT 'observed' AS responses, count(*) FILTER (hit) AS covered, count(*) AS total, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS coverage FROM t UNION ALL SELECT 'inferred', count(*) FILTER (hit OR guess), count(*), round(count(*) FILTER (hit OR guess)::DOUBLE / count(*), 4) FROM t""")
def status_coverage(spark, sf_dir):
    """Which statuses of the whole log a log without a third of the calls and without an endpoint's failures knows of, by itself and with inferred responses."""
    log = with_template(entries(spark, sf_dir))
    part = log.where("entry_seq % 3 <> 0 and entry_seq % 11 <> 1 and not (template = '/orders/{id}' and status = 500)")
    return score.coverage(part, log, observe(bodies(part), DEPTH).persist(StorageLevel.MEMORY_AND_DISK))


@query("SELECT event_id AS seq, ts AS detected_at FROM events WHERE event_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 20")
def breaking_feed(spark, sf_dir):
    """A top-k report: the newest breaking changes."""
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("detected_at"), (F.col("event_id") % 2 == 0).alias("breaking"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("template"), F.lit("GET").alias("method"), F.lit("").alias("location"))
    return recent_changes(changes, 20, breaking_only=True).select(F.col("event_id").alias("seq"), "detected_at")


@query("""WITH b AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS burst, bool_or(event_type = 'error' AND event_id % 50 = 0) AS breaking, count(*) AS changes, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT *, 1 + sum(CAST(breaking AS INT)) OVER (ORDER BY burst) AS major FROM b),
 v AS (SELECT *, row_number() OVER (PARTITION BY major ORDER BY burst) - CASE WHEN major > 1 THEN 1 ELSE 0 END AS minor FROM m)
 SELECT 'report-' || burst || '.json' AS file, last AS generated_at, CASE WHEN burst % 3 <> 0 THEN CAST(major AS INT) || '.' || minor || '.0' END AS version, CASE WHEN burst % 3 <> 0 THEN breaking END AS breaking, CASE WHEN burst % 3 <> 0 THEN changes END AS changes FROM v""")
def release_catalogue(spark, sf_dir):
    """A report file for each day of changes, with the release that it documents; of every third day the release is not known."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("burst", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400))
    name = F.concat(F.lit("report-"), F.col("burst").cast("string"), F.lit(".json"))
    changes = events.select("burst", ((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)).alias("breaking"))
    files = events.groupBy("burst").agg(F.max("ts").alias("generated_at")).select(name.alias("file"), "generated_at")
    return reads.release_listing(diff.releases(changes).where("burst % 3 <> 0").withColumn("file", name), files).select("file", "generated_at", "version", "breaking", "changes")


_TOLD = """concat('{"paths":{"/t/', event_id, '":{"get":{"responses":{"200":{"content":{"application/json":{"schema":{"type":"object","properties":{"a":{"type":"string"', CASE WHEN @OLD OR event_id % 5 = 0 THEN concat(',"description":"', CASE WHEN @OLD THEN 'old ' ELSE 'own ' END, event_id, '"') ELSE '' END,
 '},"b":{"type":"', CASE WHEN @OLD OR event_id % 2 = 0 THEN 'integer' ELSE 'number' END, '"', CASE WHEN @OLD THEN ',"description":"count"' ELSE '' END, '}', CASE WHEN @OLD THEN ',"gone":{"description":"x"}' ELSE ',"new":{"type":"boolean"}' END, '}}}}}}}}}}')"""


@query("""WITH n AS (SELECT event_id AS doc, '/t/' || event_id AS template FROM events) SELECT *, '' AS path, CAST(NULL AS VARCHAR) AS text FROM n UNION ALL SELECT *, 'a', CASE WHEN doc % 5 = 0 THEN 'own ' ELSE 'old ' END || doc FROM n
 UNION ALL SELECT *, 'b', CASE WHEN doc % 2 = 0 THEN 'count' END FROM n UNION ALL SELECT *, 'new', 'a rule''s text' FROM n""")
def description_carry_over(spark, sf_dir):
    """Texts of two documents an event and of a rule: own ones first, then old ones of unchanged nodes, then the rule's."""
    raw = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    side = lambda old: D.fields(D.operations(raw.selectExpr("event_id AS doc", _TOLD.replace("@OLD", old) + " AS spec")))
    new = side("false")
    rules = new.where("path = 'new'").withColumn("text", F.lit("a rule's text"))
    return D.carry_over(new, side("true"), rules).select("doc", "template", "path", "text")


@query("""WITH s AS (SELECT o_orderkey AS seq, o_custkey AS customer FROM orders WHERE o_orderkey % 13 = 0) SELECT l_orderkey, l_linenumber, customer FROM lineitem ASOF LEFT JOIN s ON l_orderkey - 5 >= s.seq""")
def as_of_lookup(spark, sf_dir):
    """For each line item the customer of the latest of some orders, as of five places before its own."""
    marks = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 13 = 0").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("customer"))
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") - 5).alias("_at"))
    return asof.as_of(points, marks, "seq", "customer", at="_at").select("l_orderkey", "l_linenumber", "customer")


@query("""WITH v(version, place) AS (VALUES (1, 2), (2, 4), (3, 5), (4, 7)), s AS (SELECT version, (SELECT max(event_id) FROM events) * place // 8 AS seq FROM v)
 SELECT coalesce(version, 0) AS version, count(*) AS calls FROM events ASOF LEFT JOIN s ON event_id >= s.seq GROUP BY 1""")
def contract_drift(spark, sf_dir):
    """Calls by the contract version that shapes their bodies, read off the bodies themselves where they have one."""
    numbers = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    last = numbers.agg(F.max("id")).first()[0]
    schedule = spark.createDataFrame([(last * place // 8, version) for version, place in ((1, 2), (2, 4), (3, 5), (4, 7))], "id long, version int")
    found = traffic.calls(numbers, schedule)
    shown = traffic.entries(found).select(F.col("entry_seq").alias("id"), "response_body")
    has = lambda key: F.get_json_object("response_body", f"$.{key}").isNotNull()
    read = F.when(has("tracking_number"), 4).when(~has("updated_at"), 3).when(F.col("response_body").contains('"pages":"32"'), 2).when(has("citizenship"), 1).otherwise(0)
    both = found.join(shown, "id").withColumn("version", F.when(F.col("response_body").isNull(), F.col("version")).otherwise(read))
    return both.groupBy("version").agg(F.count("*").alias("calls"))
