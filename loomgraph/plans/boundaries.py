"""Queries on HTTP routes, queues, data accesses, audits and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import audit, contracts, queues, routes, snapshots, verify
from loomgraph.plans.registry import query
from loomgraph.sources.estate import tables

HTTP = "endpoints http_client_calls"


def path_sql(c: str, lower: bool, strip: bool) -> str:
    """A route's normal form: path of a URL, no query, rooted; optionally lower case, and without leading parameters."""
    x = f"CASE WHEN regexp_extract(trim({c}), '^https?://[^/?#]*(/[^?#]*)', 1) <> '' THEN regexp_extract(trim({c}), '^https?://[^/?#]*(/[^?#]*)', 1) ELSE trim({c}) END"
    x = f"regexp_replace(regexp_replace({x}, '[?#].*$', ''), '/+', '/', 'g')"
    x = f"CASE WHEN starts_with({x}, '/') THEN {x} ELSE concat('/', {x}) END"
    if strip:
        x = f"regexp_replace({x}, '^(/[:{{][^/]*)+/', '/')"
    x = f"CASE WHEN length({x}) > 1 THEN regexp_replace({x}, '/{'' if strip else '+'}$', '') ELSE {x} END"
    return f"lower({x})" if lower else x


def segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda s: trim(s) <> '')"


PARAM = "(starts_with({0}, ':') OR (starts_with({0}, '{{') AND ends_with({0}, '}}')))"


def pairwise(a: str, b: str, n: str, both: bool = True) -> str:
    pa, pb = PARAM.format(f"{a}[i]"), PARAM.format(f"{b}[i]")
    return f"list_bool_and(list_transform(range(1, {n} + 1), lambda i: {a}[i] = {b}[i] OR {pa}{f' OR {pb}' if both else ''}))"


ONE = r"(?:[a-z0-9._-]+|:[a-z0-9._-]+|\{[a-z0-9._-]+\})"
AUDIT = f"""ac AS (SELECT id, repo_id, upper(trim(coalesce(http_method, ''))) AS method, url_pattern, client_type, {path_sql('url_pattern', True, False)} AS route FROM http_client_calls WHERE starts_with(url_pattern, '/')),
ar AS (SELECT *, {segs('route')} AS s, lower(trim(coalesce(client_type, ''))) <> 'navigation' AND route <> '/' AND regexp_matches(route, '^/{ONE}(?:/{ONE})*$')
  AND NOT (method IN ('REQUEST', 'ANY') AND (regexp_matches(route, '^/api[^/]*$') OR regexp_matches(route, '^/:[^/]+$'))) AS route_like FROM ac),
ae AS (SELECT id, repo_id, upper(trim(method)) AS method, {segs(path_sql('path', True, False))} AS s FROM endpoints),
am AS (SELECT c.id AS call_id, e.id AS endpoint_id, c.repo_id AS c_repo, e.repo_id AS e_repo, c.method AS c_method, e.method AS e_method FROM ar c JOIN ae e ON least(len(c.s), len(e.s)) > 0
  AND {pairwise('c.s', 'e.s', 'least(len(c.s), len(e.s))')}
  AND len(list_filter(c.s[least(len(c.s), len(e.s)) + 1:], lambda x: NOT {PARAM.format('x')})) = 0 AND len(list_filter(e.s[least(len(c.s), len(e.s)) + 1:], lambda x: NOT {PARAM.format('x')})) = 0 WHERE c.route_like),
acl AS (SELECT a.*, m.met, m.available, CASE WHEN NOT route_like THEN 'non_route_like' WHEN m.call_id IS NULL THEN 'path_unmatched'
  WHEN method IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') AND NOT met THEN 'method_mismatched'
  WHEN method NOT IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') THEN 'invalid_method_token' ELSE 'matched' END AS class
  FROM ar a LEFT JOIN (SELECT call_id, bool_or(c_method = e_method OR e_method = 'REQUEST' OR c_method IN ('REQUEST', 'ANY')) AS met, count(DISTINCT e_method) AS available FROM am GROUP BY 1) m ON m.call_id = a.id)"""

METHOD = "CASE WHEN upper(trim(coalesce({0}, ''))) = '' THEN 'REQUEST' ELSE upper(trim({0})) END"
MEET = "(c.m = e.m OR e.m = 'REQUEST' OR c.m IN ('REQUEST', 'ANY'))"
PAIRS = f"""cc AS (SELECT id, repo_id, caller_function_id, line_number, http_method, {METHOD.format('http_method')} AS m, {path_sql('url_pattern', False, True)} AS route, {segs(path_sql('url_pattern', True, True))} AS s FROM http_client_calls),
ee AS (SELECT id, repo_id, method, {METHOD.format('method')} AS m, path, {segs(path_sql('path', True, True))} AS s FROM endpoints),
eq AS (SELECT c.id AS call_id, e.id AS endpoint_id, c.repo_id AS c_repo, e.repo_id AS e_repo, c.caller_function_id, c.line_number, len(list_filter(c.s, lambda x: NOT {PARAM.format('x')})) > 0 AS literal
  FROM cc c JOIN ee e ON len(c.s) = len(e.s) AND len(c.s) > 0 AND {MEET} AND {pairwise('c.s', 'e.s', 'len(c.s)')})"""


def http(spark, sf):
    return tables(spark, sf, "http_client_calls", "endpoints")


@query("x02_route_normal_forms", "http_client_calls", f"SELECT id, {path_sql('url_pattern', False, True)} AS trace_route, {path_sql('url_pattern', True, False)} AS audit_route FROM http_client_calls")
def route_forms(spark, sf):
    (calls,) = tables(spark, sf, "http_client_calls")
    u = F.col("url_pattern")
    return calls.select("id", C.normalize_route(u).alias("trace_route"), C.normalize_audit_route(u).alias("audit_route"))


@query("x03_param_styles", "endpoints", r"SELECT id, regexp_replace(path, ':([A-Za-z0-9_]+)', '{\1}', 'g') AS braces, regexp_replace(regexp_replace(path, ':([A-Za-z0-9_]+)', '{\1}', 'g'), '\{([^/{}]+)\}', ':\1', 'g') AS colons FROM endpoints")
def param_styles(spark, sf):
    (endpoints,) = tables(spark, sf, "endpoints")
    braces = C.brace_params(F.col("path"))
    return endpoints.select("id", braces.alias("braces"), C.colon_params(braces).alias("colons"))


COMMON = ", ".join(f"'{x}'" for x in C.COMMON_SEGMENTS)
MEANING = "list_distinct(list_filter(list_transform(list_filter(string_split({0}, '/'), lambda x: x <> '' AND x <> '*' AND NOT starts_with(x, ':') AND NOT starts_with(x, '{{')), lambda x: regexp_replace(lower(x), '[-_]', '', 'g')), lambda x: length(x) > 4 AND x NOT IN (" + COMMON + ")))"


@query("x04_meaningful_segments", "", f"SELECT page_id, array_to_string(list_sort({MEANING.format('url')}), ' ') AS words FROM pages")
def meaningful(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.array_join(F.array_sort(C.meaningful_segments(F.col("url"))), " ").alias("words"))


@query("x05_methods", "http_client_calls", f"SELECT id, {METHOD.format('http_method')} AS method FROM http_client_calls")
def methods(spark, sf):
    (calls,) = tables(spark, sf, "http_client_calls")
    return calls.select("id", C.normalize_method(F.col("http_method")).alias("method"))


@query("f14_route_like_calls", "http_client_calls endpoints", f"WITH {AUDIT} SELECT id, route, route_like FROM ar")
def route_like(spark, sf):
    return routes.audit_calls(http(spark, sf)[0]).select("id", "route", "route_like")


@query("j06_audit_matches", HTTP, f"WITH {AUDIT} SELECT call_id, endpoint_id, c_method, e_method FROM am")
def audit_matches(spark, sf):
    calls, endpoints = http(spark, sf)
    return routes.audit_matches(routes.audit_calls(calls), endpoints).select("call_id", "endpoint_id", "c_method", "e_method")


@query("a08_http_audit_classes", HTTP, f"WITH {AUDIT} SELECT id, class FROM acl")
def audit_classes(spark, sf):
    return routes.audit_classes(*http(spark, sf)).select("id", "class")


@query("a08_http_audit_counts", HTTP, f"WITH {AUDIT} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE class = '{x}') AS {x}" for x in ("non_route_like", "path_unmatched", "method_mismatched", "invalid_method_token", "matched")) + " FROM acl")
def audit_counts(spark, sf):
    return audit.http_counts(routes.audit_classes(*http(spark, sf)))


@query("a11_unresolved_repos", HTTP, f"WITH {AUDIT} SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE class = 'path_unmatched') AS path_unmatched, count(*) FILTER (WHERE class = 'method_mismatched') AS method_mismatched FROM acl WHERE class IN ('path_unmatched', 'method_mismatched') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def unresolved_repos(spark, sf):
    return audit.unresolved_repos(routes.audit_classes(*http(spark, sf)), 10)


@query("a11_unresolved_samples", HTTP, f"WITH {AUDIT} SELECT id, repo_id, url_pattern, class FROM acl WHERE class IN ('path_unmatched', 'method_mismatched') ORDER BY class <> 'method_mismatched', repo_id, url_pattern, id LIMIT 15")
def unresolved_samples(spark, sf):
    return audit.unresolved_samples(routes.audit_classes(*http(spark, sf)), 15).select("id", "repo_id", "url_pattern", "class")


@query("j07_contract_callers", HTTP, f"WITH {PAIRS} SELECT e_repo AS repo_id, c_repo AS caller_repo, count(DISTINCT call_id) AS n FROM eq WHERE literal AND c_repo <> e_repo GROUP BY 1, 2")
def contract_callers(spark, sf):
    return contracts.http_callers(*http(spark, sf))


@query("j08_endpoint_consumers", HTTP, f"WITH {PAIRS}, g AS (SELECT endpoint_id, c_repo, caller_function_id, min(line_number) AS line FROM eq WHERE c_repo <> e_repo GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY c_repo, caller_function_id) AS rn, count(*) OVER (PARTITION BY endpoint_id) AS c FROM g) SELECT endpoint_id, c_repo, caller_function_id, line, c > 3 AS clipped FROM r WHERE rn <= 3")
def endpoint_consumers(spark, sf):
    calls, endpoints = http(spark, sf)
    return verify.endpoint_consumers(endpoints, calls, 3)


@query("j08b_flow_callers", HTTP, f"""WITH {PAIRS} SELECT c.id AS call_id, e.id AS endpoint_id FROM cc c JOIN ee e ON len(c.s) = len(e.s) AND len(list_filter(c.s, lambda x: NOT {PARAM.format('x')})) > 0
    AND {pairwise('c.s', 'e.s', 'len(c.s)', both=False)} AND (upper(trim(e.method)) IN ('', 'REQUEST') OR upper(trim(coalesce(c.http_method, ''))) IN ('', 'ANY') OR upper(trim(c.http_method)) = upper(trim(e.method)))""")
def flow_callers(spark, sf):
    return routes.flow_callers(*http(spark, sf)).select("call_id", "endpoint_id")


TRIM = "lower(regexp_replace(regexp_replace({0}, '^/+', ''), '/+$', ''))"
EXACT = f"SELECT c.id AS call_id, e.id AS endpoint_id, c.repo_id AS c_repo, e.repo_id AS e_repo FROM http_client_calls c JOIN endpoints e ON {TRIM.format('c.url_pattern')} = {TRIM.format('e.path')} AND c.repo_id <> e.repo_id AND ({METHOD.format('c.http_method')} = {METHOD.format('e.method')} OR {METHOD.format('c.http_method')} = 'REQUEST' OR {METHOD.format('e.method')} = 'REQUEST')"


@query("j12_exact_repo_calls", HTTP, EXACT)
def exact_calls(spark, sf):
    return routes.exact_repo_calls(*http(spark, sf)).select("call_id", "endpoint_id", "c_repo", "e_repo")


LIKE = r"regexp_matches(lower(f.form), concat('^', regexp_replace(regexp_replace(regexp_replace(lower(e.path), '([.^$|?*+()\[\]])', '\\\1', 'g'), '\{[^/{}]+\}', '.*', 'g'), ':[A-Za-z0-9_]+', '.*', 'g'), '$'))"


CASCADE = f"""{PAIRS}, xb AS (SELECT id, m, route FROM cc WHERE route <> ''), xf0 AS (
      SELECT id, m, 0 AS k, route AS form FROM xb UNION ALL SELECT id, m, 1, concat(route, '/') FROM xb WHERE route <> '/'
      UNION ALL SELECT id, m, 2, regexp_replace(route, '\\{{([^/{{}}]+)\\}}', ':\\1', 'g') FROM xb UNION ALL SELECT id, m, 3, regexp_replace(route, ':([A-Za-z0-9_]+)', '{{\\1}}', 'g') FROM xb),
    xf AS (SELECT id, m, form, dense_rank() OVER (PARTITION BY id ORDER BY min(k)) - 1 AS pos FROM xf0 GROUP BY 1, 2, 3),
    xt AS (
      SELECT f.id AS call_id, e.id AS endpoint_id, min(pos * 4 + CASE WHEN lower(f.form) = lower(e.path) AND (f.m = 'ANY' OR f.m = e.m) THEN 0 WHEN lower(f.form) = lower(e.path) AND e.m = 'REQUEST' AND f.m NOT IN ('REQUEST', 'ANY') THEN 1
        WHEN f.m = 'ANY' OR f.m = e.m THEN 2 ELSE 3 END) AS tier
      FROM xf f JOIN ee e ON (f.m = 'ANY' OR f.m = e.m OR (e.m = 'REQUEST' AND f.m NOT IN ('REQUEST', 'ANY')))
        AND (lower(f.form) = lower(e.path) OR CASE WHEN e.path = '/' THEN f.form = '/' ELSE {LIKE} OR starts_with(lower(f.form), lower(e.path)) END)
      GROUP BY 1, 2),
    xr AS (SELECT *, min(tier) OVER (PARTITION BY call_id) AS best FROM xt), xn AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY endpoint_id) AS rn FROM xr WHERE tier = best),
    cascade AS MATERIALIZED (SELECT call_id, endpoint_id, CAST(tier AS INTEGER) AS tier FROM xn WHERE rn <= 50)"""


@query("j05_trace_cascade", HTTP, f"WITH {CASCADE} SELECT * FROM cascade")
def trace_cascade(spark, sf):
    return routes.trace_cascade(*http(spark, sf))


@query("j05_segment_fallback", HTTP, f"""WITH c AS (SELECT id AS call_id, unnest({MEANING.format(path_sql('url_pattern', False, True))}) AS w FROM http_client_calls), e AS (SELECT id AS endpoint_id, unnest({MEANING.format('path')}) AS w FROM endpoints),
    s AS (SELECT call_id, endpoint_id, count(*) AS shared FROM c JOIN e USING (w) GROUP BY 1, 2), b AS (SELECT *, max(shared) OVER (PARTITION BY call_id) AS best FROM s)
    SELECT call_id, min(endpoint_id) AS endpoint_id, min(shared) AS shared FROM b WHERE shared = best GROUP BY 1 HAVING count(*) = 1""")
def segment_fallback(spark, sf):
    return routes.segment_fallback(*http(spark, sf))


@query("j13_gateway_routes", "endpoints gateway_routes http_client_calls", f"""WITH c AS (SELECT id AS call_id, {METHOD.format('http_method')} AS m, concat('/gw', {path_sql('url_pattern', False, True)}) AS route FROM http_client_calls),
    g AS (SELECT id AS route_id, {METHOD.format('method')} AS m, regexp_replace(path, '/\\*$', '') AS base, backend_path FROM gateway_routes), e AS (SELECT id AS endpoint_id, {METHOD.format('method')} AS m, path FROM endpoints)
    SELECT DISTINCT c.call_id, g.route_id, e.endpoint_id FROM c JOIN g ON (c.route = g.base OR starts_with(c.route, concat(g.base, '/'))) AND (c.m = g.m OR g.m = 'REQUEST' OR c.m IN ('REQUEST', 'ANY'))
    JOIN e ON e.path = concat(g.backend_path, substr(c.route, length(g.base) + 1)) AND (c.m = e.m OR e.m = 'REQUEST' OR c.m IN ('REQUEST', 'ANY'))""")
def gateway(spark, sf):
    calls, endpoints, gates = tables(spark, sf, "http_client_calls", "endpoints", "gateway_routes")
    through = calls.withColumn("url_pattern", F.concat(F.lit("/gw"), C.normalize_route(F.col("url_pattern"))))
    return routes.gateway_calls(through, gates, endpoints)


@query("j26_host_prefix", "files", """WITH c AS (SELECT * FROM (VALUES ('', 'api'), ('src', 'core'), ('src/building', 'bld')) t(folder, value))
    SELECT f.id, (SELECT value FROM c WHERE c.folder = '' OR starts_with(f.path, concat(c.folder, '/')) ORDER BY length(c.folder) DESC LIMIT 1) AS value FROM files f""")
def host_prefix(spark, sf):
    (files,) = tables(spark, sf, "files")
    repos = files.select("repo_id").distinct()
    configs = spark.createDataFrame([("", "api"), ("src", "core"), ("src/building", "bld")], "folder string, value string").crossJoin(F.broadcast(repos))
    return routes.nearest_prefix(files, configs).select("id", "value")


@query("j27_interface_rebase", "endpoints", """WITH d AS (SELECT id, concat('Api', CAST(repo_id AS VARCHAR)) AS interface_name, path FROM endpoints), c AS (SELECT DISTINCT concat('Api', CAST(repo_id AS VARCHAR)) AS interface_name, repo_id FROM endpoints)
    SELECT d.id, 'Main' AS controller, lower(concat('/v', CAST(c.repo_id AS VARCHAR), d.path)) AS path FROM d JOIN c ON c.interface_name = d.interface_name UNION ALL SELECT id, 'Legacy', lower(path) FROM d""")
def interface_rebase(spark, sf):
    """Every endpoint as if declared on its repository's interface, which a versioned and an unversioned controller implement."""
    (endpoints,) = tables(spark, sf, "endpoints")
    api = F.concat(F.lit("Api"), F.col("repo_id").cast("string")).alias("interface_name")
    repos = endpoints.select(api, "repo_id").distinct()
    main = repos.select("interface_name", F.lit("Main").alias("controller"), F.concat(F.lit("/V"), F.col("repo_id").cast("string"), F.lit("/")).alias("base"))
    legacy = repos.select("interface_name", F.lit("Legacy").alias("controller"), F.lit("").alias("base"))
    declared = endpoints.select("id", api, F.concat(F.regexp_replace("path", "^/", ""), F.lit("/")).alias("path"))
    return routes.rebase(declared, main.unionByName(legacy)).select("id", "controller", "path")


QNORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^arn:[^:]+:sqs:[^:]+:[^:]+:', ''), '^https?://[^/]+/[^/]+/', ''), '^.*/', ''), '\\.fifo$', ''))"
REASONS = f"""p AS (SELECT queue_name, count(DISTINCT repo_id) AS producer_repos FROM sqs_producers GROUP BY 1), c AS (SELECT DISTINCT queue_name FROM sqs_consumers),
reasons AS (SELECT queue_name, producer_repos, CASE WHEN lower(queue_name) IN (SELECT lower(queue_name) FROM c) THEN 'exact_match' WHEN {QNORM.format('queue_name')} IN (SELECT {QNORM.format('queue_name')} FROM c) THEN 'normalized_match_only'
  WHEN producer_repos > 1 THEN 'no_consumer_match_internal' ELSE 'no_consumer_match_single_repo' END AS reason FROM p)"""
QUEUES = "sqs_producers sqs_consumers"
QROW = """count(*) AS total, count(*) FILTER (WHERE reason <> 'no_consumer_match_single_repo') AS counted, count(*) FILTER (WHERE reason = 'exact_match') AS exact, count(*) FILTER (WHERE reason = 'normalized_match_only') AS normalized,
  count(*) FILTER (WHERE reason = 'no_consumer_match_internal') AS unmatched, count(*) FILTER (WHERE reason = 'no_consumer_match_single_repo') AS single_repo"""


@query("j10_queue_audit_reasons", QUEUES, f"WITH {REASONS} SELECT * FROM reasons")
def audit_reasons(spark, sf):
    return queues.audit_reasons(*tables(spark, sf, "sqs_producers", "sqs_consumers"))


@query("a09_queue_match_rate", QUEUES, f"WITH {REASONS}, m AS (SELECT {QROW} FROM reasons) SELECT *, CASE WHEN counted = 0 THEN 100.0 ELSE (exact + normalized) * 100.0 / counted END AS match_rate FROM m")
def match_rate(spark, sf):
    return audit.queue_metrics(*tables(spark, sf, "sqs_producers", "sqs_consumers"))


ALIAS = r"lower(regexp_replace(regexp_replace(trim({0}), '^%+', ''), '%+$', ''))"


CONSUMERS = f"""WITH n AS (SELECT DISTINCT queue_name, CASE WHEN starts_with(queue_name, 'arn:') THEN regexp_replace(queue_name, '^.*:', '') WHEN starts_with(queue_name, 'https:') THEN regexp_replace(queue_name, '^.*/', '') ELSE replace(queue_name, '%', '') END AS base FROM sqs_producers),
    v0 AS (SELECT queue_name, lower(queue_name) AS v FROM n UNION SELECT queue_name, lower(base) FROM n UNION SELECT queue_name, lower(concat('%', base, '%')) FROM n WHERE regexp_matches(base, '^[A-Z0-9_]*_[A-Z0-9_]*$') UNION SELECT queue_name, regexp_replace(lower(base), '\\.fifo$', '') FROM n),
    a AS (SELECT lower(alias_key) AS k, lower(alias_value) AS v FROM resource_aliases), d AS (SELECT DISTINCT v0.queue_name, a.k, a.v FROM v0 JOIN a ON a.k = {ALIAS.format('v0.v')} OR a.v = {ALIAS.format('v0.v')}),
    v AS (SELECT * FROM v0 UNION SELECT queue_name, k FROM d UNION SELECT queue_name, v FROM d UNION SELECT d.queue_name, a.k FROM d JOIN a ON a.v = d.v)
    SELECT DISTINCT v.queue_name, c.id AS consumer_id, 'queue' AS kind FROM v JOIN sqs_consumers c ON lower(c.queue_name) = v.v"""


@query("j09_trace_consumers", f"{QUEUES} resource_aliases", CONSUMERS)
def trace_consumers(spark, sf):
    producers, consumers, aliases = tables(spark, sf, "sqs_producers", "sqs_consumers", "resource_aliases")
    every = consumers.select(F.col("id").alias("consumer_id"), "queue_name", F.lit("queue").alias("kind"))
    return queues.trace_consumers(producers, every, aliases)


@query("u01_consumer_union", f"{QUEUES} data_accesses eventbridge_schedules", "SELECT id, queue_name, 'queue' AS kind FROM sqs_consumers UNION ALL SELECT id, lower(target_name), 'schedule' FROM eventbridge_schedules UNION ALL SELECT id, entity_name, 'read' FROM data_accesses WHERE access = 'read'")
def consumer_union(spark, sf):
    consumers, schedules, accesses = tables(spark, sf, "sqs_consumers", "eventbridge_schedules", "data_accesses")
    a = consumers.select("id", "queue_name", F.lit("queue").alias("kind"))
    b = schedules.select("id", F.lower("target_name").alias("queue_name"), F.lit("schedule").alias("kind"))
    c = accesses.filter("access = 'read'").select("id", F.col("entity_name").alias("queue_name"), F.lit("read").alias("kind"))
    return a.unionByName(b).unionByName(c)


@query("j11_alias_counterparties", f"{QUEUES} resource_aliases", f"""WITH p AS (SELECT DISTINCT repo_id, {ALIAS.format('queue_name')} AS a FROM sqs_producers), c AS (SELECT DISTINCT repo_id, {ALIAS.format('queue_name')} AS b FROM sqs_consumers), x AS (SELECT lower(alias_key) AS k, lower(alias_value) AS v FROM resource_aliases)
    SELECT DISTINCT p.repo_id AS producer_repo, c.repo_id AS consumer_repo, p.a AS queue FROM p JOIN c ON p.repo_id <> c.repo_id AND (p.a = c.b OR EXISTS (SELECT 1 FROM x WHERE (x.k = p.a AND x.v = c.b) OR (x.v = p.a AND x.k = c.b)) OR EXISTS (SELECT 1 FROM x JOIN x y ON x.v = y.v WHERE x.k = p.a AND y.k = c.b))""")
def counterparties(spark, sf):
    return queues.counterparties(*tables(spark, sf, "sqs_producers", "sqs_consumers", "resource_aliases"))


@query("j14_queue_repo_edges", QUEUES, "SELECT p.repo_id AS src, c.repo_id AS tgt, p.queue_name, count(*) AS n FROM sqs_producers p JOIN (SELECT DISTINCT repo_id, queue_name FROM sqs_consumers) c ON c.queue_name = p.queue_name AND c.repo_id <> p.repo_id GROUP BY 1, 2, 3")
def queue_edges(spark, sf):
    return queues.repo_edges(*tables(spark, sf, "sqs_producers", "sqs_consumers"))


@query("x06_queue_variants", "sqs_producers", r"""WITH n AS (SELECT DISTINCT queue_name, CASE WHEN starts_with(queue_name, 'arn:') THEN regexp_replace(queue_name, '^.*:', '') WHEN starts_with(queue_name, 'https:') THEN regexp_replace(queue_name, '^.*/', '') ELSE replace(queue_name, '%', '') END AS base FROM sqs_producers)
    SELECT queue_name, base, array_to_string(list_sort(list_distinct(list_filter([lower(queue_name), lower(base), CASE WHEN regexp_matches(base, '^[A-Z0-9_]*_[A-Z0-9_]*$') THEN lower(concat('%', base, '%')) END, regexp_replace(lower(base), '\.fifo$', '')], lambda x: x IS NOT NULL))), '|') AS variants FROM n""")
def variants(spark, sf):
    (producers,) = tables(spark, sf, "sqs_producers")
    q = F.col("queue_name")
    return producers.select("queue_name").distinct().select(q, C.normalize_queue(q).alias("base"), F.array_join(C.queue_variants(q), "|").alias("variants"))


DATA = """e AS (SELECT lower(entity_name) AS entity, count(DISTINCT CASE WHEN lower(access) = 'write' THEN repo_id END) AS w, count(DISTINCT CASE WHEN lower(access) = 'read' THEN repo_id END) AS r FROM data_accesses GROUP BY 1 HAVING w > 0),
x AS (SELECT DISTINCT lower(a.entity_name) AS entity FROM data_accesses a JOIN data_accesses b ON lower(a.entity_name) = lower(b.entity_name) AND lower(a.access) = 'write' AND lower(b.access) = 'read' AND a.repo_id <> b.repo_id),
d AS (SELECT count(*) AS write_entities, count(*) FILTER (WHERE w > 1 OR r > 1) AS shared, count(*) FILTER (WHERE (w > 1 OR r > 1) AND x.entity IS NOT NULL) AS covered, count(*) FILTER (WHERE r = 0) AS no_reader,
  count(*) FILTER (WHERE r > 0 AND x.entity IS NULL) AS same_repo_only, count(*) FILTER (WHERE NOT (w > 1 OR r > 1)) AS single_repo_only FROM e LEFT JOIN x USING (entity)),
dm AS (SELECT *, CASE WHEN shared > 0 THEN covered * 100.0 / shared WHEN write_entities = 0 THEN 100.0 ELSE 0.0 END AS coverage_rate FROM d)"""


@query("a10_data_coverage", "data_accesses", f"WITH {DATA} SELECT * FROM dm")
def data_coverage(spark, sf):
    return audit.data_metrics(*tables(spark, sf, "data_accesses"))


@query("a12_dependency_edges", f"{HTTP} {QUEUES}", f"""WITH {AUDIT}, h AS (SELECT DISTINCT call_id, c_repo AS src, e_repo AS tgt FROM am WHERE c_repo <> e_repo AND (c_method = e_method OR e_method = 'REQUEST' OR c_method IN ('REQUEST', 'ANY')))
    SELECT src, tgt, 'http' AS type, '' AS queue_name, count(*) AS n FROM h GROUP BY 1, 2 UNION ALL
    SELECT p.repo_id, c.repo_id, 'sqs', p.queue_name, count(*) FROM sqs_producers p JOIN (SELECT DISTINCT repo_id, queue_name FROM sqs_consumers) c ON c.queue_name = p.queue_name AND c.repo_id <> p.repo_id GROUP BY 1, 2, 4""")
def dependency_edges(spark, sf):
    calls, endpoints, producers, consumers = tables(spark, sf, "http_client_calls", "endpoints", "sqs_producers", "sqs_consumers")
    return audit.dependency_edges(calls, endpoints, producers, consumers)


HEALTH = """h AS (SELECT r.id AS repo_id, r.name, (SELECT count(*) FROM files f WHERE f.repo_id = r.id) AS files, (SELECT count(*) FROM functions x JOIN files f ON f.id = x.file_id WHERE f.repo_id = r.id) AS functions,
  (SELECT count(*) FROM classes x JOIN files f ON f.id = x.file_id WHERE f.repo_id = r.id) AS classes, (SELECT count(*) FROM endpoints e WHERE e.repo_id = r.id) AS endpoints FROM repositories r),
l AS (SELECT repo_id, language, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, language) AS rn FROM files GROUP BY 1, 2)"""


@query("d10_repo_health", "repositories files functions classes endpoints", f"WITH {HEALTH} SELECT h.*, coalesce(l.language, 'mixed') AS primary_language FROM h LEFT JOIN l ON l.repo_id = h.repo_id AND l.rn = 1")
def repo_health(spark, sf):
    return audit.health(*tables(spark, sf, "repositories", "files", "functions", "classes", "endpoints"))


@query("q23_audit_status", f"{HTTP} {QUEUES} data_accesses", f"""WITH {AUDIT}, {REASONS.replace('c AS', 'cq AS').replace('FROM c)', 'FROM cq)')}, qm AS (SELECT {QROW} FROM reasons), {DATA},
    m AS (SELECT 0 AS duplicates, (SELECT count(*) FROM acl WHERE class IN ('path_unmatched', 'method_mismatched')) AS unresolved, counted, CASE WHEN counted = 0 THEN 100.0 ELSE (exact + normalized) * 100.0 / counted END AS match_rate, (SELECT shared FROM dm) AS shared, (SELECT coverage_rate FROM dm) AS coverage_rate FROM qm),
    w AS (SELECT *, CAST(duplicates > 0 AS INTEGER) + CAST(unresolved > 0 AS INTEGER) + CAST(counted > 0 AND match_rate < 90 AS INTEGER) + CAST(shared > 0 AND coverage_rate < 60 AS INTEGER) AS warnings FROM m) SELECT unresolved, counted, match_rate, shared, coverage_rate, warnings, CASE WHEN warnings > 0 THEN 'warn' ELSE 'ok' END AS status FROM w""")
def audit_status(spark, sf):
    calls, endpoints, producers, consumers, accesses = tables(spark, sf, "http_client_calls", "endpoints", "sqs_producers", "sqs_consumers", "data_accesses")
    c = audit.http_counts(routes.audit_classes(calls, endpoints)).select((F.col("path_unmatched") + F.col("method_mismatched")).alias("unresolved"), F.lit(0).alias("duplicates"))
    q = audit.queue_metrics(producers, consumers).select("counted", "match_rate")
    d = audit.data_metrics(accesses).select("shared", "coverage_rate")
    return audit.status(c.join(q, F.lit(True)).join(d, F.lit(True))).drop("duplicates")


@query("a02_http_used", "http_client_calls", "SELECT repo_id, http_method, url_pattern, count(*) AS n, max(client_type) AS client_type FROM http_client_calls GROUP BY 1, 2, 3")
def http_used(spark, sf):
    return contracts.http_used(*tables(spark, sf, "http_client_calls"))


@query("a19_target_counts", HTTP, f"""WITH g AS (SELECT repo_id, http_method, url_pattern, count(*) AS n FROM http_client_calls GROUP BY 1, 2, 3), {PAIRS}, k AS (SELECT DISTINCT c.repo_id, c.http_method, x.url_pattern, q.e_repo FROM eq q JOIN cc c ON c.id = q.call_id JOIN http_client_calls x ON x.id = c.id WHERE q.c_repo <> q.e_repo)
    SELECT k.repo_id AS c_repo, k.e_repo, sum(g.n) AS n FROM k JOIN g ON g.repo_id = k.repo_id AND g.http_method = k.http_method AND g.url_pattern = k.url_pattern GROUP BY 1, 2""")
def target_counts(spark, sf):
    return contracts.target_counts(*http(spark, sf))


@query("a20_contracts_overview", f"repositories {HTTP} {QUEUES} data_accesses", "SELECT r.id AS repo_id, r.name, (SELECT count(*) FROM endpoints x WHERE x.repo_id = r.id) AS endpoints, (SELECT count(*) FROM http_client_calls x WHERE x.repo_id = r.id) AS http_calls, (SELECT count(*) FROM sqs_producers x WHERE x.repo_id = r.id) AS producers, (SELECT count(*) FROM sqs_consumers x WHERE x.repo_id = r.id) AS consumers, (SELECT count(*) FROM data_accesses x WHERE x.repo_id = r.id) AS accesses FROM repositories r")
def contracts_overview(spark, sf):
    names = ("repositories", "endpoints", "http_client_calls", "sqs_producers", "sqs_consumers", "data_accesses")
    repositories, *rest = tables(spark, sf, *names)
    return contracts.overview(repositories, dict(zip(("endpoints", "http_calls", "producers", "consumers", "accesses"), rest, strict=True)))


DETAIL = {
    "endpoints": ("concat(method, ' ', path)", "SELECT DISTINCT method, path FROM endpoints WHERE repo_id = 4 ORDER BY path, method"),
    "http_calls": ("concat(http_method, ' ', url_pattern, ' ', n)", "SELECT http_method, url_pattern, count(*) AS n FROM http_client_calls WHERE repo_id = 4 GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1"),
    "http_callers": ("concat(c_repo, ' ', n)", "SELECT c_repo, count(DISTINCT call_id) AS n FROM eq WHERE literal AND e_repo = 4 AND c_repo <> 4 GROUP BY 1 ORDER BY 2 DESC, 1"),
    "produced": ("concat(queue_name, ' ', n)", "SELECT queue_name, count(*) AS n FROM sqs_producers WHERE repo_id = 4 GROUP BY 1 ORDER BY 1"),
    "consumed": ("concat(queue_name, ' ', n)", "SELECT queue_name, count(*) AS n FROM sqs_consumers WHERE repo_id = 4 GROUP BY 1 ORDER BY 1"),
    "producers_met": ("CAST(src AS VARCHAR)", "SELECT DISTINCT src FROM qg WHERE tgt = 4 ORDER BY 1"),
    "consumers_met": ("CAST(tgt AS VARCHAR)", "SELECT DISTINCT tgt FROM qg WHERE src = 4 ORDER BY 1"),
    "entities": ("concat(entity, ' ', access, ' ', n)", "SELECT lower(entity_name) AS entity, access, count(*) AS n FROM data_accesses WHERE repo_id = 4 GROUP BY 1, 2 ORDER BY 1, 2"),
    "graphql_operations": ("name", "SELECT DISTINCT name FROM graphql_operations WHERE repo_id = 4 ORDER BY 1"),
    "graphql_usages": ("concat(operation_name, ' ', n)", "SELECT operation_name, count(*) AS n FROM graphql_usages WHERE repo_id = 13 GROUP BY 1 ORDER BY 1"),
    "graphql_targets": ("concat(operation_name, ' ', o_repo)", "SELECT DISTINCT u.operation_name, o.repo_id AS o_repo FROM graphql_usages u JOIN graphql_operations o ON o.name = u.operation_name WHERE u.repo_id = 13 AND o.repo_id <> 13 ORDER BY 1, 2"),
    "graphql_callers": ("concat(operation_name, ' ', u_repo)", "SELECT DISTINCT u.operation_name, u.repo_id AS u_repo FROM graphql_usages u JOIN graphql_operations o ON o.name = u.operation_name WHERE o.repo_id = 15 AND u.repo_id <> 15 ORDER BY 1, 2"),
    "graphql_resolvers": ("concat(operation_name, ' ', handler)", "SELECT DISTINCT operation_name, handler FROM graphql_resolvers WHERE repo_id = 4 ORDER BY 1, 2"),
    "graphql_permissions": ("concat(operation_name, ' ', role)", "SELECT DISTINCT operation_name, role FROM graphql_permissions WHERE repo_id = 4 ORDER BY 1, 2"),
    "graphql_entrypoints": ("path", "SELECT DISTINCT path FROM graphql_entrypoints WHERE repo_id = 4 ORDER BY 1"),
    "timer_triggers": ("concat(name, ' ', value)", "SELECT DISTINCT name, value FROM triggers WHERE kind = 'timer' AND repo_id = 4 ORDER BY 1, 2"),
}
DETAIL_TABLES = "http_client_calls endpoints sqs_producers sqs_consumers resource_aliases data_accesses graphql_operations graphql_usages graphql_resolvers graphql_permissions graphql_entrypoints triggers"
#: Lists that another repository than the fourth has rows for.
OTHER = {"graphql_operations": 15, "graphql_usages": 13, "graphql_targets": 13, "graphql_callers": 15, "graphql_permissions": 9}
QGRAPH = f"""qp AS (SELECT DISTINCT repo_id, {ALIAS.format('queue_name')} AS a FROM sqs_producers), qk AS (SELECT DISTINCT repo_id, {ALIAS.format('queue_name')} AS b FROM sqs_consumers), qx AS (SELECT lower(alias_key) AS k, lower(alias_value) AS v FROM resource_aliases),
    qg AS (SELECT DISTINCT p.repo_id AS src, c.repo_id AS tgt, p.a FROM qp p JOIN qk c ON p.repo_id <> c.repo_id AND (p.a = c.b OR EXISTS (SELECT 1 FROM qx x WHERE (x.k = p.a AND x.v = c.b) OR (x.v = p.a AND x.k = c.b)) OR EXISTS (SELECT 1 FROM qx x JOIN qx y ON x.v = y.v WHERE x.k = p.a AND y.k = c.b)))"""


def detail_sql() -> str:
    own = lambda name, text: text.replace("repo_id = 4", f"repo_id = {OTHER[name]}") if name in OTHER else text
    return " UNION ALL ".join(f"SELECT '{name}' AS list, {item} AS item FROM ({own(name, text)} LIMIT 5)" for name, (item, text) in DETAIL.items())


@query("q12_contract_detail", DETAIL_TABLES, f"WITH {PAIRS}, {QGRAPH} {detail_sql()}")
def contract_detail(spark, sf):
    facts = tables(spark, sf, *DETAIL_TABLES.split())
    out = None
    for name in DETAIL:
        one = contracts.detail(OTHER.get(name, 4), 5, *facts)[name]
        one = one.select(F.lit(name).alias("list"), F.concat_ws(" ", *(F.col(c).cast("string") for c in one.columns if c != "client_type" and c != "repo_id")).alias("item"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q13_repo_dependency_graph", f"repositories {HTTP} {QUEUES} resource_aliases", f"""WITH h AS ({EXACT}), p AS (SELECT DISTINCT repo_id, {ALIAS.format('queue_name')} AS a FROM sqs_producers), c AS (SELECT DISTINCT repo_id, {ALIAS.format('queue_name')} AS b FROM sqs_consumers), x AS (SELECT lower(alias_key) AS k, lower(alias_value) AS v FROM resource_aliases),
    q AS (SELECT DISTINCT p.repo_id AS src, c.repo_id AS tgt, p.a FROM p JOIN c ON p.repo_id <> c.repo_id AND (p.a = c.b OR EXISTS (SELECT 1 FROM x WHERE (x.k = p.a AND x.v = c.b) OR (x.v = p.a AND x.k = c.b)) OR EXISTS (SELECT 1 FROM x JOIN x y ON x.v = y.v WHERE x.k = p.a AND y.k = c.b)))
    SELECT c_repo AS src, e_repo AS tgt, 'http' AS type, count(DISTINCT call_id) AS n FROM h GROUP BY 1, 2 UNION ALL SELECT src, tgt, 'queue', count(*) FROM q GROUP BY 1, 2""")
def repo_graph(spark, sf):
    calls, endpoints, producers, consumers, aliases = tables(spark, sf, "http_client_calls", "endpoints", "sqs_producers", "sqs_consumers", "resource_aliases")
    h = routes.exact_repo_calls(calls, endpoints).groupBy(F.col("c_repo").alias("src"), F.col("e_repo").alias("tgt")).agg(F.countDistinct("call_id").alias("n")).withColumn("type", F.lit("http"))
    q = queues.counterparties(producers, consumers, aliases).groupBy(F.col("producer_repo").alias("src"), F.col("consumer_repo").alias("tgt")).agg(F.count("*").alias("n")).withColumn("type", F.lit("queue"))
    return h.unionByName(q)


@query("q15_entity_exposures", "data_accesses", "SELECT DISTINCT lower(a.entity_name) AS entity, a.repo_id, lower(a.access) AS access FROM data_accesses a WHERE a.repo_id <> 7 AND lower(a.entity_name) IN (SELECT lower(entity_name) FROM data_accesses WHERE repo_id = 7 AND access = 'write')")
def entity_exposures(spark, sf):
    return verify.entity_exposures(*tables(spark, sf, "data_accesses"), 7)


@query("q05_queue_search", f"{QUEUES}", "SELECT 'producer' AS side, repo_id, queue_name, count(*) AS n FROM sqs_producers WHERE lower(queue_name) LIKE '%click%' GROUP BY 2, 3 UNION ALL SELECT 'consumer', repo_id, queue_name, count(*) FROM sqs_consumers WHERE lower(queue_name) LIKE '%click%' GROUP BY 2, 3")
def queue_search(spark, sf):
    out = None
    for side, rows in zip(("producer", "consumer"), tables(spark, sf, "sqs_producers", "sqs_consumers"), strict=True):
        one = rows.filter(C.contains_text(F.col("queue_name"), "click")).groupBy("repo_id", "queue_name").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out


@query("j33_schedule_consumers", "eventbridge_schedules sqs_consumers", "SELECT DISTINCT s.rule_name, c.id AS consumer_id FROM eventbridge_schedules s JOIN sqs_consumers c ON lower(s.target_name) = lower(c.queue_name)")
def schedule_consumers(spark, sf):
    schedules, consumers = tables(spark, sf, "eventbridge_schedules", "sqs_consumers")
    right = consumers.select(F.col("id").alias("consumer_id"), F.lower("queue_name").alias("key"))
    return schedules.withColumn("key", F.lower("target_name")).join(right, "key").select("rule_name", "consumer_id").distinct()


@query("j24_graphql_usages", "graphql_operations graphql_usages", """WITH n AS (SELECT u.id, count(*) AS k, min(o.id) AS operation_id FROM graphql_usages u JOIN graphql_operations o ON o.name = u.operation_name GROUP BY 1)
    SELECT id, operation_id, CASE WHEN k = 1 THEN 'high' ELSE 'medium' END AS confidence FROM n""")
def graphql_usages(spark, sf):
    operations, usages = tables(spark, sf, "graphql_operations", "graphql_usages")
    o = operations.select(F.col("id").alias("operation_id"), F.col("name").alias("operation_name"))
    met = usages.join(o, "operation_name").groupBy("id").agg(F.count("*").alias("k"), F.min("operation_id").alias("operation_id"))
    return met.select("id", "operation_id", F.when(F.col("k") == 1, "high").otherwise("medium").alias("confidence"))


@query("j25_controller_folders", "graphql_operations files", "SELECT o.id, f.id AS file_id FROM graphql_operations o JOIN files f ON starts_with(f.path, 'src/machinery/') AND f.repo_id = o.repo_id")
def controller_folders(spark, sf):
    operations, files = tables(spark, sf, "graphql_operations", "files")
    folder = F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))
    held = files.select(F.col("id").alias("file_id"), "repo_id", folder.alias("folder"))
    return operations.withColumn("folder", F.lit("src/machinery/")).join(held, ["repo_id", "folder"]).select("id", "file_id")


@query("j02_endpoint_handlers", "endpoints functions", "SELECT e.id, e.path, f.name AS handler FROM endpoints e LEFT JOIN functions f ON f.id = e.handler_function_id")
def endpoint_handlers(spark, sf):
    endpoints, functions = tables(spark, sf, "endpoints", "functions")
    f = functions.select(F.col("id").alias("handler_function_id"), F.col("name").alias("handler"))
    return endpoints.join(f, "handler_function_id", "left").select("id", "path", "handler")


@query("f09_legacy_routes", "endpoints", "SELECT id, id % 8 < 4 AS legacy FROM endpoints")
def legacy_routes(spark, sf):
    (endpoints,) = tables(spark, sf, "endpoints")
    tail = F.element_at(F.array(*(F.lit(x) for x in (".asp", ".ASPX/y", ".php", ".Aspx", ".phpx", "/asp/b", "/php", ""))), (F.col("id") % 8 + 1).cast("int"))
    return endpoints.select("id", C.legacy_route(F.concat(F.lit("/a"), tail)).alias("legacy"))


@query("f17_endpoint_listing", "endpoints", "SELECT id, method, path FROM endpoints WHERE method = 'GET' AND lower(path) LIKE '%/en%' ORDER BY path, id LIMIT 10 OFFSET 3")
def endpoint_listing(spark, sf):
    (endpoints,) = tables(spark, sf, "endpoints")
    rows = endpoints.filter((F.col("method") == "GET") & C.contains_text(F.col("path"), "/en"))
    return rows.orderBy("path", "id").offset(3).limit(10).select("id", "method", "path")


@query("k03_repo_dependency_snapshot", QUEUES, "SELECT p.repo_id AS src, c.repo_id AS tgt, count(*) AS n FROM sqs_producers p JOIN (SELECT DISTINCT repo_id, queue_name FROM sqs_consumers) c ON c.queue_name = p.queue_name AND c.repo_id <> p.repo_id GROUP BY 1, 2")
def dependency_snapshot(spark, sf):
    rows = queues.repo_edges(*tables(spark, sf, "sqs_producers", "sqs_consumers"))
    return rows.groupBy("src", "tgt").agg(F.sum("n").alias("n"))


@query("w05_newest_generations", "repo_snapshots", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, repo_name ORDER BY generation DESC NULLS LAST, finished_at DESC NULLS LAST, id DESC) AS rn FROM repo_snapshots) WHERE rn <= 3")
def newest_generations(spark, sf):
    from loomgraph.operators.snapshots import retained

    return snapshots.retained(*tables(spark, sf, "repo_snapshots"), 3).select("id")

