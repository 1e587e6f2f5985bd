"""Queries on identities, scope, windows and call resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import audit, resolve, scope, snapshots
from loomgraph.operators.tables import checkpointed
from loomgraph.plans.registry import IDENT, query
from loomgraph.sources.estate import tables

IDENT_TABLES = "repositories files functions"

RESOLVED = f"""{IDENT}, own AS (SELECT id AS fid, file_id, repo_id, coalesce(snapshot_id, -1) AS snap, name, simple_name, language, regexp_replace(name, '\\.[^.]+$', '') AS cls FROM ident),
l1 AS (SELECT file_id, name, min(fid) AS t FROM own GROUP BY 1, 2 HAVING count(*) = 1),
k2 AS (SELECT DISTINCT repo_id, snap, fid, name AS k FROM own UNION
       SELECT DISTINCT repo_id, snap, fid, substr(name, strpos(name, '.') + 1) AS k FROM own WHERE language = 'java' AND length(name) - length(replace(name, '.', '')) >= 2),
l2 AS (SELECT repo_id, snap, k, min(fid) AS t FROM k2 GROUP BY 1, 2, 3 HAVING count(*) = 1),
l3 AS (SELECT repo_id, snap, name, min(fid) AS t FROM own GROUP BY 1, 2, 3 HAVING count(*) = 1),
l5 AS (SELECT repo_id, snap, simple_name, min(fid) AS t FROM own GROUP BY 1, 2, 3 HAVING count(*) = 1),
tiers AS (
  SELECT c.*, l1.t AS t1, l2.t AS t2, l3.t AS t3, l4.t AS t4, l5.t AS t5
  FROM function_calls c JOIN own o ON o.fid = c.caller_function_id
  LEFT JOIN l1 ON l1.file_id = o.file_id AND l1.name = c.callee_name
  LEFT JOIN l2 ON l2.repo_id = o.repo_id AND l2.snap = o.snap AND l2.k = c.callee_name AND strpos(c.callee_name, '.') > 0
  LEFT JOIN l3 ON l3.repo_id = o.repo_id AND l3.snap = o.snap AND starts_with(c.callee_name, 'this.') AND strpos(substr(c.callee_name, 6), '.') = 0 AND l3.name = concat(o.cls, '.', substr(c.callee_name, 6))
  LEFT JOIN l3 l4 ON l4.repo_id = o.repo_id AND l4.snap = o.snap AND strpos(c.callee_name, '.') = 0 AND l4.name = concat(o.cls, '.', c.callee_name)
  LEFT JOIN l5 ON l5.repo_id = o.repo_id AND l5.snap = o.snap AND strpos(c.callee_name, '.') = 0 AND l5.simple_name = c.callee_name),
resolved AS (
  SELECT id, caller_function_id, callee_name, line_number, is_async, is_callback_argument, coalesce(t1, t2, t3, t4, t5) AS callee_function_id,
    CASE WHEN coalesce(t1, t2, t3, t4, t5) IS NULL THEN NULL WHEN is_callback_argument THEN 'callback_argument' WHEN t1 IS NOT NULL THEN 'same_file' WHEN t2 IS NOT NULL THEN 'qualified_repo'
         WHEN t3 IS NOT NULL THEN 'same_class_this' WHEN t4 IS NOT NULL THEN 'same_class_simple' ELSE 'unique_repo' END AS source,
    CASE WHEN coalesce(t1, t2, t3, t4, t5) IS NULL THEN NULL WHEN is_callback_argument THEN 'low' WHEN coalesce(t1, t2, t3, t4) IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence
  FROM tiers)"""

REASON = r"""CASE WHEN trim(callee_name) = '' THEN '' WHEN regexp_matches(lower(callee_name), '^(system|microsoft|string|datetime|guid)\.') THEN 'stdlib_csharp' ELSE 'unknown' END"""

EDGES = f"""{RESOLVED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY caller_function_id, coalesce(callee_function_id, 0), callee_name, coalesce(line_number, -1), is_async, is_callback_argument ORDER BY id) AS rn FROM resolved),
edges AS (SELECT r.id, a.repo_id, a.snapshot_id, r.caller_function_id, r.callee_function_id, a.caller_id, b.caller_id AS callee_id, r.callee_name, b.repo_name AS callee_repo, b.file_path AS callee_file, b.name AS callee_func,
  r.line_number, r.source, r.confidence, CASE WHEN b.id IS NULL THEN {REASON} END AS unresolved_reason
  FROM ranked r JOIN ident a ON a.id = r.caller_function_id LEFT JOIN ident b ON b.id = r.callee_function_id WHERE rn = 1)"""

EDGE_TABLES = "repositories files functions function_calls"


def ident(spark, sf):
    repositories, files, functions = tables(spark, sf, "repositories", "files", "functions")
    return scope.identified(functions, files, repositories)


def resolved(spark, sf):
    (calls,) = tables(spark, sf, "function_calls")
    return resolve.resolve_calls(calls, ident(spark, sf))


def edges(spark, sf):
    own = ident(spark, sf)
    (calls,) = tables(spark, sf, "function_calls")
    return resolve.trace_edges(resolve.resolve_calls(calls, own), own)


@query("j01_identified_functions", IDENT_TABLES, f"WITH {IDENT} SELECT id, caller_id, split_part(caller_id, ':', 1) AS repo, split_part(caller_id, ':', 2) AS file, split_part(caller_id, ':', 3) AS func FROM ident")
def identified_functions(spark, sf):
    x = F.col("caller_id")
    return ident(spark, sf).select("id", "caller_id", C.caller_part(x, 1).alias("repo"), C.caller_part(x, 2).alias("file"), C.caller_part(x, 3).alias("func"))


@query("f01_snapshot_scope", "files", "SELECT 'none' AS mode, count(*) AS n FROM files UNION ALL SELECT 'list', count(*) FROM files WHERE snapshot_id IN (1, 2, 3) UNION ALL SELECT 'legacy', count(*) FROM files WHERE snapshot_id IN (1, 2, 3) OR snapshot_id IS NULL UNION ALL SELECT 'empty', 0")
def snapshot_scope(spark, sf):
    (files,) = tables(spark, sf, "files")
    s = F.col("snapshot_id")
    flags = {"none": scope.in_scope(s, None), "list": scope.in_scope(s, [1, 2, 3]), "legacy": scope.in_scope(s, [1, 2, 3], True), "empty": scope.in_scope(s, [])}
    row = files.agg(*(F.count_if(v).alias(k) for k, v in flags.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mode"), F.col(k).alias("n")) for k in flags))).alias("x")).select("x.*")


@query("f01_scope_semi_join", "files repositories", "SELECT f.id, f.snapshot_id FROM files f WHERE f.snapshot_id IN (SELECT id FROM repositories WHERE workspace_id = 2) OR f.snapshot_id IS NULL")
def scope_semi_join(spark, sf):
    files, repositories = tables(spark, sf, "files", "repositories")
    active = repositories.filter("workspace_id = 2").select(F.col("id").alias("snapshot_id"))
    return scope.semi_scope(files, active, legacy=True).select("id", "snapshot_id")


@query("j03_batched_lookup", IDENT_TABLES, f"WITH {IDENT}, k AS (SELECT DISTINCT repo_name, name FROM ident), r AS (SELECT i.*, row_number() OVER (PARTITION BY i.repo_name, i.name ORDER BY start_line, end_line, id) AS rn FROM ident i JOIN k ON k.repo_name = i.repo_name AND k.name = i.name) SELECT repo_name, name, id FROM r WHERE rn = 1")
def batched_lookup(spark, sf):
    own = ident(spark, sf)
    keys = own.select("repo_name", "name").distinct()
    return scope.lookup(keys, own, ["repo_name", "name"]).select("repo_name", "name", "id")


@query("j04_null_safe_join", "files", "SELECT a.id, count(*) AS n FROM files a JOIN files b ON a.snapshot_id IS NOT DISTINCT FROM b.snapshot_id AND a.content_hash = b.content_hash GROUP BY 1")
def null_safe_join(spark, sf):
    (files,) = tables(spark, sf, "files")
    a, b = files.select("id", "snapshot_id", "content_hash"), files.select(F.col("snapshot_id").alias("s"), F.col("content_hash").alias("h"))
    return a.join(b, F.col("snapshot_id").eqNullSafe(F.col("s")) & (F.col("content_hash") == F.col("h"))).groupBy("id").agg(F.count("*").alias("n"))


@query("j15_call_resolution", EDGE_TABLES, f"WITH {RESOLVED} SELECT id, callee_function_id, source, confidence FROM resolved")
def call_resolution(spark, sf):
    return resolved(spark, sf).select("id", "callee_function_id", "source", "confidence")


@query("j15_resolution_counts", EDGE_TABLES, f"WITH {RESOLVED} SELECT coalesce(source, 'unresolved') AS source, count(*) AS n FROM resolved GROUP BY 1")
def resolution_counts(spark, sf):
    return resolved(spark, sf).groupBy(F.coalesce("source", F.lit("unresolved")).alias("source")).agg(F.count("*").alias("n"))


@query(
    "j16_qualified_suffixes",
    "files functions",
    """WITH n AS (SELECT fn.id, concat('pkg.', fn.name) AS name FROM functions fn JOIN files f ON f.id = fn.file_id WHERE f.language = 'java')
    SELECT id, name AS suffix FROM n UNION ALL SELECT id, substr(name, 5) AS suffix FROM n""",
)
def qualified_suffixes(spark, sf):
    files, functions = tables(spark, sf, "files", "functions")
    java = functions.join(files.filter("language = 'java'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return java.select("id", F.explode(resolve.suffixes(F.concat(F.lit("pkg."), F.col("name")))).alias("suffix"))


ACROSS = f"""{RESOLVED}, kin AS (SELECT *, CASE language WHEN 'java' THEN 'jvm' WHEN 'typescript' THEN 'js' WHEN 'csharp' THEN 'dotnet' ELSE 'ibmi' END AS kin FROM ident),
    kf AS (SELECT *, CASE WHEN kin = 'ibmi' THEN lower(name) ELSE name END AS q, CASE WHEN kin = 'ibmi' THEN lower(simple_name) ELSE simple_name END AS s FROM kin),
    calls AS (SELECT r.id, k.repo_id, k.kin, CASE WHEN k.kin = 'ibmi' THEN lower(r.callee_name) ELSE r.callee_name END AS key FROM resolved r JOIN kf k ON k.id = r.caller_function_id WHERE r.callee_function_id IS NULL),
    d AS (SELECT kin, q, min(id) AS target, min(repo_id) AS repo_id FROM kf WHERE strpos(q, '.') > 0 GROUP BY 1, 2 HAVING count(*) = 1),
    one AS (SELECT c.id, d.target, 'qualified_workspace' AS source FROM calls c JOIN d ON d.kin = c.kin AND d.q = c.key WHERE d.repo_id <> c.repo_id),
    two AS (SELECT c.id, min(k.id) AS target, 'unique_workspace' AS source FROM calls c JOIN kf k ON k.kin = c.kin AND k.s = c.key AND k.repo_id <> c.repo_id WHERE strpos(c.key, '.') = 0 GROUP BY c.id HAVING count(*) = 1),
    across AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE id NOT IN (SELECT id FROM one))"""


@query("j18_cross_repo_resolution", EDGE_TABLES, f"WITH {ACROSS} SELECT * FROM across")
def cross_repo_resolution(spark, sf):
    open_calls = resolved(spark, sf).filter("callee_function_id IS NULL").select("id", "caller_function_id", "callee_name")
    return resolve.resolve_across(open_calls, ident(spark, sf))


@query("f15_unresolved_reasons", EDGE_TABLES, f"WITH {RESOLVED} SELECT {REASON} AS reason, count(*) AS n FROM resolved WHERE callee_function_id IS NULL GROUP BY 1")
def unresolved_reasons(spark, sf):
    return audit.unresolved_calls(resolved(spark, sf))


@query("f18_callback_cap", EDGE_TABLES, f"WITH {RESOLVED} SELECT id, source, confidence FROM resolved WHERE is_callback_argument AND callee_function_id IS NOT NULL")
def callback_cap(spark, sf):
    return resolved(spark, sf).filter("is_callback_argument AND callee_function_id IS NOT NULL").select("id", "source", "confidence")


@query("w03_call_dedup", EDGE_TABLES, f"WITH {EDGES} SELECT count(*) AS kept, (SELECT count(*) FROM resolved) - count(*) AS dropped FROM edges")
def call_dedup(spark, sf):
    rows = resolved(spark, sf)
    kept = resolve.dedupe_calls(rows).agg(F.count("*").alias("kept"))
    return kept.join(rows.agg(F.count("*").alias("every")), F.lit(True)).select("kept", (F.col("every") - F.col("kept")).alias("dropped"))


@query("d08_trace_edges", EDGE_TABLES, f"WITH {EDGES} SELECT * FROM edges")
def trace_edges(spark, sf):
    return edges(spark, sf)


@query("a07_repo_fan_in", EDGE_TABLES, f"WITH {ACROSS} SELECT b.repo_name AS callee_repo, count(DISTINCT a.repo_id) AS fan_in FROM across x JOIN function_calls c ON c.id = x.id JOIN ident a ON a.id = c.caller_function_id JOIN ident b ON b.id = x.target WHERE a.repo_name <> b.repo_name GROUP BY 1")
def repo_fan_in(spark, sf):
    """Distinct calling repositories of each repository, over calls resolved across repositories: one resolved within its own never counts."""
    own, rows = ident(spark, sf), resolved(spark, sf)
    open_calls = rows.filter("callee_function_id IS NULL").select("id", "caller_function_id", "callee_name")
    pairs = resolve.answers_across(open_calls, own).select(F.col("caller_repo").alias("repo_id"), F.col("target").alias("id")).distinct()
    (repositories,) = tables(spark, sf, "repositories")
    named = repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("caller_name"))
    return fan_in(pairs.join(own.select("id", F.col("repo_name").alias("callee_repo")), "id").join(named, "repo_id"))


def fan_in(rows):
    seen = rows.filter(F.col("callee_repo").isNotNull() & (F.col("callee_repo") != "") & (F.col("caller_name") != F.col("callee_repo"))).select("callee_repo", "repo_id").distinct()
    return seen.groupBy("callee_repo").agg(F.count("*").alias("fan_in"))


CROSS = """cross_edges AS (SELECT DISTINCT a.repo_id AS src, b.repo_name AS callee_repo FROM function_calls c JOIN ident a ON a.id = c.caller_function_id
  JOIN (SELECT simple_name, min(id) AS id FROM ident GROUP BY 1 HAVING count(*) = 1) u ON u.simple_name = c.callee_name JOIN ident b ON b.id = u.id WHERE a.repo_name <> b.repo_name)"""


@query("a07_fan_in_by_unique_name", EDGE_TABLES, f"WITH {IDENT}, {CROSS} SELECT callee_repo, count(DISTINCT src) AS fan_in FROM cross_edges GROUP BY 1")
def fan_in_by_name(spark, sf):
    own = ident(spark, sf)
    (calls,) = tables(spark, sf, "function_calls")
    named = scope.unique(own, ["simple_name"], "id", "callee").withColumnRenamed("simple_name", "callee_name")
    caller = own.select(F.col("id").alias("caller_function_id"), "repo_id", F.col("repo_name").alias("caller_name"))
    callee = own.select(F.col("id").alias("callee"), F.col("repo_name").alias("callee_repo"))
    return fan_in(calls.join(named, "callee_name").join(caller, "caller_function_id").join(callee, "callee"))


@query("a03_unique_names", "files functions", "SELECT f.repo_id, fn.simple_name, min(fn.id) AS function_id FROM functions fn JOIN files f ON f.id = fn.file_id GROUP BY 1, 2 HAVING count(*) = 1")
def unique_names(spark, sf):
    return scope.unique(ident(spark, sf), ["repo_id", "simple_name"], "id", "function_id")


@query("a04_duplicate_endpoints", "endpoints files", "SELECT repo_id, '/x' AS route, upper(method) AS method, 0 AS handler, count(*) AS n FROM endpoints GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def duplicate_endpoints(spark, sf):
    endpoints, files = tables(spark, sf, "endpoints", "files")
    folded = endpoints.withColumn("path", F.lit("/X")).withColumn("handler_function_id", F.lit(0).cast("long"))
    one_file = files.select(F.lit(0).cast("long").alias("id"), F.lit("src/a").alias("path")).limit(1)
    return audit.duplicate_endpoints(folded.withColumn("file_id", F.lit(0).cast("long")), one_file).drop("file_id")


@query("w01_endpoint_dedup", "endpoints", "SELECT min(id) AS id, repo_id, path, method FROM endpoints GROUP BY repo_id, path, method")
def endpoint_dedup(spark, sf):
    (endpoints,) = tables(spark, sf, "endpoints")
    return scope.first_of(endpoints, ["repo_id", "path", "method"], "id").select("id", "repo_id", "path", "method")


@query(
    "w02_survivors_repoint",
    EDGE_TABLES,
    f"WITH {IDENT}, s AS (SELECT id AS old, min(id) OVER (PARTITION BY repo_id, name) AS survivor FROM ident) SELECT c.id, s.survivor AS caller_function_id FROM function_calls c JOIN s ON s.old = c.caller_function_id",
)
def survivors_repoint(spark, sf):
    (calls,) = tables(spark, sf, "function_calls")
    moved = snapshots.survivors(ident(spark, sf), ["repo_id", "name"])
    return snapshots.repoint(calls.select("id", "caller_function_id"), "caller_function_id", moved)


@query("w04_dense_rank", "functions", "SELECT id, dense_rank() OVER (PARTITION BY file_id ORDER BY start_line DESC) AS priority FROM functions")
def dense_rank(spark, sf):
    from pyspark.sql import Window

    (functions,) = tables(spark, sf, "functions")
    return functions.select("id", F.dense_rank().over(Window.partitionBy("file_id").orderBy(F.col("start_line").desc())).alias("priority"))


@query("w06_distinct_on_caller", "function_calls", "SELECT caller_function_id, min(line_number) AS line_number FROM function_calls GROUP BY 1")
def distinct_on(spark, sf):
    (calls,) = tables(spark, sf, "function_calls")
    return scope.first_of(calls, ["caller_function_id"], F.col("line_number").asc_nulls_last(), "id").select("caller_function_id", "line_number")


@query(
    "j28_innermost_class",
    "functions classes",
    """WITH m AS (SELECT fn.id, c.id AS span_id, row_number() OVER (PARTITION BY fn.id ORDER BY c.end_line - c.start_line, c.start_line DESC, c.id) AS rn
    FROM functions fn JOIN classes c ON c.file_id % 50 = fn.file_id % 50 AND fn.start_line BETWEEN c.start_line AND c.end_line) SELECT id, span_id FROM m WHERE rn = 1""",
)
def innermost_class(spark, sf):
    functions, classes = tables(spark, sf, "functions", "classes")
    points = functions.select("id", (F.col("file_id") % 50).alias("bucket"), F.col("start_line").alias("line_number"))
    spans = classes.select(F.col("id").alias("span_id"), (F.col("file_id") % 50).alias("bucket"), "start_line", "end_line")
    return scope.innermost(points, spans, ["bucket"]).select("id", "span_id")


@query(
    "f06_range_overlap",
    IDENT_TABLES,
    f"WITH {IDENT} SELECT id, repo_name FROM ident WHERE repo_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND start_line <= 150 AND end_line >= 100",
)
def range_overlap(spark, sf):
    ranges = spark.createDataFrame([(f"NATION_{k}", 100, 150) for k in (1, 2, 3)], "repo_name string, low long, high long")
    return scope.overlapping(ranges, ident(spark, sf), ["repo_name"]).select("id", "repo_name")


@query(
    "f06_merged_ranges",
    "functions",
    """WITH b AS (SELECT file_id, start_line, end_line, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM functions),
    g AS (SELECT *, sum(CASE WHEN m IS NULL OR start_line > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT file_id, min(start_line) AS low, max(end_line) AS high FROM g GROUP BY file_id, k""",
)
def merged_ranges(spark, sf):
    (functions,) = tables(spark, sf, "functions")
    return scope.merged_ranges(functions.select("file_id", F.col("start_line").alias("low"), F.col("end_line").alias("high")), ["file_id"])


@query("f12_name_based_gate", EDGE_TABLES, f"""WITH {RESOLVED}, k AS (SELECT r.id, regexp_replace(r.callee_name, '^.*\\.', '') AS key, r.callee_name, i.file_id, i.repo_id FROM resolved r JOIN ident i ON i.id = r.caller_function_id WHERE r.callee_function_id IS NULL)
    SELECT k.id FROM k WHERE length(callee_name) >= 3 AND (EXISTS (SELECT 1 FROM ident i WHERE i.file_id = k.file_id AND i.simple_name = k.key) OR (SELECT count(*) FROM ident i WHERE i.repo_id = k.repo_id AND i.simple_name = k.key) = 1)""")
def name_gate(spark, sf):
    open_calls = resolved(spark, sf).filter("callee_function_id IS NULL")
    return resolve.name_gate(open_calls, ident(spark, sf), C.generic_method(F.col("callee_name"))).select("id")


@query("f16_access_classes", sql="""SELECT m AS method, CASE WHEN m IN ('save', 'deletebyid', 'flush', 'removeAll', 'createOne') THEN 'write' WHEN m IN ('find', 'findSaved', 'existsBy', 'count', 'listAll') THEN 'read' ELSE '' END AS access
    FROM (VALUES ('save'), ('deletebyid'), ('flush'), ('removeAll'), ('createOne'), ('find'), ('findSaved'), ('existsBy'), ('count'), ('listAll'), ('counter'), ('apply')) t(m)""")
def access_classes(spark, sf):
    names = "save deletebyid flush removeAll createOne find findSaved existsBy count listAll counter apply".split()
    return spark.createDataFrame([(x,) for x in names], "method string").select("method", C.access_class(F.col("method")).alias("access"))


@query("f20_freshness", sql="SELECT event_id, CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-10 00:00:00') <= 86400 THEN 'recent' WHEN date_diff('second', ts, TIMESTAMP '2024-01-10 00:00:00') <= 604800 THEN 'aging' ELSE 'stale' END AS status FROM events")
def freshness(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"), now) / 3600
    return events.select("event_id", C.freshness(age).alias("status"))


@query("j29_cross_seed", "repositories", "SELECT r.id, r.name, 0 AS workspace FROM repositories r")
def cross_seed(spark, sf):
    (repositories,) = tables(spark, sf, "repositories")
    return repositories.select("id", "name").join(F.broadcast(spark.createDataFrame([(0,)], "workspace int")), F.lit(True))


@query("j31_semi_join", "repositories sqs_producers", "SELECT id, name FROM repositories r WHERE EXISTS (SELECT 1 FROM sqs_producers p WHERE p.repo_id = r.id AND p.queue_name = 'signup.fifo')")
def semi_join(spark, sf):
    repositories, producers = tables(spark, sf, "repositories", "sqs_producers")
    return repositories.join(producers.filter("queue_name = 'signup.fifo'").select(F.col("repo_id").alias("id")), "id", "left_semi").select("id", "name")


@query("j32_anti_join", "functions function_calls", "SELECT id FROM functions f WHERE NOT EXISTS (SELECT 1 FROM function_calls c WHERE c.caller_function_id = f.id AND c.is_callback_argument)")
def anti_join(spark, sf):
    functions, calls = tables(spark, sf, "functions", "function_calls")
    return functions.join(calls.filter("is_callback_argument").select(F.col("caller_function_id").alias("id")), "id", "left_anti").select("id")


@query("f11_generic_methods", sql="""SELECT m AS name, m IN ('get', 'getUser', 'is_on', 'has2', 'HashMap.put', 'Set', 'hashX.y') AS generic FROM (VALUES ('get'), ('getUser'), ('is_on'), ('has2'), ('HashMap.put'), ('svc.getUser'), ('issueRefund'), ('getVeryLongMethodName'), ('Set'), ('hashX.y')) t(m)""")
def generic_methods(spark, sf):
    names = "get getUser is_on has2 HashMap.put svc.getUser issueRefund getVeryLongMethodName Set hashX.y".split()
    own = spark.createDataFrame([(x,) for x in names], "name string")
    return own.select("name", C.generic_method(F.col("name")).alias("generic"))


@query("a01_stats", "repositories files functions classes endpoints", "SELECT (SELECT count(*) FROM repositories) AS repositories, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM classes) AS classes, (SELECT count(*) FROM endpoints) AS endpoints")
def stats(spark, sf):
    names = ("repositories", "files", "functions", "classes", "endpoints")
    out = None
    for name, rows in zip(names, tables(spark, sf, *names), strict=True):
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one, F.lit(True))
    return out


def cached_edges(spark, sf):
    return checkpointed(edges(spark, sf))
