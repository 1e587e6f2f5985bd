"""A deterministic estate for harness and tests: the driver's star-schema tables rendered as code facts.

Each statement is plain SQL that Spark and the oracle read alike. The engine's operators don't depend on it: they take any
DataFrames with the fact tables' columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.scope import joinable

#: Fact table -> (statement, base tables it reads). Statements may read earlier fact tables.
PROJECTION: dict[str, str] = {
    "repositories": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, concat('repos/', lower(n_name)) AS path, CAST(n_regionkey AS BIGINT) AS workspace_id FROM nation",
    "files": """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS repo_id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS snapshot_id,
        concat('src/', lower(c_mktsegment), '/F', CAST(c_custkey AS VARCHAR(20)), '.x') AS path,
        CASE c_custkey % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' WHEN 2 THEN 'csharp' ELSE 'rpgle' END AS language,
        CAST(c_custkey % 97 AS VARCHAR(20)) AS content_hash FROM customer""",
    "functions": """SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM customer) AS file_id,
        concat('Svc', CAST(p_size % 7 AS VARCHAR(20)), '.', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 5 = 0 THEN concat('_', CAST(p_partkey AS VARCHAR(20))) ELSE '' END) AS name,
        concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 5 = 0 THEN concat('_', CAST(p_partkey AS VARCHAR(20))) ELSE '' END) AS simple_name,
        CAST(p_size AS BIGINT) * 10 AS start_line, CAST(p_size AS BIGINT) * 10 + p_partkey % 9 AS end_line FROM part""",
    "function_calls": """SELECT l.l_orderkey * 1000 + CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate) AS BIGINT) AS id,
        l.l_partkey AS caller_function_id, CASE WHEN l.l_linestatus = 'O' THEN t.name ELSE t.simple_name END AS callee_name,
        c.start_line + l.l_linenumber % (c.end_line - c.start_line + 1) AS line_number, l.l_returnflag = 'R' AS is_async, l.l_returnflag = 'A' AND l.l_linenumber = 7 AS is_callback_argument
        FROM lineitem l JOIN functions c ON c.id = l.l_partkey JOIN functions t ON t.id = (l.l_orderkey * 7 + l.l_linenumber) % (SELECT count(*) FROM part)""",
    "endpoints": """SELECT page_id AS id, page_id % 25 AS repo_id, page_id % (SELECT count(*) FROM customer) AS file_id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'REQUEST' END AS method,
        CASE WHEN page_id % 10 = 6 THEN concat('/', split_part(url, '/', 4), '/tenant-', replace(split_part(url, '/', 3), '.', '-')) WHEN page_id % 4 = 0 THEN concat('/', split_part(split_part(url, '/', 4), '?', 1), '/:id') ELSE concat('/', split_part(url, '/', 4), '/', split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1)) END AS path,
        page_id % (SELECT count(*) FROM part) AS handler_function_id FROM pages WHERE page_id % 2 = 0""",
    "http_client_calls": """SELECT page_id AS id, page_id % 25 AS repo_id, CASE page_id % 4 WHEN 1 THEN 'GET' ELSE 'ANY' END AS http_method,
        CASE WHEN page_id % 10 = 9 THEN concat('/', split_part(url, '/', 4), '/tenant-', replace(split_part(url, '/', 3), '.', '-')) WHEN page_id % 3 = 0 THEN url WHEN page_id % 5 = 3 THEN concat('/v2/', split_part(url, '/', 4), '/tenant-', replace(split_part(url, '/', 3), '.', '-'), '/history') ELSE concat('/', split_part(url, '/', 4), '/', split_part(url, '/', 5)) END AS url_pattern,
        CASE WHEN page_id % 7 = 0 THEN 'navigation' ELSE 'fetch' END AS client_type, page_id % (SELECT count(*) FROM part) AS caller_function_id, page_id % 100 AS line_number FROM pages WHERE page_id % 2 = 1""",
    "sqs_producers": """SELECT event_id AS id, user_id % 25 AS repo_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN concat('arn:aws:sqs:us-east-1:1:', event_type) WHEN 2 THEN concat('https://sqs.example/1/', event_type)
        WHEN 3 THEN concat('%', upper(event_type), '_QUEUE%') ELSE concat(event_type, '.fifo') END AS queue_name, event_id % (SELECT count(*) FROM part) AS caller_function_id, event_id % 100 AS line_number FROM events WHERE event_id % 2 = 0""",
    "sqs_consumers": "SELECT event_id AS id, (user_id + 3) % 25 AS repo_id, event_type AS queue_name, event_id % (SELECT count(*) FROM part) AS handler_function_id FROM events WHERE event_id % 14 = 1 AND event_type <> 'error'",
    "data_accesses": """SELECT o_orderkey AS id, o_orderkey % 25 AS repo_id, concat('E', CAST(o_custkey % 40 AS VARCHAR(20))) AS entity_name, CASE WHEN o_orderstatus = 'F' THEN 'write' ELSE 'read' END AS access,
        o_orderkey % (SELECT count(*) FROM part) AS caller_function_id, o_orderkey % 100 AS line_number FROM orders""",
    "resource_aliases": """SELECT concat(upper(t), '_QUEUE') AS alias_key, t AS alias_value FROM (SELECT DISTINCT event_type AS t FROM events) x""",
    "eventbridge_schedules": "SELECT CAST(r_regionkey AS BIGINT) AS id, concat('rule-', lower(r_name)) AS rule_name, concat('rate(', CAST(r_regionkey + 1 AS VARCHAR(20)), ' hours)') AS schedule_expression, CASE r_regionkey % 2 WHEN 0 THEN 'Click' ELSE 'VIEW' END AS target_name, 'ENABLED' AS state FROM region",
    "classes": "SELECT s_suppkey AS id, s_suppkey % (SELECT count(*) FROM customer) AS file_id, concat('C', CAST(s_suppkey AS VARCHAR(20))) AS name, (s_suppkey % 5) * 100 AS start_line, (s_suppkey % 5) * 100 + 50 + s_suppkey % 300 AS end_line FROM supplier",
    "type_parents": "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS repo_id, concat('T', CAST(s_suppkey AS VARCHAR(20))) AS child, concat(CASE WHEN s_suppkey % 3 = 0 THEN 'pkg.' ELSE '' END, 'T', CAST(CAST(floor(s_suppkey / 3.0) AS BIGINT) AS VARCHAR(20)), CASE WHEN s_suppkey % 4 = 0 THEN '<String>' ELSE '' END) AS parent, CASE WHEN s_suppkey % 2 = 0 THEN 'implements' ELSE 'extends' END AS kind FROM supplier WHERE s_suppkey > 0",
    "fields": "SELECT c_custkey AS id, concat('T', CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR(20))) AS class_name, concat('dep', CAST(c_custkey % 3 AS VARCHAR(20))) AS name, concat('T', CAST(c_custkey % 5 AS VARCHAR(20))) AS type_name, CASE WHEN c_custkey % 4 = 0 THEN concat('T', CAST(c_custkey % 11 AS VARCHAR(20))) END AS qualifier FROM customer",
    "beans": "SELECT s_suppkey AS id, concat('T', CAST(s_suppkey AS VARCHAR(20))) AS name, s_suppkey % 6 = 0 AS is_primary FROM supplier",
    "repo_snapshots": """SELECT o_orderkey AS id, concat('NATION_', CAST(o_custkey % 25 AS VARCHAR(20))) AS repo_name, o_custkey % 5 AS workspace_id, CAST(o_orderkey % 37 AS BIGINT) AS generation, o_orderdate AS finished_at,
        CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 END AS depends_on FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 11 = 1""",
    "gateway_routes": "SELECT page_id AS id, page_id % 25 AS repo_id, CASE page_id % 2 WHEN 0 THEN 'GET' ELSE 'REQUEST' END AS method, concat('/gw/', split_part(url, '/', 4), '/*') AS path, concat('/', split_part(url, '/', 4)) AS backend_path FROM pages WHERE page_id % 10 = 0",
    "graphql_operations": "SELECT p_partkey AS id, p_partkey % 25 AS repo_id, concat('op_', p_brand) AS name, concat('src/graphql/', lower(p_type), '.graphql') AS file_path FROM part WHERE p_partkey % 20 = 0",
    "graphql_usages": "SELECT p_partkey AS id, p_partkey % 25 AS repo_id, concat('op_', p_brand) AS operation_name, concat('src/views/V', CAST(p_partkey AS VARCHAR(20)), '.ts') AS caller_path, concat('../graphql/', lower(p_type)) AS import_path FROM part WHERE p_partkey % 10 = 3",
    "graphql_resolvers": "SELECT p_partkey AS id, p_partkey % 25 AS repo_id, concat('op_', p_brand) AS operation_name, concat('Svc', CAST(p_size % 7 AS VARCHAR(20)), '.resolve') AS handler FROM part WHERE p_partkey % 10 = 4",
    "graphql_permissions": "SELECT p_partkey AS id, p_partkey % 25 AS repo_id, concat('op_', p_brand) AS operation_name, lower(p_type) AS role FROM part WHERE p_partkey % 10 = 9",
    "graphql_entrypoints": "SELECT p_partkey AS id, p_partkey % 25 AS repo_id, concat('src/graphql/', lower(p_type), '.ts') AS path FROM part WHERE p_partkey % 10 = 4",
    "triggers": "SELECT s_suppkey AS id, s_suppkey % 25 AS repo_id, concat('job-', CAST(s_suppkey AS VARCHAR(20))) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'timer' WHEN 1 THEN 'queue' ELSE 'http' END AS kind, concat('0 ', CAST(s_suppkey % 60 AS VARCHAR(20)), ' * * * *') AS value FROM supplier",
    "external_symbols": "SELECT p_partkey AS id, p_partkey % 25 AS repo_id, concat('lib', CAST(p_size % 5 AS VARCHAR(20)), '.', replace(p_name, ' ', '_')) AS name FROM part WHERE p_partkey % 2 = 1",
    "types": """SELECT s_suppkey AS id, s_suppkey % 5 AS repo_id, s_suppkey % 40 AS file_id, CASE s_suppkey % 7 WHEN 6 THEN 'java.lang' ELSE concat('p', CAST(s_suppkey % 7 AS VARCHAR(20))) END AS package,
        CASE WHEN s_suppkey % 9 = 4 THEN concat('T', CAST((s_suppkey + 40) % 30 AS VARCHAR(20)), '.T', CAST(s_suppkey % 30 AS VARCHAR(20))) ELSE concat('T', CAST(s_suppkey % 30 AS VARCHAR(20))) END AS name FROM supplier""",
    "type_bases": "SELECT s_suppkey AS type_id, concat(CASE WHEN s_suppkey % 4 = 0 THEN 'p2.' ELSE '' END, 'T', CAST((s_suppkey * 7 + 5) % 30 AS VARCHAR(20)), CASE WHEN s_suppkey % 3 = 0 THEN '<A<B>>' ELSE '' END) AS base FROM supplier",
    "type_imports": "SELECT s_suppkey % 40 AS file_id, CASE WHEN s_suppkey % 2 = 0 THEN concat('p', CAST(s_suppkey % 6 AS VARCHAR(20))) ELSE concat('p', CAST(s_suppkey % 7 AS VARCHAR(20)), '.T', CAST(s_suppkey % 30 AS VARCHAR(20))) END AS path, s_suppkey % 2 = 0 AS wildcard FROM supplier",
    "type_symbols": """SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS repo_id, concat('T', CAST(s_suppkey AS VARCHAR(20))) AS name, CASE s_suppkey % 6 WHEN 0 THEN 'interface' WHEN 1 THEN 'type_alias' WHEN 2 THEN 'hook'
        WHEN 3 THEN 'component_contract' WHEN 4 THEN 'store' ELSE 'enum_constant' END AS kind FROM supplier""",
    "source_texts": "SELECT doc_id AS function_id, text AS source_code FROM documents",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needed(names: tuple[str, ...]) -> list[str]:
    """Fact tables that names need, in order of building."""
    found: set[str] = set()
    todo = list(names)
    while todo:
        one = todo.pop()
        if one not in found:
            found.add(one)
            todo += [x for x in PROJECTION if x != one and re.search(rf"\b(?:FROM|JOIN) {x}\b", PROJECTION[one])]
    return [x for x in PROJECTION if x in found]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Fact tables as DataFrames."""
    built: dict[str, DataFrame] = {}
    for name in needed(names):
        text = PROJECTION[name]
        reads = {x for x in [*BASE, *built] if re.search(rf"\b(?:FROM|JOIN) {x}\b", text)}
        text = re.sub(r"\b(FROM|JOIN) (" + "|".join(sorted(reads, key=len, reverse=True)) + r")\b", r"\1 {\2}", text)
        built[name] = spark.sql(text, **{x: joinable(built[x]) if x in built else spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in reads})
    return [built[x] for x in names]


def with_tables(names: str, query: str) -> str:
    """The oracle's statement: the projection of the tables named, then query (a SELECT, or further tables and a SELECT)."""
    parts = ", ".join(f"{x} AS ({PROJECTION[x]})" for x in needed(tuple(names.split())))
    query = query.strip()
    recursive = "RECURSIVE " if "RECURSIVE" in query[:20] else ""
    if query.upper().startswith("WITH"):
        query = query[4:].strip().removeprefix("RECURSIVE").strip()
        return f"WITH {recursive}{parts}, {query}" if parts else f"WITH {recursive}{query}"
    return f"WITH {parts} {query}" if parts else query
