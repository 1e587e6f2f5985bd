import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import flow, graph, impact, integrations, resolve, routes, scope, search, snapshots, tables, types, verify
from loomgraph.plans import estate_queries
from loomgraph.sources import inputs
from loomgraph.streaming import events
from tests.conftest import same_rows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ambiguous_tier_falls_through(spark):
    functions = spark.createDataFrame([(1, 1, 1, 7, "A.run", "run", "java"), (2, 2, 1, 7, "B.run", "run", "java"), (3, 1, 1, 7, "A.go", "go", "java"), (4, 1, 1, 7, "A.run2", "run2", "java")], "id long, file_id long, repo_id long, snapshot_id long, name string, simple_name string, language string")
    calls = spark.createDataFrame([(1, 3, "run", False), (2, 2, "run2", False), (3, 2, "x", False), (4, 3, "this.run", False), (5, 3, "A.run2", True)], "id long, caller_function_id long, callee_name string, is_callback_argument boolean")
    found = resolve.resolve_calls(calls, functions)
    assert rows(found, "id", "callee_function_id", "source", "confidence")[:2] == [(1, 1, "same_class_simple", "high"), (2, 4, "unique_repo", "medium")]
    held = {r.id: (r.callee_function_id, r.source, r.confidence) for r in found.collect()}
    assert held[3] == (None, None, None) and held[4] == (1, "same_class_this", "high") and held[5] == (4, "callback_argument", "low")


def test_method_wildcards(spark):
    calls = spark.createDataFrame([(1, 1, "ANY", "/a/1", "fetch", 1, 1), (2, 1, "GET", "/a/1", "fetch", 1, 1), (3, 1, "GET", "/a/:x/:y", "fetch", 1, 1)], "id long, repo_id long, http_method string, url_pattern string, client_type string, caller_function_id long, line_number long")
    endpoints = spark.createDataFrame([(1, 2, "POST", "/a/{id}"), (2, 2, "ANY", "/a/1"), (3, 2, "REQUEST", "/a/1")], "id long, repo_id long, method string, path string")
    assert rows(routes.contract_callers(calls, endpoints), "call_id", "endpoint_id") == [(1, 1), (1, 2), (1, 3), (2, 3)]
    held = {r.id: r["class"] for r in routes.audit_classes(calls, endpoints).collect()}
    assert held == {1: "invalid_method_token", 2: "matched", 3: "matched"}


def test_trace_cascade_stops_at_first_tier(spark):
    calls = spark.createDataFrame([(1, "GET", "/a/b"), (2, "PUT", "/a/b"), (3, "GET", "/q/7"), (4, "GET", "/svc/z")], "id long, http_method string, url_pattern string")
    endpoints = spark.createDataFrame([(1, "GET", "/a/b"), (2, "REQUEST", "/a/b"), (3, "GET", "/a/:x"), (4, "GET", "/q/:id"), (5, "GET", "/z")], "id long, method string, path string")
    assert rows(routes.trace_cascade(calls, endpoints, ("/svc",)), "call_id", "endpoint_id") == [(1, 1), (2, 2), (3, 4), (4, 5)]


def test_walks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (5, 5)], "src long, dst long")
    root = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.bfs(edges, root, 5), "node", "depth", "parent")[1:] == [(2, 1, 1), (3, 2, 2), (4, 1, 1)]
    assert rows(graph.shortest_path(edges, 1, 3), "step", "src", "dst") == [(1, 1, 2), (2, 2, 3)]
    assert graph.shortest_path(edges, 3, 5).count() == 0 and graph.shortest_path(edges, 1, 1).count() == 0
    kept, clipped = graph.frontier_bounded(edges.withColumn("edge_type", F.lit("call")), spark.createDataFrame([(3,)], "node long"), 1, 10)
    assert rows(kept, "node", "depth") == [(2, 1), (3, 0), (4, 1)] and clipped.first().clipped
    assert graph.bfs(edges, root.limit(0), 3).count() == 0


def test_walks_end_where_no_edge_leaves(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 4), (4, 5), (6, 7)], "src long, dst long")
    # towards a node that is never reached, and past one that is; a doubled edge is walked twice
    assert rows(graph.walks(edges, 1, 9), "step", "src", "dst") == [(1, 1, 2), (2, 2, 3), (2, 2, 3), (3, 3, 4), (3, 3, 4), (4, 4, 5), (4, 4, 5)]
    assert rows(graph.walks(edges, 1, 3), "step", "src", "dst") == [(1, 1, 2), (2, 2, 3), (2, 2, 3)]
    assert graph.walks(edges, 8, 9).count() == 0


def test_path_query_on_short_and_long_conversations(spark, tmp_path):
    """Conversation 3 ends before 304; the hundredth turn of conversation 2 bears the number of the first of 3."""
    turns = [(2, t) for t in range(105)] + [(3, t) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    held = duckdb.connect()
    held.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(estate_queries.queries()["r01_shortest_path"](spark, str(tmp_path)), held, estate_queries.oracle_sql()["r01_shortest_path"])


def test_large_lookups_are_not_broadcast(spark, sf, monkeypatch):
    """Functions are estimated by the size of their compressed files: beyond a small one no join builds them in the driver."""
    plan = lambda: estate_queries.queries()["a07_repo_fan_in"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    joins = lambda text: [x for x in text.splitlines() if "BroadcastHashJoin" in x and any(k in x for k in ("l_partkey", "file_id"))]
    assert joins(plan())
    monkeypatch.setattr(scope, "SMALL", 0)
    assert not joins(plan())


def boundary_facts(spark):
    """A queue that functions both send to and consume, an entity of several repositories, HTTP calls, plain calls."""
    calls = spark.createDataFrame([(1, 2), (2, 2), (2, 3), (9, 1)], "src long, dst long")
    http = spark.createDataFrame([(1, 3, "GET", "/a/b"), (2, 5, "ANY", "/c/d"), (3, 7, "GET", "/a/b")], "id long, caller_function_id long, http_method string, url_pattern string")
    endpoints = spark.createDataFrame([(1, 7, "GET", "/a/b"), (2, 8, "REQUEST", "/a/b"), (3, 8, "POST", "/c/:x")], "id long, handler_function_id long, method string, path string")
    producers = spark.createDataFrame([(n, "q.fifo" if n % 2 else "q") for n in range(1, 7)], "caller_function_id long, queue_name string")
    consumers = spark.createDataFrame([(k, "Q", n) for k, n in enumerate([2, 3, 3, 11, 12])], "id long, queue_name string, handler_function_id long")
    aliases = spark.createDataFrame([], "alias_key string, alias_value string")
    accesses = spark.createDataFrame([("E", "write", 1, 4), ("e", "write", 2, 4), ("E", "read", 1, 13), ("E", "read", 2, 14), ("E", "read", 2, 4)], "entity_name string, access string, repo_id long, caller_function_id long")
    return calls, http, endpoints, producers, consumers, aliases, accesses


def test_boundary_counts_are_those_of_all_edges(spark):
    facts = boundary_facts(spark)
    every = flow.boundary_edges(*facts).groupBy("src", "via", "what").agg(F.count("*").alias("n"), F.sum("dst").alias("targets"))
    columns = ("src", "via", "what", "n", "targets")
    found = flow.boundary_counts(*facts)
    assert rows(found, *columns) == rows(every, *columns)
    # 2 and 3 consume what they send
    assert {(2, "sqs", "q", 3, 26), (3, "sqs", "q.fifo", 3, 25)} <= set(rows(found, *columns))


def test_boundary_steps_walk_as_all_edges_do(spark):
    """Both ways, a walk over the least edges finds the nodes, depths, parents and kinds that it finds over all."""
    facts = boundary_facts(spark)
    every = flow.boundary_edges(*facts)
    for back, edges in ((False, every), (True, every.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "via"))):
        listed = edges.withColumnRenamed("via", "edge_type")
        for root in ((1,), (4,), (14,)):
            start = spark.createDataFrame([root, (3,)], "node long")
            step = lambda near: flow.boundary_steps(*facts, near, back).withColumnRenamed("via", "edge_type")  # noqa: B023, E731
            assert sorted(graph.bfs(step, start, 3).collect(), key=str) == sorted(graph.bfs(listed, start, 3).collect(), key=str)
    hub = spark.range(3).withColumnRenamed("id", "node")
    assert flow.boundary_steps(*facts, hub).filter("via = 'sqs'").groupBy("dst").count().filter("count > 1").count() == 0


def test_bounded_frontier_looks_beyond_only_if_asked(spark):
    edges = spark.createDataFrame([(2, 1, "call"), (3, 2, "call"), (4, 3, "call"), (1, 3, "call")], "src long, dst long, edge_type string")
    def back(near):
        return edges.join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")

    start = spark.createDataFrame([(1,)], "node long")
    for depth, clipped in ((1, True), (2, True), (3, False), (0, True)):
        kept, cut = graph.frontier_bounded(back, start, depth, 10)
        assert rows(kept, "node", "depth") == [(n, n - 1) for n in range(1, 5) if n - 1 <= depth] and cut.first().clipped == clipped
        assert rows(kept, "node", "depth") == rows(graph.frontier_bounded(edges, start, depth, 10)[0], "node", "depth")
        assert graph.frontier_bounded(edges, start, depth, 10)[1].first().clipped == clipped


def test_routes_are_tested_once(spark):
    """Calls and endpoints that share routes: pairs, classes and callers in full, though each pair of routes meets once and only if its literals agree."""
    calls = spark.createDataFrame([(n, n % 2, "GET", f"/en/{n % 3}" if n < 60 else "/en/:x/z", "fetch", n % 5, n) for n in range(70)], "id long, repo_id long, http_method string, url_pattern string, client_type string, caller_function_id long, line_number long")
    endpoints = spark.createDataFrame([(n, 2 + n % 2, "GET" if n % 3 else "POST", ["/en/:id", "/en/2", "/en/q/:k", "/fr/:id", "/en/1/:a"][n % 5]) for n in range(50)], "id long, repo_id long, method string, path string")
    left, right, pairs = routes.audit_sides(routes.audit_calls(calls), endpoints)
    found = {("/".join(r.c_segs), "/".join(r.e_segs)) for r in pairs.collect()}
    # the rest of a longer side may be parameters alone
    assert found == {("en/0", "en/:id"), ("en/1", "en/:id"), ("en/2", "en/:id"), ("en/2", "en/2"), ("en/1", "en/1/:a"), ("en/:x/z", "en/q/:k"), ("en/:x/z", "en/1/:a")}
    assert routes.audit_matches(routes.audit_calls(calls), endpoints).count() == 60 * 10 + 20 * 10 + 20 * 10 + 10 * 20
    doubled = calls.unionByName(calls)
    assert routes.audit_matches(routes.audit_calls(doubled), endpoints).count() == 2 * 1200
    consumers = verify.endpoint_consumers(endpoints, calls, 3)
    assert consumers.filter("endpoint_id = 5").select("c_repo", "caller_function_id", "line", "clipped").collect() == consumers.filter("endpoint_id = 25").select("c_repo", "caller_function_id", "line", "clipped").collect()
    assert {r.endpoint_id for r in consumers.collect()} == {n for n in range(50) if n % 5 != 3 and n % 3}
    gates = spark.createDataFrame([(1, "GET", "/gw/*", "/en"), (2, "GET", "/gw/en/*", "/en"), (3, "GET", "/gw/en/*", "/en"), (3, "REQUEST", "/gw/en/*", "/en")], "id long, method string, path string, backend_path string")
    through = calls.filter("id = 2").withColumn("url_pattern", F.lit("/gw/en/2"))
    two = [n for n in range(50) if n % 5 == 1 and n % 3]
    assert rows(routes.gateway_calls(through, gates, endpoints), "call_id", "route_id", "endpoint_id") == sorted((2, g, n) for g in (2, 3) for n in two)


def test_pairs_of_one_route_are_listed_by_many_tasks(spark):
    """Sides are small and their pairs many: tasks aren't as few as the sides' size asks for, and rows are whole."""
    calls = spark.range(400).selectExpr("id", "id % 3 AS repo_id", "'GET' AS http_method", "concat('/en/', id % 200) AS url_pattern", "'fetch' AS client_type").repartition(4, "repo_id")
    endpoints = spark.range(300).selectExpr("id", "id % 5 AS repo_id", "'GET' AS method", "CASE WHEN id < 290 THEN '/en/:id' ELSE '/en/7' END AS path").repartition(4, "repo_id")
    found = routes.audit_matches(routes.audit_calls(calls), endpoints).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in found) == 400 * 290 + 2 * 10
    assert len(found) > 1 and max(r["count"] for r in found) < 400 * 290 * 0.8


def test_gateway_rows_of_one_route_are_listed_by_many_tasks(spark):
    through = spark.range(300).selectExpr("id", "'GET' AS http_method", "'/gw/en/x' AS url_pattern").repartition(4)
    gates = spark.range(40).selectExpr("id", "'GET' AS method", "'/gw/en/*' AS path", "'/en' AS backend_path").repartition(4)
    endpoints = spark.range(50).selectExpr("id", "'GET' AS method", "'/en/x' AS path").repartition(4)
    found = routes.gateway_calls(through, gates, endpoints)
    assert found.distinct().count() == 300 * 40 * 50
    tasks = [r["count"] for r in found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(tasks) == 300 * 40 * 50 and len(tasks) > 1 and max(tasks) < 300 * 40 * 50 * 0.8


def test_gateway_rows_are_not_shuffled(spark):
    """What is shuffled grows with the tables, not with the pairs or rows that they give."""
    through = spark.range(300).selectExpr("id", "'GET' AS http_method", "'/gw/en/x' AS url_pattern")
    gates = spark.range(5).selectExpr("id", "'GET' AS method", "'/gw/en/*' AS path", "'/en' AS backend_path")
    endpoints = spark.range(300).selectExpr("id", "'GET' AS method", "'/en/x' AS path")
    found = routes.gateway_calls(through, gates, endpoints)
    assert len(set(found.collect())) == 300 * 5 * 300

    def shuffled(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return shuffled(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return shuffled(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))

    assert 600 < shuffled(found._jdf.queryExecution().executedPlan()) < 10_000


def test_gateway_bases_and_repeated_ids(spark):
    """A base may end at any slash of a route; ids may have several rows, and one may be null: each row is given once."""
    asked = [(1, "GET", "/gw/en/12"), (1, "GET", "/gw/en/12"), (1, "GET", "/gw/en/13"), (2, "POST", "/gw/en/12"), (3, "ANY", "/gw/en"), (None, "GET", "/gw/en/12"), (4, "GET", None), (5, "GET", "/gw/english/12")]
    gates = [(1, "REQUEST", "/*", ""), (2, "REQUEST", "/gw/*", "/b"), (3, "GET", "/gw/en/*", "/en"), (3, "GET", "/gw/*", ""), (4, "GET", "/gw/en", "/en"), (None, "GET", "/gw/en/12/*", "/en/12"), (5, "GET", None, "/en"), (6, "GET", "/gw/en/*", None)]
    stored = [(1, "GET", "/en/12"), (1, "GET", "/en/13"), (2, "REQUEST", "/en/12"), (3, "POST", "/b/en/12"), (4, "GET", "/gw/en/12"), (None, "GET", "/en/12"), (5, "GET", "/en"), (6, "GET", None), (7, "GET", "/english/12")]
    meet = lambda c, e: c == e or e == "REQUEST" or c in ("REQUEST", "ANY")
    expected = {
        (c, g, e)
        for c, cm, route in asked for g, gm, path, backend in gates for e, em, own in stored
        if route and path and backend is not None and own
        for base in [path.removesuffix("/*")]
        if (route == base or route.startswith(base + "/")) and meet(cm, gm) and own == backend + route[len(base) :] and meet(cm, em)
    }
    found = routes.gateway_calls(
        spark.createDataFrame(asked, "id long, http_method string, url_pattern string"), spark.createDataFrame(gates, "id long, method string, path string, backend_path string"), spark.createDataFrame(stored, "id long, method string, path string")
    )
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted((tuple(r) for r in found.select("call_id", "route_id", "endpoint_id").collect()), key=key) == sorted(expected, key=key)
    assert {(1, 1, 4), (1, 3, 1), (None, None, None)} <= expected


def test_closures_have_no_depth(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long").coalesce(1)
    start = spark.createDataFrame([(0,)], "node long").coalesce(1)
    # the most depth of traces, which binds nothing else, made small for a short chain
    monkeypatch.setattr(graph, "MOST_DEPTH", 3)
    assert graph.bfs(links, start, 100).agg(F.max("depth")).first()[0] == 3
    assert rows(graph.parents(links, start), "node", "depth") == [(i, i) for i in range(6)]
    named = links.select(F.concat(F.lit("T"), "dst").alias("child"), F.concat(F.lit("T"), "src").alias("parent"))
    assert types.implementations(named, "T0").count() == 5
    # the newest generation is kept and needs all others
    held = spark.createDataFrame([(i, 1, "r", 6 - i, None, i + 1 if i < 5 else None) for i in range(6)], "id long, workspace_id long, repo_name string, generation int, finished_at timestamp, depends_on long")
    assert snapshots.prunable(held.coalesce(1), 1).count() == 0


def test_affected_snapshots_far_away(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)], "snapshot long, target long").coalesce(1)
    assert rows(graph.affected_snapshots(spark.createDataFrame([(0,)], "snapshot long").coalesce(1), links), "snapshot") == [(i,) for i in range(41)]


def test_verdict_lattice(spark):
    facts = [(1, True, 1, False, "confirmed", False, "fail"), (2, True, 0, False, "confirmed", False, "warn"), (3, False, 0, True, "confirmed", False, "warn"), (4, False, 2, False, "confirmed", False, "info"), (5, False, 0, False, "missing", False, "fail"), (6, False, 0, False, "missing", True, "info"), (7, False, 0, False, "confirmed", False, "pass")]
    held = verify.verdict(spark.createDataFrame([x[:6] for x in facts], "change int, breaking boolean, consumers int, incomplete boolean, obligation string, waived boolean"))
    assert {r.change: r.verdict for r in held.collect()} == {x[0]: x[6] for x in facts}
    assert verify.overall(held).first().verdict == "fail" and verify.overall(held.limit(0)).first().verdict == "pass"


def test_breaking_changes(spark):
    diff = "--- a/X.java\n+++ b/X.java\n@@ -1,3 +1,2 @@\n-public Order get(String id, int n) {\n-void gone(int a) {\n-void same(int a) {\n+public Order get(long id) {\n+void same(int a) {\n"
    found = verify.breaking_changes(inputs.diff_table(spark.createDataFrame([(diff,), (None,)], "diff string")))
    assert rows(found, "function", "change", "detail") == [("get", "parameter_removed", "n"), ("get", "parameter_type_changed", "id"), ("gone", "endpoint_removed", "")]


def test_changed_functions(spark):
    functions = spark.createDataFrame([(1, "r:f:a", "r", "f", 10, 20), (2, "r:f:b", "r", "f", 30, 40)], "id long, caller_id string, repo_name string, file_path string, start_line int, end_line int")
    ranges = spark.createDataFrame([("r", "f", 15, 16), ("r", "f", 22, 25)], "repo_name string, file_path string, low int, high int")
    met, gaps = verify.changed_functions(ranges, functions)
    assert rows(met, "id") == [(1,)] and rows(gaps, "low") == [(22,)]


def test_injection_gives_up_on_ambiguity(spark):
    parents = spark.createDataFrame([("A", "I", "implements"), ("B", "I", "implements")], "child string, parent string, kind string")
    beans = spark.createDataFrame([("A", False), ("B", False)], "name string, is_primary boolean")
    fields = spark.createDataFrame([(1, "x", "I<String>", None), (2, "b", "I", None), (3, "x", "I", "A")], "id long, name string, type_name string, qualifier string")
    assert rows(types.injected(fields, beans, parents), "id", "bean", "tier") == [(2, "B", 2), (3, "A", 1)]


def test_score_weights(spark):
    score = lambda q, n, **k: spark.range(1).select(search.keyword_score(q, F.lit(n), F.lit(k.get("repo", "r")), F.lit(k.get("path", "p")), F.lit(k.get("source", "")), F.lit(k.get("rich", 0)), F.lit(k.get("fan", 0)), F.lit(False), F.lit(k.get("handler", False))).alias("s")).first().s
    assert score("charge", "PayService.charge") == 60 + 35 + 55 + 15 + 20
    assert score("order save", "OrderDao.save", source="x") == 30 + 30 + 50 + 55 + 15 - 25
    assert score("charge", "x", fan=40, rich=400, handler=True) == 25 + 25 + 150


def test_sinks(spark, tmp_path):
    facts = spark.createDataFrame([(1, 1), (2, 2)], "id long, snapshot_id long")
    path = str(tmp_path / "facts")
    tables.write_snapshot(facts, path)
    tables.write_snapshot(spark.createDataFrame([(9, 2)], "id long, snapshot_id long"), path)
    assert rows(spark.read.parquet(path), "id", "snapshot_id") == [(1, 1), (9, 2)]
    tables.append_log(facts, str(tmp_path / "log"))
    tables.append_log(facts, str(tmp_path / "log"))
    assert tables.newest(spark.read.parquet(str(tmp_path / "log")), "id", 3).count() == 3
    report = tables.markdown("Impact", {"Functions": facts})
    assert "# Impact" in report and "| 1 | 1 |" in report
    one = facts.agg(F.count("*").alias("n"))
    assert tables.gates(one, {"n": ("max", 1)}) and not tables.gates(one, {"n": ("max", 2)}) and tables.gates(one, {"missing": ("max", 1)})
    assert os.path.isdir(path)


def test_prune_keeps_dependencies(spark):
    held = spark.createDataFrame([(1, "r", 1, 1, None), (2, "r", 1, 2, None), (3, "r", 1, 3, 1)], "id long, repo_name string, workspace_id long, generation long, depends_on long").withColumn("finished_at", F.lit(None).cast("timestamp"))
    assert rows(snapshots.prunable(held, 1), "id") == [(2,)]


def test_scope_modes(spark):
    rows_ = spark.createDataFrame([(1, 1), (2, None)], "id long, snapshot_id long")
    count = lambda *a: rows_.filter(scope.in_scope(F.col("snapshot_id"), *a)).count()
    assert [count(None), count([1]), count([1], True), count([]), count([], True)] == [2, 1, 2, 0, 1]


def test_entity_threshold(spark):
    held = spark.createDataFrame([("A", "write"), ("B", "read"), ("C", "read"), ("C", "read"), ("C", "read")], "entity_name string, access string")
    assert rows(impact.entity_scores(held), "entity") == [("a",), ("c",)]


def test_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events*.parquet")
    query = events.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("hours"), "event_type", "hour", "n") == rows(events.hourly(source), "event_type", "hour", "n")
    assert events.sessions(source).agg(F.sum("n")).first()[0] == source.count()


@pytest.mark.parametrize("policy, expected", [("leaf", 0), ("full", 2), ("smart", 1)])
def test_expand_policies(spark, policy, expected):
    nodes = spark.createDataFrame([("a", "r"), ("b", "q")], "node string, repo string")
    calls = spark.createDataFrame([("a", 3)], "node string, calls int")
    assert graph.expandable(nodes, calls, policy, "r", 5).count() == expected


def test_inheritance_is_scoped_and_has_no_depth(spark):
    """A base is the nearest declaration of its name; chains, enclosing types and cycles are walked to the end."""
    types_of = [(k, 1, k, "p", f"T{k}") for k in range(20)] + [(100, 1, 100, "q", "T1"), (101, 1, 101, "q", "User"), (102, 1, 102, "q", "User.In"), (103, 1, 102, "q", "User"), (104, 2, 104, "q", "T1")]
    bases = [(k, f"T{k + 1}<A<B>>") for k in range(19)] + [(19, "T0"), (101, "T1"), (103, "p.T2")]
    imports = [(102, "p.T9", False), (101, "p", True)]
    own = spark.createDataFrame(types_of, "id long, repo_id long, file_id long, package string, name string")
    based = spark.createDataFrame(bases, "type_id long, base string")
    imported = spark.createDataFrame(imports, "file_id long, path string, wildcard boolean")
    held = {r.type_id: (r.base_id, r["rank"]) for r in types.resolve_bases(own, based, imported).collect()}
    assert held == {k: (k + 1, 3) for k in range(19)} | {19: (0, 3), 101: (100, 3), 103: (2, 4)}
    calls = spark.createDataFrame([(1, 0, "far"), (2, 102, "far"), (3, 101, "far"), (4, 5, "none")], "id long, type_id long, method string")
    methods = spark.createDataFrame([(77, 19, "far")], "id long, type_id long, method string")
    assert rows(types.inherited(calls, own, based, imported, methods), "id", "target", "distance") == [(1, 77, 19), (2, 77, 19)]


def test_patterns_meet_on_any_literal(spark):
    """Parameters first, parameters alone, one segment, beginnings, and endpoints beyond the most that a call may have."""
    stored = ["/:t/orders", "/{a}/{b}", "/ab", "/a/:x/end", "/:t/:u/deep/:v", "/"]
    endpoints = spark.createDataFrame([(k, "GET", p) for k, p in enumerate(stored)] + [(100 + k, "GET", "/many/:id") for k in range(70)], "id long, method string, path string")
    asked = ["/x/orders", "/abc/z", "/a/1/end", "/p/q/deep/r", "/many/5", "/"]
    calls = spark.createDataFrame([(k, "GET", p) for k, p in enumerate(asked)], "id long, http_method string, url_pattern string")
    held = {}
    for r in routes.trace_cascade(calls, endpoints).collect():
        held.setdefault(r.call_id, []).append(r.endpoint_id)
    found = {k: sorted(v) for k, v in held.items()}
    assert found[0] == [0, 1] and found[1] == [1, 2] and found[2] == [1, 3] and found[3] == [1, 4] and found[5] == [5]
    assert found[4] == [1, *range(100, 149)]


def test_changes_reach_by_name(spark):
    changed = spark.createDataFrame([(1,)], "snapshot long")
    references = spark.createDataFrame([(3, 2)], "snapshot long, target long")
    declared = spark.createDataFrame([(1, "pay"), (9, "other")], "snapshot long, name string")
    pending = spark.createDataFrame([(2, "pay"), (4, "other")], "snapshot long, name string")
    assert rows(graph.affected_snapshots(changed, references, declared, pending), "snapshot") == [(1,), (2,), (3,)]


def test_walks_over_functions_of_a_frontier(spark):
    """A walk may ask for the edges of each level, and merges what it visited now and then."""
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long").coalesce(1)
    def near(frontier):
        asked.append(frontier.count())
        return links.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")

    found = graph.bfs(near, spark.createDataFrame([(0,)], "node long"), 18)
    assert rows(found, "node", "depth") == [(i, i) for i in range(19)] and asked == [1] * 18


def test_boundary_edges_of_a_frontier(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    accesses = [(k, k % 3, "E", "write" if k < 3 else "read", k) for k in range(40)]
    facts = (
        spark.createDataFrame([(1, 2), (5, 6)], "src long, dst long"), none("id long, caller_function_id long, http_method string, url_pattern string"), none("id long, handler_function_id long, method string, path string"),
        none("queue_name string, caller_function_id long"), none("id long, queue_name string, handler_function_id long"), none("alias_key string, alias_value string"),
        spark.createDataFrame(accesses, "id long, repo_id long, entity_name string, access string, caller_function_id long"),
    )
    every = rows(flow.boundary_edges(*facts), "src", "dst", "via")
    readers = {w: [r for r in range(3, 40) if r % 3 != w][:10] for w in range(3)}
    assert every == sorted([(1, 2, "call"), (5, 6, "call")] + [(w, r, "data") for w in range(3) for r in readers[w]])
    near = rows(flow.boundary_edges(*facts, spark.createDataFrame([(1,)], "node long")), "src", "dst", "via")
    assert near == [x for x in every if x[0] == 1]


def chain_of_snapshots(spark):
    """Eleven generations of one repository, finished on successive days, each but the first depending on nothing; the newest needs 4, which needs 2."""
    held = [(i, "r", 1, i, f"2024-01-{i:02d}", {11: 4, 4: 2}.get(i)) for i in range(1, 12)]
    return spark.createDataFrame(held, "id long, repo_name string, workspace_id long, generation long, finished_at string, depends_on long").withColumn("finished_at", F.to_timestamp("finished_at"))


def test_prune_lists_and_protects(spark):
    held = chain_of_snapshots(spark)
    selected, facts = spark.createDataFrame([(6,)], "id long"), spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, snapshot_id long")
    gone = snapshots.prune(held, selected, 2, F.to_timestamp(F.lit("2024-01-09")))
    assert rows(gone, "id") == [(1,), (3,), (5,), (7,), (8,)]
    assert rows(snapshots.pruned(facts, gone), "id") == [(2,), (3,)]


def test_prune_refuses(spark):
    held, none = chain_of_snapshots(spark), spark.createDataFrame([], "id long")
    before = F.to_timestamp(F.lit("2024-01-09"))
    with pytest.raises(snapshots.Busy):
        snapshots.prune(held, none, 1, before, spark.createDataFrame([(1,)], "workspace_id long"))
    assert snapshots.prune(held, none, 1, before, spark.createDataFrame([(2,)], "workspace_id long")).count() == 6
    with pytest.raises(ValueError):
        snapshots.prune(held, none, 0, before)


def test_queue_integrations(spark):
    producers = spark.createDataFrame([(1, "%Jobs%", 3), (1, "URL_KEY", 4), (2, "lost", None), (3, None, 1)], "caller_function_id long, queue_name string, line_number int")
    consumers = spark.createDataFrame([(7, 70, "jobs"), (8, 80, "target")], "repo_id long, handler_function_id long, queue_name string")
    aliases = spark.createDataFrame([("URL_KEY", "shared"), ("target", "shared"), ("", "jobs")], "alias_key string, alias_value string")
    found = integrations.queues(producers, consumers, aliases)
    assert rows(found, "caller_function_id", "line", "target_function_id", "resolution") == [(1, 3, 70, "matched"), (1, 4, 80, "matched"), (2, 0, None, "unresolved"), (3, 1, None, "unresolved")]


def test_class_methods(spark):
    classes = spark.createDataFrame([(1, 9, "A", 1, 50), (2, 9, "A.B", 5, 20)], "id long, file_id long, name string, start_line int, end_line int")
    functions = spark.createDataFrame([(1, 9, "A.run", 2, 4), (2, 9, "A.B.go", 6, 8), (3, 9, "A.far", 49, 51), (4, 8, "A.run", 2, 4), (5, 9, "plain", 2, 3)], "id long, file_id long, name string, start_line int, end_line int")
    assert rows(integrations.methods_of(classes, functions), "class_id", "function_id") == [(1, 1), (1, 2), (2, 2)]
