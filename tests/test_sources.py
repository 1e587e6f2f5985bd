import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.sources import code, configured, inputs

JS = """import axios from 'axios';
class Orders extends Base implements Store {
  async load(id) {
    const r = await axios.get(`/api/orders/${id}`);
    return this.parse(r); // this.ignored(1)
  }
  parse(r) { return JSON.parse(r); }
}
export const send = async (x) => { await sqs.sendMessage({ QueueUrl: process.env.ORDER_QUEUE }); };
router.post('/orders/:id', auth, send);
"""
JAVA = """package a.b;
import a.c.Base;
@RestController
@RequestMapping("/v1")
public class OrderController extends Base<String> implements Api, Other {
  @Autowired @Qualifier("fast") private OrderRepo repo;
  @GetMapping("/orders/{id}")
  public Order get(@PathVariable String id, int n) {
    return repo.find(id);
  }
  @SqsListener("orders")
  void take(String m) { repo.save(m); }
}
@Entity @Table(name = "ORD")
class Order { }
"""
CS = """[Route("api/[controller]")]
public class ItemsController : ControllerBase, IItems {
  [HttpGet("{id}")]
  public async Task<Item> Get(int id) { return await _context.Items.FindAsync(id); }
  [HttpPost]
  public void Put(Item x) { _context.Items.Add(x); }
}
"""
GO = """package a
type Server struct{}
func (s *Server) Run(n int) { s.help(); http.Get("http://x/y") }
func main() { mux.HandleFunc("GET /ping", ping) }
"""
SQL = """-- update ghost set a = 1
CREATE PROCEDURE p1 AS BEGIN WITH c AS (SELECT * FROM src) INSERT INTO dst SELECT 'from fake' FROM c JOIN other o ON 1 = 1; EXEC p2; END
CREATE FUNCTION f2() AS BEGIN DELETE FROM dst; END
"""
RPG = """**free
dcl-f INVHDR disk;
dcl-proc post export;
  chain key INVHDR;
  total = tax(amount);
  exec sql update ledger set a = 1;
end-proc;
"""


def kinds(text, path):
    return {(k, n, o, t, v) for k, n, o, t, v, _ in code.PARSERS[path][1](text)}


def test_javascript():
    found = kinds(JS, ".ts")
    assert ("function", "Orders.load", "Orders", "", "") in found
    assert ("http_call", "GET", "Orders.load", "/api/orders/:id", "axios") in found
    assert ("extends", "Orders", "", "Base", "") in found and ("implements", "Orders", "", "Store", "") in found
    assert ("endpoint", "POST", "", "/orders/:id", "send") in found
    assert ("queue_producer", "ORDER_QUEUE", "send", "", "") in found
    assert ("call", "this.parse", "Orders.load", "this.parse", "") in found
    assert not any(n == "this.ignored" for _, n, *_ in found)


def test_vue_lines():
    lines = [x[5] for x in code.PARSERS[".vue"][1]("<template/>\n<script>\nfunction a() {}\n</script>\n") if x[0] == "function"]
    assert lines == [3]


def test_java():
    found = kinds(JAVA, ".java")
    assert ("endpoint", "GET", "OrderController.get", "/v1/orders/{id}", "OrderController.get") in found
    assert ("queue_consumer", "orders", "OrderController.take", "", "") in found
    assert ("field", "repo", "OrderController", "OrderRepo", "fast") in found
    assert ("extends", "OrderController", "", "Base<String>", "") in found and ("implements", "OrderController", "", "Other", "") in found
    assert ("entity", "Order", "", "ORD", "") in found
    assert ("call", "repo.find", "OrderController.get", "repo.find", "") in found


def test_csharp():
    found = kinds(CS, ".cs")
    assert ("endpoint", "GET", "ItemsController.Get", "/api/items/{id}", "ItemsController.Get") in found
    assert ("data_access", "Items", "ItemsController.Get", "", "read") in found and ("data_access", "Items", "ItemsController.Put", "", "write") in found
    assert ("implements", "ItemsController", "", "IItems", "") in found


def test_go():
    found = kinds(GO, ".go")
    assert ("function", "Server.Run", "Server", "", "") in found and ("endpoint", "GET", "", "/ping", "ping") in found
    assert ("http_call", "GET", "Server.Run", "http://x/y", "http") in found


def test_sql():
    found = {x[:5] for x in code.PARSERS[".sql"][1](SQL) if x[0] != "function"}
    assert ("data_access", "src", "p1", "", "read") in found and ("data_access", "dst", "p1", "", "write") in found
    assert ("data_access", "other", "p1", "", "read") in found and ("data_access", "dst", "f2", "", "write") in found
    assert ("call", "p2", "p1", "p2", "") in found
    assert not any(n in ("ghost", "fake", "c") for _, n, *_ in found)


def test_ibmi():
    found = kinds(RPG, ".rpgle")
    assert ("export", "post", "", "", "") in found and ("data_access", "invhdr", "post", "", "read") in found
    assert ("data_access", "ledger", "post", "", "write") in found and ("call", "tax", "post", "tax", "") in found
    assert ("call", "inv200", "pgm", "inv200", "lib") in kinds("PGM\nCALL PGM(LIB/INV200)\nENDPGM", ".clle")
    assert ("field", "custno", "invr", "", "A") in kinds("     A          R INVR\n     A            CUSTNO         5A", ".pf")
    assert ("export", "post", "", "", "") in kinds('STRPGMEXP\nEXPORT SYMBOL("POST")', ".bnd")


def test_other_languages():
    assert ("http_call", "POST", "Send-It", "https://h/x", "powershell") in kinds("function Send-It {\n Invoke-RestMethod -Uri 'https://h/x' -Method Post\n}", ".ps1")
    assert ("schedule", "nightly", "", "", "rate(1 day)") in kinds('resource "aws_cloudwatch_event_rule" "r" {\n name = "nightly"\n schedule_expression = "rate(1 day)"\n}', ".tf")
    assert ("graphql_operation", "Orders", "", "", "query") in kinds("query Orders { a }\n# mutation Not", ".graphql")
    assert kinds("A=1\n#B=2\nexport C_D='x'", ".env") == {("alias", "A", "", "", "1"), ("alias", "C_D", "", "", "x")}
    assert ("trigger", "GET", "", "r/{id}", "http") in kinds(json.dumps({"bindings": [{"type": "httpTrigger", "methods": ["get"], "route": "r/{id}"}]}), ".json")
    assert ("route_prefix", "api2", "", "", "") in kinds('{"extensions": {"http": {"routePrefix": "api2"}}}', ".json")
    assert kinds("{broken", ".json") == set() and kinds("<a>", ".xml") == set()
    assert ("data_access", "orders", "m.find", "", "read") in kinds('<mapper namespace="m"><select id="find">select * from orders</select></mapper>', ".xml")


def test_parse_files(spark):
    rows = spark.createDataFrame([("r", "a.go", GO), ("r", "b.unknown", "x"), ("r", "c.go", None)], "repo string, path string, text string")
    found = code.parse_files(rows)
    assert {x.path for x in found.collect()} == {"a.go"}
    assert code.parse_files(rows.limit(0)).count() == 0


def test_discover(spark, tmp_path):
    for p in ("shop/src/a.go", "shop/node_modules/x.go", "pay/b.sql"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(GO if p.endswith("go") else SQL)
    assert sorted((x.repo, x.path) for x in code.discover(spark, str(tmp_path)).collect()) == [("pay", "b.sql"), ("shop", "src/a.go")]


DIFF = """diff --git a/x.java b/x.java
--- a/x.java
+++ b/x.java
@@ -10,3 +10,3 @@ class X
 keep
-old
+new
 keep
diff --git a/y.java b/y.java
deleted file mode 100644
--- a/y.java
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/n.txt b/n.txt
new file mode 100644
--- /dev/null
+++ b/n.txt
@@ -0,0 +1 @@
+x
diff --git a/i.png b/i.png
Binary files a/i.png and b/i.png differ
"""


def test_diff(spark):
    rows = {(r.path, r.low, r.high, r.is_new, r.is_deleted, r.is_binary) for r in inputs.diff_ranges(spark, DIFF).collect()}
    assert rows == {("x.java", 11, 11, False, False, False), ("y.java", 1, 2, False, True, False), ("n.txt", 1, 1, True, False, False), ("i.png", None, None, False, False, True)}
    for broken in ("--- a/x\n+++ b/x\n@@ -1,3 +1 @@\n-a\n", "@@ -1 +1 @@\n-a\n+b\n", "--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n-a\n*b\n"):
        with pytest.raises(inputs.DiffError):
            inputs.parse_diff(broken)


def test_owners(spark):
    text = "* @all\n/src/ @src # note\n*.sql @db\ndocs/*.md @docs\n/src/gen/**\n"
    files = spark.createDataFrame([(p,) for p in ("a.txt", "src/x.c", "src/q/x.sql", "docs/a.md", "docs/b/a.md", "src/gen/a/b.c")], "path string")
    found = {r.path: r.owners for r in inputs.owners(files, text).collect()}
    assert found == {"a.txt": ["@all"], "src/x.c": ["@src"], "src/q/x.sql": ["@db"], "docs/a.md": ["@docs"], "docs/b/a.md": ["@all"], "src/gen/a/b.c": []}


def test_config():
    held = inputs.load_config("profile: deep\nhttp: {prefixes: [/a], x: 1}\nrepos: {r: {http: {prefixes: [/b]}}}")
    assert inputs.effective(held, "r")["http"] == {"prefixes": ["/b"], "x": 1} and inputs.effective(held, "q")["http"]["prefixes"] == ["/a"]
    with pytest.raises(ValueError):
        inputs.load_config("profile: odd")


def test_schedules(spark, tmp_path):
    row = {"ruleName": "a", "scheduleExpression": "rate(1 day)", "targetType": "sqs", "targetName": "q", "state": "ENABLED", "source": "eventbridge"}
    good, extra, twice = (tmp_path / n for n in ("good.json", "extra.json", "twice.json"))
    good.write_text(json.dumps([row]))
    extra.write_text(json.dumps([row | {"odd": 1}]))
    twice.write_text(json.dumps([row, row]))
    held = inputs.read_schedules(spark, str(good))
    assert held.count() == 1
    for bad in (extra, twice):
        with pytest.raises(ValueError):
            inputs.read_schedules(spark, str(bad))
    changed = held.withColumn("state", F.lit("DISABLED"))
    other = held.withColumn("targetName", F.lit("z"))
    assert sorted(r.state for r in inputs.upsert_schedules(held.unionByName(other), changed).collect()) == ["DISABLED", "ENABLED"]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(C.normalize_route(F.lit("https://h.x/a//b/?q=1"))) == "/a/b"
    assert one(C.normalize_route(F.lit("{base}/orders"))) == "/orders"
    assert one(C.normalize_route(F.lit(""))) == "" and one(C.normalize_audit_route(F.lit(""))) == "/"
    assert one(C.normalize_queue(F.lit("https://sqs.x/1/jobs.fifo"))) == "jobs.fifo"
    assert one(C.audit_queue(F.lit("jobs.fifo"))) == "jobs.fifo" and one(C.audit_queue(F.lit("jobs.fifo"), True)) == "jobs"
    assert one(C.meaningful_segments(F.lit("/api/order-items/:id/list"))) == ["orderitems"]
    assert one(C.similarity(C.trigrams(F.lit("word")), C.trigrams(F.lit("words")))) == pytest.approx(4 / 7)
    assert one(C.noise_function(F.lit("A.getX"), F.lit("r"), F.lit("p"), F.lit("{\n return x;\n}"))) is True
    assert one(C.test_path(F.lit("src/a/FooTest.java"))) and not one(C.test_path(F.lit("src/a/Latest.java")))
    assert one(C.unresolved_reason(F.lit("System.Out.Write"))) == "stdlib_csharp" and one(C.unresolved_reason(F.lit("Math.abs"))) == "stdlib_js"
    assert one(C.unresolved_reason(F.lit("axios.get"))) == "framework" and one(C.unresolved_reason(F.lit("a[0].b"))) == "dynamic_receiver"
    assert C.search_terms("where is the Order job") == ["order", "job"] and C.search_terms("A.b") == ["A.b"]


def test_files_that_parsers_cannot_take(spark, monkeypatch):
    """Valid JSON of another shape gives what it holds; a parser that fails gives a fact, and other files go on."""
    assert code.settings('{"extensions": [".ts"]}') == [] or all(x[0] == "alias" for x in code.settings('{"extensions": [".ts"]}'))
    assert code.settings('{"bindings": ["x", {"type": "httpTrigger", "route": "r"}]}') == [("trigger", "REQUEST", "", "r", "http", 1)]
    assert code.settings('{"paths": {"/a": []}}') == [] and code.settings("[1]") == [] and code.settings("{") == []
    files = spark.createDataFrame([("r", "a.sql", "CREATE PROCEDURE p AS SELECT 1"), ("r", "b.xml", "<a><b></a>"), ("r", "c.json", None)], "repo string, path string, text string")
    assert [(r.path, r.kind) for r in code.parse_files(files).collect()] == [("a.sql", "function")]


def test_configured_extraction():
    queues = {"javascript_queues": {"load_receivers": ["mc"], "send_methods": ["put"], "read_methods": ["take"]}}
    text = "other.put(1);\nmc.load('a').put(1);\nconst x = await mc.load(`b`);\nx.take();\nmc.put(2);\n// x.take()\n"
    assert [(f[0], f[1], f[5]) for f in configured.found("javascript", text, queues)] == [("queue_producer", "a", 2), ("queue_consumer", "b", 4), ("queue_producer", "b", 5)]
    both = [{"name": n, "language": "java", "contains": ["rc."], "methods": {"go": v, "only": "GET"}} for n, v in (("p", "GET"), ("q", "POST"))]
    held = configured.found("java", 'class A { void f() { rc.go("/a"); rc.only("/b"); other.only("/c"); rc.odd("/d"); } }', {"http_clients": both})
    assert [(f[1], f[3]) for f in held] == [("GET", "/b")]
    assert configured.found("typescript", "r.load('src/resolvers')", {"graphql_registrations": [{"receiver": "r", "method": "load"}]})[0][3] == "src/resolvers"
    assert configured.found("go", text, queues) == [] and configured.found("javascript", text, {}) == []


@pytest.mark.parametrize("odd", [{"odd": 1}, {"http_clients": [{"language": "go"}]}, {"http_clients": [{"language": "java", "methods": {"a": "FETCH"}}]}])
def test_configured_extraction_refuses(odd):
    with pytest.raises(ValueError):
        configured.checked(odd)
