"""Queries of patch semantics, rule cases and reports over stated cases with their expected answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import rules, semantics
from riskloom.plans.registry import query, values
from riskloom.plans.registry import table as _t
from riskloom.sources import reports

c = F.col


def patch(added, removed=(), path="src/Svc.cs") -> str:
    body = "".join(f"-{x}\n" for x in removed) + "".join(f"+{x}\n" for x in added)
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,9 +1,9 @@\n{body}"


#: rule, check, lines added and removed that must fire it, lines added and removed that must not, path.
CASES = [
    ("GCI0010", "ip literal", ['var u = "10.1.2.3";'], [], ['var version = "1.2.3.4";'], [], "src/Svc.cs"),
    ("GCI0010", "known port", ['var u = "http://h:5432/x";'], [], ['var n = 54321;'], [], "src/Svc.cs"),
    ("GCI0010", "identity authority host", ['var a = "https://login.microsoftonline.com/x";'], [], ['var a = "https://login.example.com/x";'], [], "src/Svc.cs"),
    ("GCI0012", "sql built by concatenation", ['var q = "SELECT * FROM t WHERE a=" + a;'], [], ['var q = "SELECT * FROM t";'], [], "src/Svc.cs"),
    ("GCI0012", "weak hash", ["var h = MD5.Create();"], [], ["var h = SHA256.Create();"], [], "src/Svc.cs"),
    ("GCI0012", "hardcoded credential", ['string apiKey = "sk-live-1234";'], [], ['string apiKey = "GITHUB_TOKEN";'], [], "src/Svc.cs"),
    ("GCI0012", "anonymous access replaces authorisation", ["[AllowAnonymous]"], ["[Authorize]"], ["[AllowAnonymous]"], [], "src/Svc.cs"),
    ("GCI0016", "async void", ["public async void Run()"], [], ["private async void OnClick(object sender, EventArgs e)"], [], "src/Svc.cs"),
    ("GCI0016", "blocking call", ["var x = LoadAsync().Result;"], [], ["var x = await LoadAsync();"], [], "src/Svc.cs"),
    ("GCI0029", "personal data in a log call", ['_logger.Info("user token " + email );'], [], ['_logger.Info("user " + Hash(email) );'], [], "src/Svc.cs"),
    ("GCI0044", "query in a loop", ["foreach (var x in xs) {", "var y = ys.FirstOrDefault(z => z > x);"], [], ["foreach (var x in xs) {", "var y = ys.ToList();"], [], "src/Svc.cs"),
    ("GCI0020", "timeout removed", ["Run();"], ["Run(maxWait: 3);"], ["Run(delay);"], ["Run(maxWait: 3);"], "src/Svc.cs"),
    ("GCI0020", "cleanup removed", ["Run();"], ["x.Dispose();"], ["using (var y = x)"], ["x.Dispose();"], "src/Svc.cs"),
    ("GCI0020", "limit raised", ["int maxConnections = 1000;"], ["int maxConnections = 100;"], ["int maxConnections = 400;"], ["int maxConnections = 100;"], "src/Svc.cs"),
    ("GCI0048", "random near secrets", ["var passphrase = Make();", "var r = new Random();"], [], ["var session = Make();", "var r = new Random();"], [], "src/Svc.cs"),
    ("GCI0003", "signature changed", ["public int Load(string a, int b)"], ["public int Load(string a)"], ["public int Load(string a)"], ["public int Load(string a)"], "src/Svc.cs"),
    ("GCI0003", "signature extended", ["public int Load(string a, int b = 1)"], ["public int Load(string a)"], ["public int Load(string a, int b)"], ["public int Load(string a)"], "src/Svc.cs"),
    ("GCI0007", "swallowed exception", ["try { Run(); }", "catch (Exception ex)", "{", "}"], [], ["try { Run(); }", "catch (Exception ex)", "{", "Log.Error(ex);", "}"], [], "src/Svc.cs"),
    ("GCI0007", "throw replaced", ["return null;"], ["catch (Exception e) {", "throw e;"], ["Log(e);"], ["catch (Exception e) {", "throw e;"], "src/Svc.cs"),
    ("GCI0024", "resource not disposed", ['var s = new FileStream("a", m);', "s.Read();"], [], ['using var s = new FileStream("a", m);'], [], "src/Svc.cs"),
    ("GCI0032", "throws without assertion", ["throw new WidgetException();"], [], ["throw new ArgumentNullException();"], [], "src/Svc.cs"),
    ("GCI0006", "missing parameter validation", ["public void Save(string? name)", "Store(name);"], [], ["public void Save(string? name)", "ArgumentNullException.ThrowIfNull(name);"], [], "src/Svc.cs"),
    ("GCI0015", "unchecked cast near http input", ['var a = (int)Request.Form["x"];'], [], ["var a = (int)x;"], [], "src/Svc.cs"),
    ("GCI0022", "post without idempotency key", ["[HttpPost]", "public void Create()"], [], ["[HttpPost]", "public void Create(string idempotencyKey)"], [], "src/UserController.cs"),
    ("GCI0039", "call without cancellation token", ["await http.GetAsync(url);"], [], ["await http.GetAsync(url, cancellationToken);"], [], "src/Svc.cs"),
    ("GCI0041", "uninformative test name", ["[Fact]", "public void Test1()"], [], ["[Fact]", "public void Adds_two_numbers()"], [], "tests/SvcTests.cs"),
    ("GCI0047", "contradictory names", ["public void DeleteUser()"], ["public void GetUser()"], ["public void DeleteUser()"], ["public void GetOrder()"], "src/Svc.cs"),
    ("GCI0047", "boolean inversion", ["bool IsDisabled;"], ["bool IsEnabled;"], ["bool IsDisabled;", "bool IsEnabled;"], ["bool IsEnabled;"], "src/Svc.cs"),
    ("GCI0051", "small from large assignment", ["var count = items.Length"], [], ["var total = items.Length"], [], "src/Svc.cs"),
    ("GCI0050", "short text column", ["name nvarchar(50)"], [], ["name nvarchar(200)"], [], "src/Migrations/M1.cs"),
    ("GCI0057", "synchronous file access", ["var t = File.ReadAllText(p);"], [], ["// File.ReadAllText(p)"], [], "src/Svc.cs"),
]


_ASKED = [(2 * k + i, r, x, 1 - i) for k, (r, x, *_) in enumerate(CASES) for i in (0, 1)]


@query(f"SELECT s_suppkey, rule_id, check_name, CAST(fired AS BOOLEAN) AS fired FROM supplier JOIN {values(_ASKED, 'case_id, rule_id, check_name, fired')} ON case_id = s_suppkey % {len(_ASKED)}")
def rule_cases(spark, sf_dir):
    """Each supplier as the diff of a case that must fire its rule, or of one that must not, through the whole evaluation."""
    texts = [patch(*lines[2 * i : 2 * i + 2], path) for _, _, *lines, path in CASES for i in (0, 1)]
    case = (c("s_suppkey") % len(_ASKED) + 1).cast("int")
    of = lambda k: F.element_at(F.lit([x[k] for x in _ASKED]), case)
    asked = _t(spark, sf_dir, "supplier").select("s_suppkey", of(1).alias("rule_id"), of(2).alias("check_name"), F.concat(F.element_at(F.lit(texts), case), F.lit(" // "), "s_name").alias("raw_diff"))
    found = rules.evaluate(asked.select(c("s_suppkey").alias("diff_id"), "raw_diff")).select(c("diff_id").alias("s_suppkey"), "rule_id", c("check").alias("check_name")).distinct().withColumn("fired", F.lit(True))
    return asked.join(found, ["s_suppkey", "rule_id", "check_name"], "left").select("s_suppkey", "rule_id", "check_name", F.coalesce("fired", F.lit(False)).alias("fired"))


#: Items that a task cuts into lines, however many there are; few items still part into some tasks.
ITEMS_AT_ONCE, LEAST_ITEMS = 100_000, 5_000


def _items(spark, sf_dir):
    """Items dealt by order into as many tasks as their number asks for: sorts of lines hold what one task has."""
    items = _t(spark, sf_dir, "lineitem")
    n = items.count()
    return items.repartition(max(1, -(-n // ITEMS_AT_ONCE), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ITEMS))), "l_orderkey")


def _item_diffs(spark, sf_dir):
    """Each order as a diff of one file whose lines are its items: a condition by return flag, removed or added by status."""
    condition = F.when(c("l_returnflag") == "A", "!IsReady(x)").when(c("l_returnflag") == "N", "IsReady(x)").otherwise(F.concat(F.lit("Load(x) > "), c("l_quantity").cast("int").cast("string")))
    line = F.concat(F.when(c("l_linestatus") == "F", "-").otherwise("+"), F.lit("  if ("), condition, F.lit(")"))
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")))).alias("rows"))
    path = F.concat(F.when(c("l_orderkey") % 7 == 0, "tests/").otherwise("src/"), F.lit("Order"), c("l_orderkey").cast("string"), F.lit(".cs"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n@@ -1,9 +1,9 @@\n"))
    return items.select(c("l_orderkey").alias("diff_id"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("raw_diff"))


_ITEMS = """i AS (SELECT l_orderkey AS d, row_number() OVER w AS n, l_linestatus <> 'F' AS added, sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END) OVER w AS line, l_returnflag AS flag, CASE WHEN l_returnflag IN ('A', 'N') THEN 'IsReady' ELSE 'Load' END AS called,
  CASE l_returnflag WHEN 'A' THEN '!IsReady(x)' WHEN 'N' THEN 'IsReady(x)' ELSE 'Load(x) > ' || CAST(floor(l_quantity) AS INT) END AS condition,
  CASE WHEN l_orderkey % 7 = 0 THEN 'tests/' ELSE 'src/' END || 'Order' || l_orderkey || '.cs' AS file_path FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
p AS (SELECT a.d, a.n, min(r.n) AS m FROM i a JOIN i r ON a.d = r.d AND a.added AND NOT r.added AND a.called = r.called AND r.n BETWEEN a.n - 8 AND a.n + 3 GROUP BY 1, 2),
o AS (SELECT a.d AS diff_id, a.file_path, CAST(a.line AS INT) AS line, 'ConditionalModified' AS kind, a.condition, r.condition AS removed, CASE WHEN r.n IS NULL THEN 0.55 WHEN (a.flag = 'A') <> (r.flag = 'A') THEN 0.95 ELSE 0.75 END::DOUBLE AS risk
  FROM i a LEFT JOIN p ON p.d = a.d AND p.n = a.n LEFT JOIN i r ON r.d = p.d AND r.n = p.m WHERE a.added AND a.d % 7 <> 0)"""


def _item_operations(spark, sf_dir):
    return semantics.operations(rules.context(_item_diffs(spark, sf_dir), lexed=False))


@query(f"WITH {_ITEMS} SELECT * FROM o")
def patch_operations(spark, sf_dir):
    return _item_operations(spark, sf_dir)


@query(f"WITH {_ITEMS} SELECT diff_id, line, 'BoundaryValue' AS case_kind FROM o")
def counterfactuals(spark, sf_dir):
    return semantics.counterfactuals(_item_operations(spark, sf_dir)).select("diff_id", "line", "case_kind")


@query(f"WITH {_ITEMS} SELECT diff_id, line FROM o WHERE risk >= 0.9")
def risky_operations(spark, sf_dir):
    return semantics.select_operations(_item_operations(spark, sf_dir), "ConditionalModified", None, 0.9).select("diff_id", "line")


@query(f"WITH {_ITEMS} SELECT DISTINCT 'patch:' || d AS source, 'Contains' AS kind, 'file:' || file_path AS target FROM i UNION ALL SELECT DISTINCT 'op:' || diff_id || ':' || file_path || ':' || line, 'DerivedFrom', 'file:' || file_path FROM o")
def patch_graph(spark, sf_dir):
    return semantics.line_graph(rules.context(_item_diffs(spark, sf_dir), lexed=False))


@query(f"WITH {_ITEMS} SELECT DISTINCT 'op:' || diff_id || ':' || file_path || ':' || line AS source FROM o WHERE file_path = 'src/Order1.cs'")
def graph_lookup(spark, sf_dir):
    return semantics.edges(patch_graph(spark, sf_dir), target="file:src/Order1.cs", kind="DerivedFrom").select("source")


def _class_diffs(spark, sf_dir):
    """Each order as a file of one class for each item, with a method that tests a member, negated by return flag."""
    line = lambda *parts: F.concat(*parts)
    member = F.concat(F.lit("IsOpen"), (c("l_partkey") % 2).cast("string"))
    body = line(F.lit("+class C"), c("l_linenumber").cast("string"), F.lit(" {\n+  public void Run() {\n+    if ("), F.when(c("l_returnflag") == "A", "!").otherwise(""), member, F.lit("(x)) { Go(); }\n+  }\n+}"))
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", body.alias("line")))).alias("rows"))
    head = F.concat(F.lit("diff --git a/src/Order.cs b/src/Order.cs\n@@ -1,9 +1,9 @@\n"))
    return items.select(c("l_orderkey").alias("diff_id"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("raw_diff"))


@query("""WITH i AS (SELECT l_orderkey AS d, 'C' || l_linenumber AS k, 'IsOpen' || (l_partkey % 2) AS callee, l_returnflag = 'A' AS neg, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey % 2 ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem), s AS (SELECT * FROM i WHERE rn = 1)
SELECT a.d AS diff_id, 'Run' AS method_name, a.callee, least(a.k, b.k) AS class_a, greatest(a.k, b.k) AS class_b FROM s a JOIN s b ON a.d = b.d AND a.callee = b.callee AND a.neg AND NOT b.neg""")
def polarity_mismatches(spark, sf_dir):
    return semantics.polarity_mismatches(rules.context(_class_diffs(spark, sf_dir))).drop("file_path")


def _guard_diffs(spark, sf_dir):
    """Each order as a method in which some items remove a guard of a symbol, some add one, and others use it."""
    symbol = F.concat(F.lit("f"), (c("l_suppkey") % 2).cast("string"))
    line = F.when(c("l_returnflag") == "A", F.concat(F.lit("-    if ("), symbol, F.lit(" == null) return;"))).when(c("l_returnflag") == "N", F.concat(F.when(c("l_linestatus") == "F", " ").otherwise("+"), F.lit("    "), symbol, F.lit(".Go();"))).otherwise(F.concat(F.lit("+    ArgumentNullException.ThrowIfNull("), symbol, F.lit(");")))
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")))).alias("rows"))
    head = F.lit("diff --git a/src/Order.cs b/src/Order.cs\n@@ -1,9 +1,9 @@\n class A {\n   public void Run(Foo f0, Foo f1) {\n")
    return items.select(c("l_orderkey").alias("diff_id"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n   }\n }")).alias("raw_diff"))


@query("""WITH i AS (SELECT l_orderkey AS d, 'f' || (l_suppkey % 2) AS symbol, l_returnflag AS flag, l_linestatus <> 'F' AS fresh, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
m AS (SELECT g.d, g.symbol, g.n AS guard, u.n AS used, row_number() OVER (PARTITION BY g.d, g.symbol, g.n ORDER BY u.fresh DESC, u.n) AS rn FROM i g JOIN i u ON g.d = u.d AND g.symbol = u.symbol AND g.flag = 'A' AND u.flag = 'N' AND u.n > g.n)
SELECT d AS diff_id, symbol, used - guard AS apart FROM m WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM i k WHERE k.d = m.d AND k.symbol = m.symbol AND k.flag = 'R' AND k.n > m.guard AND k.n < m.used)""")
def unguarded_uses(spark, sf_dir):
    return semantics.unguarded_uses(rules.context(_guard_diffs(spark, sf_dir))).select("diff_id", "symbol", (c("use_ord") - c("guard_ord")).cast("long").alias("apart"))


def _light(spark, sf_dir):
    """Each order as the diff of one file, a third of them no sources, whose lines are its items, removed or added by status."""
    line = F.concat(F.when(c("l_linestatus") == "F", "-p").otherwise("+p"), c("l_partkey").cast("string"))
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")))).alias("rows"))
    path = F.concat(F.lit("src/O"), c("l_orderkey").cast("string"), F.when(c("l_orderkey") % 3 == 0, ".md").otherwise(".cs"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n"))
    return items.select(c("l_orderkey").alias("diff_id"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("raw_diff"))


_LIGHT_SQL = "p AS (SELECT l_orderkey AS d, 'src/O' || l_orderkey || CASE WHEN l_orderkey % 3 = 0 THEN '.md' ELSE '.cs' END AS path, l_linestatus <> 'F' AS added, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"


@query(f"WITH {_LIGHT_SQL} SELECT DISTINCT d AS diff_id, 'header' AS kind, 3 AS n FROM p UNION ALL SELECT d, CASE WHEN added THEN 'added' ELSE 'removed' END, count(*) FROM p GROUP BY 1, 2")
def light_lines(spark, sf_dir):
    return semantics.light_lines(_light(spark, sf_dir)).groupBy("diff_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LIGHT_SQL} SELECT DISTINCT d AS diff_id, path FROM p WHERE d % 3 <> 0")
def changed_sources(spark, sf_dir):
    return semantics.changed_sources(_light(spark, sf_dir))


@query(f"WITH {_LIGHT_SQL} SELECT d AS diff_id, path, string_agg('p' || l_partkey, chr(10) ORDER BY n) AS text FROM p WHERE added GROUP BY 1, 2")
def added_text(spark, sf_dir):
    return semantics.added_text(_light(spark, sf_dir))


@query(f"WITH {_LIGHT_SQL} SELECT DISTINCT d AS diff_id, CASE WHEN path = 'src/O1.cs' THEN 40 ELSE 0 END AS n FROM p")
def file_slices(spark, sf_dir):
    return semantics.file_slice(_light(spark, sf_dir), "src/O1.cs", 40).select("diff_id", F.coalesce(F.length("slice"), F.lit(0)).alias("n"))


# reports ---------------------------------------------------------------------------------------------------------------


def _findings(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("diff_id"), F.concat(F.lit("R"), "l_returnflag").alias("rule_id"), F.when(c("l_linestatus") == "F", 3).when(c("l_quantity") > 25, 2).otherwise(1).alias("severity"),
        F.concat(F.lit("f"), (c("l_partkey") % 5).cast("string")).alias("file_path"), F.when(c("l_linenumber") > 2, c("l_linenumber")).alias("line"), c("l_linenumber").alias("id"), (c("l_partkey") % 3).cast("int").alias("confidence"),
    )


_F = """f AS (SELECT l_orderkey AS diff_id, 'R' || l_returnflag AS rule_id, CASE WHEN l_linestatus = 'F' THEN 3 WHEN l_quantity > 25 THEN 2 ELSE 1 END AS severity, 'f' || (l_partkey % 5) AS file_path, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS line, l_linenumber AS id FROM lineitem)"""


@query(f"WITH {_F} SELECT o_orderkey AS diff_id, CASE WHEN w = 3 THEN 'failure' WHEN w IN (1, 2) THEN 'neutral' ELSE 'success' END AS conclusion, least(coalesce(p, 0), 50) AS annotations FROM orders LEFT JOIN (SELECT diff_id, max(severity) AS w, count(line) AS p FROM f GROUP BY 1) ON diff_id = o_orderkey")
def check_runs(spark, sf_dir):
    return reports.check_runs(_t(spark, sf_dir, "orders").select(c("o_orderkey").alias("diff_id")), _findings(spark, sf_dir))


@query(f"WITH {_F} SELECT diff_id, count(*) FILTER (severity = 3) AS blocks, count(*) FILTER (severity = 2) AS warnings, count(*) FILTER (severity = 1) AS notes, count(DISTINCT CASE WHEN severity IN (2, 3) THEN rule_id END) >= 4 AS compound FROM f GROUP BY 1")
def console_report(spark, sf_dir):
    return reports.console(_findings(spark, sf_dir))


@query(f"WITH {_F} SELECT rule_id, CASE WHEN line IS NULL THEN 'summary' ELSE 'inline' END AS part, '**' || rule_id || '** e' AS body, count(*) AS n FROM f GROUP BY 1, 2, 3")
def review_parts(spark, sf_dir):
    return reports.review_parts(_findings(spark, sf_dir).withColumn("evidence", F.lit("e"))).groupBy("rule_id", "part", "body").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY severity DESC, rule_id, id) AS rn FROM f)
SELECT diff_id, count(*) FILTER (severity = 3) || ' blocking: ' || string_agg(rule_id, ', ' ORDER BY rn) FILTER (rn <= 3) AS message FROM r GROUP BY 1""")
def chat_messages(spark, sf_dir):
    return reports.chat_message(_findings(spark, sf_dir))


@query(f"WITH {_F} SELECT diff_id, count(*) AS total, count(*) FILTER (severity = 3) AS blocks FROM f GROUP BY 1")
def json_report(spark, sf_dir):
    out = reports.json_report(_findings(spark, sf_dir)).select("diff_id", F.from_json("json", "total long, blocks long, findings array<struct<rule: string>>").alias("j"))
    return out.filter(F.size("j.findings") == c("j.total")).select("diff_id", "j.total", "j.blocks")


@query("""WITH f AS (SELECT l_orderkey AS d, 'R' || l_returnflag AS r, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'f' || (l_partkey % 3) || '.cs' END AS file, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber END AS line, l_partkey % 3 AS sure,
  CASE WHEN l_suppkey % 3 > 0 THEN 'e' || (l_suppkey % 5) || '%0Ax' END AS said, 's' || l_suppkey AS summary, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
e AS (SELECT d, r, file, string_agg('%0A  - ' || said, '' ORDER BY n) AS said FROM (SELECT d, r, file, said, min(n) AS n FROM f WHERE said IS NOT NULL GROUP BY ALL) GROUP BY ALL),
l AS (SELECT d, r, file, min(line) AS first, count(*) AS n, string_agg(line, ', ' ORDER BY line) AS lines FROM (SELECT DISTINCT d, r, file, line FROM f WHERE line IS NOT NULL) GROUP BY ALL),
g AS (SELECT d, r, file, arg_min(sure, n) AS sure, arg_min(summary, n) AS summary FROM f GROUP BY ALL)
SELECT g.d AS diff_id, g.r AS rule_id, g.file AS file_path, '::' || CASE sure WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'notice' END || ' ' || CASE WHEN g.file <> '' THEN 'file=' || g.file || ',line=' || coalesce(first, 1) || ',' ELSE '' END || 'title=' || g.r || ' a%3A b%2C 5%25::' || summary
  || CASE WHEN l.n > 1 THEN '%0ALines: ' || lines ELSE '' END || coalesce('%0AEvidence:' || e.said, '') AS command FROM g LEFT JOIN l USING (d, r, file) LEFT JOIN e USING (d, r, file)""")
def workflow_annotations(spark, sf_dir):
    evidence = F.when(c("l_suppkey") % 3 > 0, F.concat(F.lit("e"), (c("l_suppkey") % 5).cast("string"), F.lit("\r\nx")))
    findings = _t(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("diff_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), F.concat(F.lit("R"), "l_returnflag").alias("rule_id"), F.lit("a: b, 5%").alias("rule_name"), F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("summary"),
        (c("l_partkey") % 3).alias("confidence"), F.when(c("l_partkey") % 4 > 0, F.concat(F.lit("f"), (c("l_partkey") % 3).cast("string"), F.lit(".cs"))).alias("file_path"), F.when(c("l_suppkey") % 2 == 0, c("l_linenumber")).alias("line"), evidence.alias("evidence"),
    )
    return reports.annotations(findings)


@query("""SELECT l_linestatus AS tier, l_returnflag AS rule_id, '| ' || l_returnflag || ' | ' || printf('%.1f', round(l_discount * 100, 1)) || '% | ' || printf('%.1f', round(l_tax * 100, 1)) || '% | ' || printf('%.1f', round(l_quantity / 50 * 100, 1)) || '% |' AS row FROM lineitem""")
def markdown_scorecard(spark, sf_dir):
    return reports.markdown_scorecard(_t(spark, sf_dir, "lineitem").select(c("l_linestatus").alias("tier"), c("l_returnflag").alias("rule_id"), c("l_discount").alias("trigger_rate"), c("l_tax").alias("precision"), (c("l_quantity") / 50).alias("recall")))


@query("""SELECT p_partkey AS diff_id, '<tr><td>' || p_brand || '</td><td>' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'a&lt;' || p_type || '&gt;.cs' END || '</td><td>' || p_size || '</td><td>' || p_name || ' &amp; x</td></tr>' AS row FROM part""")
def html_rows(spark, sf_dir):
    path = F.when(c("p_partkey") % 5 > 0, F.concat(F.lit("a<"), "p_type", F.lit(">.cs")))
    return reports.html_rows(_t(spark, sf_dir, "part").select(c("p_partkey").alias("diff_id"), c("p_brand").alias("rule_id"), path.alias("file_path"), c("p_size").alias("line"), F.concat("p_name", F.lit(" & x")).alias("evidence")))
