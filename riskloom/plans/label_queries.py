"""Queries of labels and snapshots, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import corpus, labels, signals, strategies
from riskloom.plans.registry import literal, query
from riskloom.plans.registry import table as _t
from riskloom.sources import snapshots

c = F.col

_RULES = sorted({r for step in labels.COORDINATIONS for part in step for r in part})
_MORE = [*_RULES, "GCI0004", "GCI0006"]
_RULE_SQL = f"[{', '.join(map(literal, _MORE))}][CAST(o_orderkey // 4 % {len(_MORE)} AS INT) + 1]"
_SURE_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 0.7 WHEN '2' THEN 0.65 WHEN '3' THEN 0.6 WHEN '4' THEN 0.55 ELSE 0.45 END::DOUBLE"


def _rule():
    return F.element_at(F.lit(_MORE), (F.floor(c("o_orderkey") / 4) % len(_MORE) + 1).cast("int"))


def _sure():
    return F.coalesce(*[F.when(F.left("o_orderpriority", F.lit(1)) == str(k + 1), F.lit(x)) for k, x in enumerate((0.7, 0.65, 0.6, 0.55))], F.lit(0.45))


def _coordinated_sql(of: str) -> str:
    """Common tables that carry `of` (f, rule_id, fires, sure, source; one row a rule) through the coordinations, a column for
    each rule's positive and negative confidence and its source; the last one is named settled."""
    out = ["s0 AS MATERIALIZED (SELECT f, " + ", ".join(f"max(CASE WHEN rule_id = '{r}' AND fires = 1 THEN sure END) AS p_{r}, max(CASE WHEN rule_id = '{r}' AND fires = 0 THEN sure END) AS n_{r}, max(CASE WHEN rule_id = '{r}' THEN source END) AS o_{r}" for r in _RULES) + f" FROM {of} GROUP BY f)"]
    for k, (needs, floors, turns) in enumerate(labels.COORDINATIONS):
        met = " AND ".join(f"coalesce(p_{r} >= {x}, false)" for r, x in needs.items())
        columns = []
        for r in _RULES:
            turned = f"{met} AND p_{r} IS NULL AND n_{r} IS NOT NULL" if r in turns else "false"
            columns.append(f"CASE WHEN {turned} THEN {turns.get(r, 0)} WHEN {met} AND p_{r} IS NOT NULL THEN greatest(p_{r}, {floors.get(r, 0)}) ELSE p_{r} END AS p_{r}, CASE WHEN {turned} THEN NULL ELSE n_{r} END AS n_{r}, CASE WHEN {turned} THEN 'Heuristic' ELSE o_{r} END AS o_{r}")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT f, {', '.join(columns)} FROM s{k})")
    last = f"s{len(labels.COORDINATIONS)}"
    rows = " UNION ALL ".join(f"SELECT f, '{r}' AS rule_id, CASE WHEN p_{r} IS NULL THEN 0 ELSE 1 END AS fires, coalesce(p_{r}, n_{r}) AS sure, o_{r} AS source FROM {last} WHERE coalesce(p_{r}, n_{r}) IS NOT NULL" for r in _RULES)
    out.append(f"settled AS ({rows} UNION ALL SELECT f, rule_id, fires, sure, source FROM {of} WHERE rule_id NOT IN ({', '.join(map(literal, _RULES))}))")
    return ", ".join(out)


@query(f"""WITH a AS (SELECT o_custkey AS f, {_RULE_SQL} AS rule_id, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS fires, {_SURE_SQL} AS sure FROM orders),
b AS (SELECT f, rule_id, fires, sure, 'Heuristic' AS source FROM (SELECT *, row_number() OVER (PARTITION BY f, rule_id ORDER BY fires DESC, sure DESC) AS rn FROM a) WHERE rn = 1), {_coordinated_sql("b")}
SELECT f AS o_custkey, rule_id, fires AS should_trigger, sure::DOUBLE AS confidence, source AS label_source FROM settled""")
def settled_labels(spark, sf_dir):
    """Orders as labels of their customers, positive and negative, through all coordinations."""
    given = _t(spark, sf_dir, "orders").select("o_custkey", _rule().alias("rule_id"), (c("o_totalprice") > 100000).cast("int").alias("should_trigger"), _sure().alias("confidence"), F.lit("Heuristic").alias("label_source"))
    return labels.coordinate(given, "o_custkey")


_EVENT_RULES = {"click": "GCI0039", "view": "gci0048", "purchase": "GCI0042", "error": "GCI0099"}


@query(f"""WITH e AS (SELECT o_custkey AS f, {_RULE_SQL} AS rule_id, {_SURE_SQL} AS sure FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT user_id AS f, 'f' || event_id % 5 AS path, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v.upper()}'" for k, v in _EVENT_RULES.items())} END AS rule_id FROM events), h AS (SELECT DISTINCT conv_id AS f, 'f' || turn AS path FROM conversations),
x AS (SELECT f, rule_id, 2 AS o, sure, 'Heuristic' AS source FROM e UNION ALL SELECT f, rule_id, 1, {labels.CORRELATED}, 'FilePathCorrelation' FROM r JOIN h USING (f, path) WHERE rule_id IN ({", ".join(map(literal, labels.WITH_HEURISTICS))})),
b AS (SELECT f, rule_id, 1 AS fires, sure, source FROM (SELECT *, row_number() OVER (PARTITION BY f, rule_id ORDER BY o DESC, sure DESC) AS rn FROM x) WHERE rn = 1), {_coordinated_sql("b")},
n AS (SELECT f, rule_id FROM (SELECT c_custkey AS f FROM customer UNION SELECT f FROM x) CROSS JOIN (SELECT unnest([{", ".join(map(literal, labels.OF_STRATEGIES))}]) AS rule_id))
SELECT f AS fixture_id, rule_id, fires AS should_trigger, sure::DOUBLE AS confidence, source AS label_source FROM settled UNION ALL SELECT f, rule_id, 0, {labels.NEGATIVE}, 'Heuristic' FROM n WHERE NOT EXISTS (SELECT 1 FROM settled s WHERE s.f = n.f AND s.rule_id = n.rule_id)""")
def silver_labels(spark, sf_dir):
    """Customers as fixtures: their finished orders speak for rules, their events are findings, conversations comment on files."""
    evidence = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(c("o_custkey").alias("fixture_id"), _rule().alias("rule_id"), _sure().alias("confidence"))
    rule = F.coalesce(*[F.when(c("event_type") == k, F.lit(v)) for k, v in _EVENT_RULES.items()])
    fired = _t(spark, sf_dir, "events").select(c("user_id").alias("fixture_id"), rule.alias("rule_id"), F.concat(F.lit("F"), (c("event_id") % 5).cast("string")).alias("file_path"))
    commented = _t(spark, sf_dir, "conversations").select(c("conv_id").alias("fixture_id"), F.concat(F.lit("f"), c("turn").cast("string")).alias("file_path"))
    return labels.infer(_t(spark, sf_dir, "customer").select(c("c_custkey").alias("fixture_id")), evidence, fired, commented, "fixture_id")


def _of_supplier():
    return F.concat(F.lit("S"), (c("l_suppkey") % 25).cast("string"))


def _scores(lines, *by):
    flag = lambda v: F.count_if(c("l_returnflag") == v)
    out = lines.groupBy(F.concat_ws("-", _of_supplier(), *by).alias("rule_id")).agg(flag("A").alias("tp"), flag("N").alias("fp"), flag("R").alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", c("tp") + c("fp"))).withColumn("recall", F.try_divide("tp", c("tp") + c("fn")))


def _store(spark, sf_dir):
    """Two snapshots: all lines by supplier, then the open ones, and all by supplier and line status."""
    lines, path = _t(spark, sf_dir, "lineitem"), snapshots.new_folder(spark, "snapshots")
    snapshots.publish(_scores(lines), path, "2024-01-01 00:00:00", "all lines")
    snapshots.publish(_scores(lines.filter("l_linestatus = 'O'")).unionByName(_scores(lines, "l_linestatus")).filter("rule_id <> 'S7'"), path, "2024-02-01 00:00:00")
    return path


_SCORES_SQL = "count(*) FILTER (l_returnflag = 'A') AS tp, count(*) FILTER (l_returnflag = 'N') AS fp, count(*) FILTER (l_returnflag = 'R') AS fn"
_STORE_SQL = f"""s1 AS (SELECT 'S' || l_suppkey % 25 AS rule_id, {_SCORES_SQL} FROM lineitem GROUP BY 1),
s2 AS (SELECT 'S' || l_suppkey % 25 AS rule_id, {_SCORES_SQL} FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 25 <> 7 GROUP BY 1 UNION ALL SELECT 'S' || l_suppkey % 25 || '-' || l_linestatus, {_SCORES_SQL} FROM lineitem GROUP BY 1)"""


@query(f"WITH {_STORE_SQL} SELECT rule_id, tp, fp, fn, CAST(2 AS BIGINT) AS snapshot_id FROM s2 UNION ALL SELECT rule_id, tp, fp, fn, 1 FROM s1 WHERE rule_id NOT IN (SELECT rule_id FROM s2)")
def latest_snapshots(spark, sf_dir):
    return snapshots.latest_per_rule(spark, _store(spark, sf_dir)).select("rule_id", "tp", "fp", "fn", "snapshot_id")


@query(f"WITH {_STORE_SQL} SELECT rule_id, tp, fp, fn, CAST(1 AS BIGINT) AS snapshot_id FROM s1")
def snapshot_as_of(spark, sf_dir):
    return snapshots.as_of(spark, _store(spark, sf_dir), "2024-01-31 00:00:00").select("rule_id", "tp", "fp", "fn", "snapshot_id")


@query(f"""WITH {_STORE_SQL}, l AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
e AS (SELECT 'S' || l_suppkey % 25 AS rule_id, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 3 GROUP BY 1), a AS (SELECT 'S' || l_suppkey % 25 || '-' || l_linestatus AS rule_id, l_partkey, l_orderkey FROM lineitem WHERE l_quantity > 10),
f AS (SELECT rule_id, count(DISTINCT l_partkey) AS n FROM a WHERE l_orderkey IN (SELECT o_orderkey FROM l) GROUP BY 1), t AS (SELECT rule_id, count(*) AS n FROM a GROUP BY 1), k AS (SELECT rule_id FROM s2 UNION SELECT rule_id FROM e UNION SELECT rule_id FROM t)
SELECT rule_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall, coalesce(e.n, 0) AS expected_triggers, coalesce(f.n, 0) AS fixtures_latest, coalesce(t.n, 0) AS triggers_all_runs
FROM k LEFT JOIN s2 USING (rule_id) LEFT JOIN e USING (rule_id) LEFT JOIN f USING (rule_id) LEFT JOIN t USING (rule_id)""")
def rule_audit(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    expected = lines.select(_of_supplier().alias("rule_id"), (c("l_returnflag") != "N").cast("int").alias("should_trigger"), (c("l_linenumber") == 3).alias("is_inconclusive"))
    actual = lines.select(c("l_partkey").alias("fixture_id"), c("l_orderkey").alias("run_id"), F.concat_ws("-", _of_supplier(), "l_linestatus").alias("rule_id"), (c("l_quantity") > 10).cast("int").alias("did_trigger"))
    latest = corpus.first_by(_t(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(c("o_orderkey").alias("run_id"))
    counts = ["tp", "fp", "fn", "expected_triggers", "fixtures_latest", "triggers_all_runs"]
    return snapshots.rule_audit(snapshots.as_of(spark, _store(spark, sf_dir)), expected, actual, latest).na.fill(0, counts)


_PATHS = ["src/OrderHandler.cs", "tests/OrderTests.cs", "src/Migrations/20240101000000_Add.cs", "samples/Order.cs", "docs/notes.txt", "src/Gone.cs"]
_GONE = len(_PATHS) - 1
_OUT = ["public int Get(int a)", '[JsonProperty("x")]', "using (var s = Open())", "if (upsert) { }", "Assert.Equal(1, n);", 'migrationBuilder.DropTable("t");', "var n = a?.Length ?? 0;"]
_IN = ["public int Get(long a)", "var x = LoadAsync().Result;", "foreach (var a in list.Where(b)) { }", "class UserView { UserService s; }", "int n = value!;"]


def _any(of: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({of}, {literal(w)})" for w in words) + ")"


#: What the added lines and the paths show, line by line; the removed line of each change is one of _OUT.
_ADDED_FLAGS = {
    "blocks": f"({_any('t', ['.GetAwaiter().GetResult()', '.Wait()', 'lock(this)', 'lock (this)'])} OR (contains(t, '.Result') AND {_any('t', ['Task', 'Async'])}) OR (contains(t, '.Wait(') AND {_any('t', ['Task', 'CancellationToken'])}) OR (contains(t, 'async void ') AND NOT {_any('t', ['EventArgs', 'object sender'])}))",
    "sleeps": "contains(t, 'Thread.Sleep(') AND code", "signature": "regexp_matches(t, '^\\s*(public|protected|internal) ') AND contains(t, '(')",
    "layers": "code AND ((contains(lower(t), 'ui') AND contains(t, 'Repository')) OR (contains(t, 'View') AND contains(t, 'Service')) OR (contains(lower(t), 'database') AND contains(t, 'Controller')))",
    "query": _any("t", [".Where(", ".Select(", ".FirstOrDefault("]), "loop": _any("t", ["for ", "foreach"]), "allocates": _any("t", ["new List<", "new Dictionary<", "new string"]),
    "stub": "(contains(t, 'NotImplementedException') OR (contains(t, 'throw new') AND contains(t, 'NotImplemented')) OR (contains(t, 'TODO') AND contains(lower(t), 'implement')))",
    "null_set": "code AND contains(t, ' = null') AND NOT contains(t, '?')", "forgives": f"((code AND {_any('t', [')!', '!;', '!,', '!.'])}) OR {_any('t', ['CS8600', 'CS8602'])} OR contains(lower(t), '#pragma warning disable nullable'))",
    "secret": f"code AND ((regexp_matches(t, '^[^=]*=\\s*[@$]?\"') AND {_any('lower(t)', strategies.SECRET_WORDS)}) OR {_any('t', strategies.WEAK_HASH_CALLS)} OR (regexp_matches(t, '(?i)\\b(SELECT|INSERT|UPDATE|DELETE|FROM)\\b') AND ({_any('t', [' + ', 'string.Format('])} OR (contains(t, '{{') AND contains(t, '$\"')))))",
}


@query(f"""WITH d AS (SELECT doc_id, doc_id % {len(_PATHS)} AS p, doc_id % {len(_OUT)} AS o, doc_id % {len(_IN)} AS i, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS x FROM documents),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS t FROM d UNION ALL SELECT doc_id, [{", ".join(map(literal, _IN))}][CAST(i AS INT) + 1] FROM d),
k AS (SELECT doc_id, t, NOT regexp_matches(t, '^\\s*//') AS code FROM l WHERE NOT starts_with(t, '++')),
f AS (SELECT doc_id, {", ".join(f"coalesce(bool_or({v}), false) AS {n}" for n, v in _ADDED_FLAGS.items())} FROM k GROUP BY 1),
m AS (SELECT d.doc_id, p IN (0, 2) AS own, p, o, f.* EXCLUDE (doc_id) FROM d JOIN f USING (doc_id)),
r AS (SELECT doc_id, 'GCI0003' AS rule_id, own AND o = 0 AND signature AS hit FROM m UNION ALL SELECT doc_id, 'GCI0006', own AND (o = 6 OR null_set) FROM m UNION ALL SELECT doc_id, 'GCI0012', own AND secret FROM m
UNION ALL SELECT doc_id, 'GCI0016', blocks OR (sleeps AND p <> 1) FROM m UNION ALL SELECT doc_id, 'GCI0021', (own AND o = 1) OR (p = 2 AND o = 5) FROM m UNION ALL SELECT doc_id, 'GCI0022', own AND o = 3 FROM m
UNION ALL SELECT doc_id, 'GCI0024', own AND o = 2 FROM m UNION ALL SELECT doc_id, 'GCI0035', layers FROM m UNION ALL SELECT doc_id, 'GCI0041', o = 4 FROM m UNION ALL SELECT doc_id, 'GCI0042', stub FROM m
UNION ALL SELECT doc_id, 'GCI0043', forgives FROM m UNION ALL SELECT doc_id, 'GCI0044', (query AND loop) OR (allocates AND p = 0) FROM m)
SELECT doc_id AS diff_id, rule_id, CASE rule_id {" ".join(f"WHEN '{k}' THEN {v}" for k, v in strategies.CONFIDENCE.items())} END::DOUBLE AS confidence FROM r WHERE hit""")
def diff_strategies(spark, sf_dir):
    """Each document as a change of a file: its lines are added, with a line of code, and another line of code goes."""
    pick = lambda of: F.element_at(F.lit(of), (c("doc_id") % len(of) + 1).cast("int"))
    path = pick(_PATHS)
    to = F.when(c("doc_id") % len(_PATHS) == _GONE, F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), path))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ "), to, F.lit("\n@@ -1,1 +1,2 @@\n-"), pick(_OUT), F.lit("\n+"))
    body = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), F.lit("\n"), F.lit("\n+"))
    return strategies.diff_strategies(_t(spark, sf_dir, "documents").select(c("doc_id").alias("diff_id"), F.concat(head, body, F.lit("\n+"), pick(_IN)).alias("raw_diff")))


@query("""WITH o AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'P' AND o_totalprice > 300000) AS dependabot, max(o_totalprice / 500000) AS score, max(o_orderkey % 3) AS reviewers, bool_or(o_orderpriority = '1-URGENT') AS empty_body, bool_or(o_orderstatus = 'F') AS unfinished FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, sum(CAST(event_type = 'error' AND value > 180 AS INT)) AS sonar, sum(CAST(event_type = 'signup' AND value > 190 AS INT)) AS codeql FROM events GROUP BY 1),
h AS (SELECT conv_id AS k, max(turn / 10) AS structural, bool_or(role = 'user') AS sensitive FROM conversations GROUP BY 1), q AS (SELECT doc_id AS k, bool_or(quality = 0) AS test_gap, bool_or(toxic = 1) AS nlp FROM labels GROUP BY 1),
d AS (SELECT doc_id AS k, max(n_chars / 20000) AS hotspot, bool_or(contains(text, '#')) AS linked FROM documents GROUP BY 1), m AS (SELECT s_suppkey AS k, bool_or(s_acctbal < 0) AS migration FROM supplier GROUP BY 1), p AS (SELECT p_partkey AS k, sum(CAST(p_size > 48 AS INT)) AS advisories FROM part GROUP BY 1),
a AS (SELECT c_custkey AS k, o.* EXCLUDE (k), e.* EXCLUDE (k), h.* EXCLUDE (k), q.* EXCLUDE (k), d.* EXCLUDE (k), migration, advisories, coalesce(sonar, 0) + coalesce(codeql, 0) AS scanned FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey LEFT JOIN h ON h.k = c_custkey LEFT JOIN q ON q.k = c_custkey LEFT JOIN d ON d.k = c_custkey LEFT JOIN m ON m.k = c_custkey LEFT JOIN p ON p.k = c_custkey),
l AS (SELECT *, CASE WHEN dependabot IS NULL AND score IS NULL AND structural IS NULL AND advisories IS NULL AND hotspot IS NULL AND nlp IS NULL AND test_gap IS NULL AND migration IS NULL AND scanned = 0 THEN 'INSUFFICIENT_DATA' WHEN dependabot THEN 'DEPENDABOT_FIX' WHEN migration OR advisories > 0 OR scanned > 0 THEN 'HIGH_RISK_GHOST'
  WHEN sensitive AND structural >= 0.6 AND score < 0.5 THEN 'HOT_PATH_UNREVIEWED' WHEN hotspot >= 0.7 AND score < 0.5 THEN 'HOT_PATH_UNREVIEWED' WHEN score < 0.7 AND reviewers <= 1 THEN 'SILENT_LOGIC_CHANGE' WHEN test_gap AND score < 0.5 THEN 'UNVALIDATED_BEHAVIORAL_RISK'
  WHEN empty_body AND unfinished AND score < 0.3 THEN 'UNVALIDATED_BEHAVIORAL_RISK' WHEN score < 0.3 THEN 'UNVALIDATED_BEHAVIORAL_RISK' WHEN score >= 0.7 THEN 'STANDARD_CHANGE' ELSE 'INSUFFICIENT_DATA' END AS label FROM a)
SELECT k AS fixture_id, label, CASE label WHEN 'DEPENDABOT_FIX' THEN 0.95 WHEN 'HIGH_RISK_GHOST' THEN CASE WHEN scanned > 0 THEN 0.8 WHEN advisories > 0 THEN 0.85 ELSE 0.6 END WHEN 'SILENT_LOGIC_CHANGE' THEN 0.55 WHEN 'UNVALIDATED_BEHAVIORAL_RISK' THEN CASE WHEN linked THEN 0.4 ELSE 0.5 END
  WHEN 'HOT_PATH_UNREVIEWED' THEN 0.65 WHEN 'STANDARD_CHANGE' THEN CASE WHEN reviewers >= 2 THEN 0.75 ELSE 0.6 END ELSE 0 END::DOUBLE AS confidence FROM l""")
def assembled_labels(spark, sf_dir):
    """Customers as fixtures: seven tables as enrichers, one exchange, then the decision list."""
    of = lambda name, key: _t(spark, sf_dir, name).withColumn("fixture_id", c(key))
    enrichers = [
        (of("orders", "o_custkey"), {"dependabot": (c("o_orderstatus") == "P") & (c("o_totalprice") > 300000), "social_score": c("o_totalprice") / 500000, "reviewers": c("o_orderkey") % 3, "empty_body": c("o_orderpriority") == "1-URGENT", "unfinished": c("o_orderstatus") == "F"}),
        (of("events", "user_id"), {"sonar": ((c("event_type") == "error") & (c("value") > 180)).cast("int"), "codeql": ((c("event_type") == "signup") & (c("value") > 190)).cast("int")}),
        (of("conversations", "conv_id"), {"structural_score": c("turn") / 10, "sensitive_path": c("role") == "user"}),
        (of("labels", "doc_id"), {"test_gap": c("quality") == 0, "nlp": c("toxic") == 1}), (of("documents", "doc_id"), {"hotspot": c("n_chars") / 20000, "linked_issue": F.contains("text", F.lit("#"))}),
        (of("supplier", "s_suppkey"), {"migration": c("s_acctbal") < 0}), (of("part", "p_partkey"), {"advisories": (c("p_size") > 48).cast("int")}),
    ]
    return corpus.composite_label(signals.assemble(_t(spark, sf_dir, "customer").select(c("c_custkey").alias("fixture_id")), enrichers))
