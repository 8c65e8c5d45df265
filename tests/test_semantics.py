"""Patch operations, labels and migrations: stated cases and their answers."""

import pytest
from conftest import SF
from riskloom.operators import corpus, rules, semantics
from riskloom.plans import catalog, patch_queries


def patch(added, removed=(), path="src/Svc.cs"):
    body = "".join(f"-{x}\n" for x in removed) + "".join(f"+{x}\n" for x in added)
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,9 +1,9 @@\n{body}"


@pytest.fixture(scope="module")
def lines(spark):
    texts = [
        patch(["if (IsReady(x))"], ["if (!IsReady(x))"]), patch(["if (Load(x) > 2)"], ["if (Load(x) > 1)"]), patch(["if (Other(x))"], ["if (Load(x) > 1)"]),
        patch(["class A {", "public void Run(Foo f) {", "f.Go();"], ["class A {", "public void Run(Foo f) {", "if (f == null)"]),
        patch(["ArgumentNullException.ThrowIfNull(f);", "f.Go();"], ["class A {", "public void Run(Foo f) {", "if (f == null)"]),
        patch(["class A {", "public void Run() {", "if (IsOpen(x)) {", "} } }", "class B {", "public void Run() {", "if (!IsOpen(x)) {"]),
        patch(["class A {", "public void Run() {", "if (IsOpen(x)) {", "} } }", "class B {", "public void Run() {", "if (IsOpen(y)) {"]),
        patch(["if (IsReady(x))"], ["if (!IsReady(x))"], "src/SvcTests.cs"), patch(["// if (IsReady(x))", "else if (IsReady(x))", "  IF (MyLoad(x))"], ["if (Load(x))"]),
    ]
    return rules.context(spark.createDataFrame(list(enumerate(texts)), "diff_id long, raw_diff string")).cache()


def test_operations(lines):
    """A condition without a partner is modified too; test paths, comments and else branches give none; names match in part."""
    found = semantics.operations(lines).collect()
    assert sorted((r.diff_id, r.risk) for r in found) == [(0, 0.95), (1, 0.75), (2, 0.55), (5, 0.55), (5, 0.55), (6, 0.55), (6, 0.55), (8, 0.75)]
    assert {r.kind for r in found} == {"ConditionalModified"} and {r.case_kind for r in semantics.counterfactuals(semantics.operations(lines)).collect()} == {"BoundaryValue"}


def test_guards_and_pairs(lines):
    assert [(r.diff_id, r.symbol) for r in semantics.unguarded_uses(lines).collect()] == [(3, "f")]
    assert [(r.diff_id, r.method_name, r.callee, r.class_a, r.class_b) for r in semantics.polarity_mismatches(lines).collect()] == [(5, "Run", "IsOpen", "A", "B")]


def test_a_closed_method_shields_its_guard(spark):
    """A use in another method, or after the class, is not one of the guard's."""
    used_later = [" class A {", "  void F(Foo f) {".replace("void", "public void"), "-   if (f == null) return;", "  }", "  public void G(Foo f) {", "+   f.Go();", "  }", " }"]
    text = "diff --git a/a.cs b/a.cs\n@@ -1,9 +1,9 @@\n" + "\n".join(used_later)
    rows = rules.context(spark.createDataFrame([(0, text)], "diff_id long, raw_diff string"))
    assert semantics.unguarded_uses(rows).count() == 0


def test_semantic_boost_needs_the_line(spark):
    """Only a risky changed condition on the finding's own line, whatever the case and slashes of its path."""
    findings = spark.createDataFrame([(1, "GCI0003", 0, "src/A.cs", 3), (2, "GCI0003", 0, "src/A.cs", 4), (3, "GCI0042", 0, "src/A.cs", 3), (4, "GCI0058", 0, None, 3), (5, "gci0059", 0, "\\SRC\\a.cs", 3), (6, "GCI0007", 0, "src/B.cs", 1), (7, "GCI0007", 0, "src/B.cs", 2)], "id int, rule_id string, confidence int, file_path string, line int")
    ops = spark.createDataFrame([("/src/a.cs", 3, "ConditionalModified", 0.95), ("src/A.cs", 3, "ConditionalModified", 0.9), ("src/B.cs", 1, "ConditionalModified", 0.75), ("src/B.cs", 2, "LineAdded", 0.95), (None, 3, "ConditionalModified", 0.95)], "file_path string, line int, kind string, risk double")
    assert sorted((r.id, r.confidence) for r in corpus.semantic_boost(findings, ops).collect()) == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 2), (6, 0), (7, 0)]


SIGNALS = "fixture_id int, dependabot boolean, migration boolean, advisories int, sonar int, codeql int, semgrep int, social_score double, reviewers int, sensitive_path boolean, structural_score double, hotspot double, entropy double, test_gap boolean, empty_body boolean, unfinished boolean, first_contributor boolean, linked_issue boolean, nlp boolean"
LABELLED = [
    ({}, "INSUFFICIENT_DATA", 0.0), ({"sonar": 0, "codeql": 0, "first_contributor": True, "empty_body": True}, "INSUFFICIENT_DATA", 0.0), ({"nlp": True, "first_contributor": True, "empty_body": True}, "UNVALIDATED_BEHAVIORAL_RISK", 0.5),
    ({"semgrep": 0, "first_contributor": True, "empty_body": True}, "UNVALIDATED_BEHAVIORAL_RISK", 0.5), ({"dependabot": True, "sonar": 3}, "DEPENDABOT_FIX", 0.95), ({"migration": True}, "HIGH_RISK_GHOST", 0.6),
    ({"advisories": 2, "dependabot": False}, "HIGH_RISK_GHOST", 0.85), ({"sonar": 1, "social_score": 0.9}, "HIGH_RISK_GHOST", 0.8), ({"semgrep": 1}, "HIGH_RISK_GHOST", 0.6), ({"sensitive_path": True, "structural_score": 0.7, "social_score": 0.4}, "HOT_PATH_UNREVIEWED", 0.65),
    ({"hotspot": 0.7, "social_score": 0.49}, "HOT_PATH_UNREVIEWED", 0.65), ({"entropy": 0.8, "social_score": 0.39}, "HOT_PATH_UNREVIEWED", 0.65), ({"social_score": 0.6, "reviewers": 1}, "SILENT_LOGIC_CHANGE", 0.55),
    ({"social_score": 0.45, "reviewers": 2, "test_gap": True}, "UNVALIDATED_BEHAVIORAL_RISK", 0.5), ({"social_score": 0.2, "reviewers": 2, "linked_issue": True}, "UNVALIDATED_BEHAVIORAL_RISK", 0.4),
    ({"social_score": 0.8, "reviewers": 2}, "STANDARD_CHANGE", 0.75), ({"social_score": 0.8, "reviewers": 1}, "STANDARD_CHANGE", 0.6), ({"social_score": 0.6, "reviewers": 2}, "INSUFFICIENT_DATA", 0.0),
]


def test_composite_labels(spark):
    names = [x.split()[0] for x in SIGNALS.split(", ")]
    rows = [tuple({**s, "fixture_id": k}.get(n) for n in names) for k, (s, _, _) in enumerate(LABELLED)]
    df = spark.createDataFrame(rows, SIGNALS)
    assert [(r.label, r.confidence) for r in corpus.composite_label(df).orderBy("fixture_id").collect()] == [(x, y) for _, x, y in LABELLED]
    assert corpus.composite_label(df.drop("nlp")).count() == len(LABELLED)


def test_migrations(spark):
    rows = [
        (1, "src/Migrations/20240101000000_Add.cs", "int x;"), (2, "db/a.sql", None), (3, "src/A.cs", "create table x"), (4, "src/FooContextModelSnapshot.cs", "b.Property"), (5, "src/A.cs", "var x = 1;"), (6, "src/Migrations/M2.cs", "int x;"),
        (7, "src/A.cs", "migrationBuilder.X("), (8, "src/A.cs", "[Index(1)]"), (9, "src/A.cs", "public partial class M : Migration"), (10, "src\\Migrations\\20240101000000_Add.cs", None), (11, "Migrations/20240101000000_Add.cs", "int x;"),
    ]
    found = {r.id: (r.confidence, r.detected) for r in corpus.migration_signals(spark.createDataFrame(rows, "id int, path string, text string"), "id").collect()}
    assert found == {1: (0.95, True), 2: (0.85, True), 3: (0.85, True), 4: (0.0, True), 5: (0.0, False), 6: (0.0, False), 7: (0.75, True), 8: (0.75, True), 9: (0.75, True), 10: (0.95, True), 11: (0.0, False)}


def test_every_rule_is_asked(spark, monkeypatch):
    """No rule is dropped, however many there are; past the bound it raises."""
    known = spark.range(1500).selectExpr("cast(id as string) AS rule_id")
    fixtures, positive = spark.createDataFrame([(1,), (2,)], "fixture_id int"), spark.createDataFrame([(1, "7")], "fixture_id int, rule_id string")
    assert corpus.negative_labels(fixtures, known, positive).count() == 2999
    monkeypatch.setattr(corpus, "MOST_RULES", 1499)
    with pytest.raises(ValueError, match="more than 1499"):
        corpus.negative_labels(fixtures, known, positive)


def test_a_migration_is_expected_whatever_the_label(spark):
    labels = spark.createDataFrame([(1, "DEPENDABOT_FIX", 0.95), (2, "INSUFFICIENT_DATA", 0.0)], "fixture_id int, label string, confidence double")
    known, migrated = spark.createDataFrame([(1, "GCI0012")], "fixture_id int, rule_id string"), spark.createDataFrame([(1, 0.75), (2, 0.95)], "fixture_id int, confidence double")
    assert sorted(tuple(r) for r in corpus.expected_of_labels(labels, known, migrated).collect()) == [(1, "GCI0021", 0.75), (2, "GCI0021", 0.95)]


def test_incidents_meet_files_without_a_nested_loop(spark):
    """Names of any length in texts of any length, case ignored; null parts, no name, marks of patterns, a long text."""
    incidents = spark.createDataFrame([(1, "Crash in FOO.cs", None), (2, None, "a b"), (3, None, None), (4, "", "x" * 50_000 + " src/deep/Bar.cs"), (5, "foo.cs and Bar.cs", "foo.cs"), (6, "fooXcs", ""), (7, "étude", "日本語.cs")], "id int, title string, description string")
    paths = ["src/Foo.cs", "lib\\foo.cs", "deep/Bar.cs", "x/b", "y/", "z/日本語.cs", "é/tude", "q/a.b", None]
    df = corpus.incidents_of_files(incidents, spark.createDataFrame([(p,) for p in paths], "file_path string"))
    want = set()
    for r in incidents.collect():
        text = " ".join(x for x in (r.title, r.description) if x is not None).lower()
        want |= {(r.id, p) for p in paths if p and (n := p.replace("\\", "/").rsplit("/", 1)[-1].lower()) and n in text}
    assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_polarity_reads_lines_once(spark):
    """Members of many classes meet in one aggregate: the lines are cut and lexed once."""
    text = "diff --git a/a.cs b/a.cs\n@@ -1 +1,9 @@\n" + "\n".join(f"+class {n} {{\n+public void Run() {{\n+if ({x}IsOpen(y)) {{ }}\n+}}\n+}}" for n, x in [("D", "!"), ("A", "!"), ("B", ""), ("C", "")])
    found = semantics.polarity_mismatches(rules.context(spark.createDataFrame([(0, text)], "diff_id long, raw_diff string")))
    assert sorted((r.class_a, r.class_b) for r in found.collect()) == [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]
    assert "Join" not in _plan(found) and _plan(found).count("posexplode(") == 1


def test_unguarded_uses_read_lines_once(spark):
    """An added use counts before a nearer one, a guard between spares it, two removals of a line are one."""
    body = [" class A {", "  public void Run(Foo f) {", "-    if (f == null) Check.ThrowIfNull(f);", "     f.One();", "+    f.Two();", "-    if (g == null) return;", "+    ThrowIfNull(g);", "+    g.Go();", "   }", " }"]
    text = "diff --git a/a.cs b/a.cs\n@@ -1,9 +1,9 @@\n" + "\n".join(body)
    found = semantics.unguarded_uses(rules.context(spark.createDataFrame([(0, text)], "diff_id long, raw_diff string")))
    assert [(r.symbol, r.use_ord - r.guard_ord) for r in found.collect()] == [("f", 2)]
    assert "Join" not in _plan(found) and _plan(found).count("posexplode(") == 1


def test_incidents_are_not_broadcast(spark, monkeypatch):
    """Names are the broadcast side, in blocks; the pieces of the texts, far more than the texts, never are."""
    plan = catalog.QUERIES["incident_files"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and not any("Generate" in x for x in plan.split("BroadcastExchange")[1:])
    monkeypatch.setattr(corpus, "NAME_BLOCK", 2)
    incidents = spark.createDataFrame([(1, "t", "ab.cs x.y"), (1, "t", "ab.cs"), (1, "t", "ab.cs"), (2, None, "Q.Z")], "id long, title string, description string")
    found = corpus.incidents_of_files(incidents, spark.createDataFrame([(x,) for x in ["a/AB.cs", "x.y", "b/x.y", "q.z", "none.cs"]], "file_path string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a/AB.cs"), (1, "a/AB.cs"), (1, "b/x.y"), (1, "x.y"), (2, "q.z")]


def test_graph_of_lines_is_read_and_dealt_once(spark, lines):
    whole = semantics.graph(semantics.operations(lines), lines.select("diff_id", "file_path").distinct())
    assert sorted(map(str, semantics.line_graph(lines).collect())) == sorted(map(str, whole.collect()))
    plan = catalog.QUERIES["patch_graph"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_more_items_take_more_tasks(spark, monkeypatch):
    """What one task sorts is bounded by the number of its items, not by that of shuffle partitions."""
    monkeypatch.setattr(patch_queries, "ITEMS_AT_ONCE", 100)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name in ["patch_operations", "risky_operations", "counterfactuals"]:
        assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
