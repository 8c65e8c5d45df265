"""Text functions: stated inputs and their answers."""

import pytest
from pyspark.sql import functions as F
from riskloom.functions import paths, text
from riskloom.operators import corpus, enrich

CASES = {}


def _expected(name, kind, cases, function):
    CASES[name] = (cases, function, kind)


@pytest.fixture(scope="session", autouse=True)
def _cases(spark):
    _expected("duration_minutes", "BIGINT", [("24h", 1440), ("7d", 10080), ("30m", 30), ("2W", 20160), ("", 1440), (None, 1440), ("h", 1440), ("-3h", 1440), ("5y", 1440), ("xh", 1440)], text.duration_minutes)
    _expected("percent_text", "VARCHAR", [("0.125", "12%"), ("0.135", "14%"), ("1", "100%"), ("0", "0%"), ("0.005", "0%")], lambda x: text.percent(x.cast("decimal(10,4)")))
    _expected("issue_keys", "VARCHAR", [("feature/ABC-12 eng-3 #4", "ABC-12 Jira"), ("eng-123 and #4", "eng-123 Linear"), ("fixes #42", "42 GitHub"), ("GH-7", "GH-7 Jira"), ("nothing", ""), (None, "")], lambda x: F.concat_ws(" ", text.issue_key(x)["key"], text.issue_key(x)["provider"]))
    _expected("evidence_snippet", "VARCHAR", [("Line 3: a.cs: var x = 1;", "var x = 1;"), ("no colons", "no colons"), ("one: two", "one: two"), ("a:b:c:d", "c:d")], lambda x: text.evidence_snippet(x))
    _expected("package_names", "VARCHAR", [('<PackageReference Include="Newtonsoft.Json" Version="1" />', "Newtonsoft.Json"), ('      "Serilog.Sinks": {', "Serilog.Sinks"), ("var x = 1;", None), ("", None)], text.package_name)
    _expected("rule_ids", "VARCHAR", [("gci42", "GCI0042"), ("GCI0007", "GCI0007"), ("3", "GCI0003"), ("rule 0016", "GCI0016")], text.rule_id)
    _expected("evidence_masks", "VARCHAR", [('key = "secret";', 'key = "***";'), ("no text", "no text"), ('a("x", "y")', 'a("***", "***")')], text.masked)
    _expected("diagnostic_rules", "VARCHAR", [("CA2100", "GCI0012"), ("CA1062", "GCI0006"), ("CA1822", "GCI0008"), ("CA9999", None)], text.diagnostic_rule)
    _expected("target_frameworks", "VARCHAR", [("<TargetFramework>net8.0</TargetFramework>", "net8.0 true"), ("<TargetFrameworks>net6.0;net8.0</TargetFrameworks>", "net6.0 false"), ("<TargetFramework>netstandard2.0</TargetFramework>", "netstandard2.0 false"), ("<Project/>", "false"), ("<TargetFramework>net10.0</TargetFramework>", "net10.0 true")], lambda x: F.concat_ws(" ", text.target_framework(x)["framework"], text.target_framework(x)["modern"].cast("string")))
    _expected("token_lists", "VARCHAR", [("GCI_SYN_AGG;GCI0001", "GCI0001 1"), ("GCI0001; GCI0002", "GCI0001; GCI0002 2"), ("GCI_SYN_AGG", " 0"), ("", " 0")], lambda x: F.concat(text.without_token(x, "GCI_SYN_AGG")["items"], F.lit(" "), text.without_token(x, "GCI_SYN_AGG")["n"].cast("string")))
    _expected("label_replies", "VARCHAR", [('{"should_trigger": true, "confidence": 0.9, "reason": "r"}', "true 0.9 false"), ('```json\n{"should_trigger": false, "confidence": 0.3, "reason": "r"}\n```', "false 0.3 true"), ('{"should_trigger": true}', ""), ("nonsense", ""), (None, "")], lambda x: F.concat_ws(" ", *[text.label_of_reply(x)[f].cast("string") for f in ("should_trigger", "confidence", "is_inconclusive")]))
    _expected("diff_tags", "VARCHAR", [("+await LoadAsync();", "async"), ("+public interface IFoo", "contract-change"), ("+if (x == null) return 1; // new List<int>", "early-return,null-safety,state-mutation"), ("+_logger.Info(e); catch (Exception)", "exception-flow,logging"), ("", "")], lambda x: F.array_join(text.tags(x), ","))
    _expected("polarity_flips", "BOOLEAN", [("IsA(x)|!IsA(x)", 1), ("a == false|a", 1), ("Check(x, y: false)|Check(x, y: true)", 1), ("IsA(x)|IsA(y)", 0), ("a != true|!a", 0)], lambda x: text.is_polarity_flip(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)))
    _expected("predicate_symbols", "VARCHAR", [("IsReady && Load(x)", "IsReady,Load("), ("Is(x) || IsOk(y)", "IsOk,Is(,IsOk("), ("a > b", "")], lambda x: F.array_join(text.predicate_symbols(x), ","))
    _expected("severity_settings", "INT", [("block|error", 3), ("|warning", 2), ("|suggestion", 1), ("none|error", 0), ("|", 1), ("bad|bad", 1)], lambda x: text.severity_setting(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1), F.lit(1)))


NAMES = ["duration_minutes", "percent_text", "issue_keys", "evidence_snippet", "package_names", "rule_ids", "evidence_masks", "diagnostic_rules", "target_frameworks", "token_lists", "label_replies", "diff_tags", "polarity_flips", "predicate_symbols", "severity_settings"]


@pytest.mark.parametrize("name", NAMES)
def test_stated_cases(spark, name):
    cases, function, kind = CASES[name]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "id int, x string").select("id", function(F.col("x")).alias("answer")).orderBy("id").collect()
    assert [r.answer for r in rows] == [bool(a) if kind == "BOOLEAN" else a for _, a in cases]


_PATHS = [
    # path, test, generated, infrastructure, security: the expected answers
    ("src/Latest.cs", False, False, False, False), ("src/Contest.cs", False, False, False, False), ("fixtures/A.cs", False, False, False, False), ("src/TestHelpers.cs", True, False, False, False),
    ("src/IntegrationTests/A.cs", True, False, False, False), ("test-utils/A.cs", True, False, False, False), ("examples/A.cs", True, False, False, False), ("fakes/A.cs", True, False, False, False),
    ("My.Benchmarks/A.cs", True, False, False, False), ("latest/A.cs", False, False, False, False), ("a_test/B.cs", True, False, False, False), ("spec/B.cs", True, False, False, False),
    ("src/FooTests.cs", True, False, False, False), ("src/Foo.spec", False, False, False, False), ("src/FooSpec.ts", True, False, False, False), ("src\\Tests\\A.cs", True, False, False, False), ("src/protest.cs", False, False, False, False),
    ("Generated/A.cs", False, False, False, False), ("src/Generated/A.cs", False, True, False, False), ("src/obj/A.cs", False, True, False, False), ("src/A.g.cs", False, True, False, False), ("src/A.g.i.cs", False, True, False, False),
    ("src/F.Designer.cs", False, True, False, False), ("src/AssemblyInfo.cs", False, True, False, False), ("src/MyAssemblyInfo.cs", False, False, False, False), ("src/x.net8.0.cs", False, True, False, False), ("src/x.netstandard2.0.cs", False, True, False, False),
    ("src/Program.cs", False, False, True, False), ("src/startup.cs", False, False, True, False), ("src/FooExtensions.cs", False, False, True, False), ("src/ServiceCollectionX/A.cs", False, False, True, False), ("src/Kestrel/A.cs", False, False, False, True), ("src/Tokens.cs", False, False, False, True),
]


def test_path_predicates(spark):
    p = F.col("path")
    rows = spark.createDataFrame([(x[0],) for x in _PATHS], "path string").select("path", paths.is_test_file(p), paths.is_generated_file(p), paths.is_infrastructure_file(p), paths.is_security_critical(p)).collect()
    assert [tuple(r) for r in rows] == _PATHS


_COMMENTS = [
    (1, "This has a race condition, and a deadlock"), (2, "NullReferenceException here? memory leak"), (3, "please add a test, regression risk"), (4, "db schema changed; uses .Result"), (5, "hard-coded value, linq in loop"),
    (6, "all fine"), (7, ""), (8, None), (9, "PII in logs; SQL injection; semver"), (10, "use epsilon for float equality"), (11, "uncaught error"),
]


def test_comments(spark):
    """The first keyword of each rule, case ignored; texts without one, empty and null texts give none."""
    df = spark.createDataFrame(_COMMENTS, "id int, t string")
    for taxonomy in (enrich.TAXONOMY, corpus.COMMENT_RULES):
        want = set()
        for k, t in _COMMENTS:
            seen = set()
            for rule, words, sure in taxonomy:
                word = next((w for w in words if w in (t or "").lower()), None)
                if word and rule not in seen:
                    seen.add(rule)
                    want.add((k, rule, word, sure))
        assert {(r.id, r.rule_id, r.keyword, r.confidence) for r in enrich.taxonomy_hits(df, "id", F.col("t"), taxonomy).collect()} == want


def test_strategies(spark):
    rows = [(1, "var x = LoadAsync().Result;"), (1, "var y = m.Value;"), (2, "var h = MD5.Create();"), (2, "throw new ArgumentNullException();"), (3, "throw new WidgetException();"), (3, "INSERT IGNORE INTO t"), (4, "plain"), (5, "a!.b();")]
    found = sorted((r.id, r.rule_id) for r in corpus.strategy_labels(spark.createDataFrame(rows, "id int, text string"), "id").collect())
    assert found == [(1, "GCI0006"), (1, "GCI0016"), (2, "GCI0012"), (3, "GCI0015"), (3, "GCI0032"), (5, "GCI0043")]


def test_annotations_are_grouped(spark):
    """One command for each rule and file: the first finding's level, all lines, each evidence once; marks escaped in titles."""
    from riskloom.sources import reports

    rows = [
        (0, 1, "G1", "A: b, 100%", "one\ntwo", 2, "a.cs", 9, "e1"), (0, 2, "G1", "A: b, 100%", "later", 0, "a.cs", 3, "e\r\n2"), (0, 3, "G1", "A: b, 100%", "later", 0, "a.cs", 3, "e1"), (0, 4, "G1", "A", "s", 1, "b.cs", None, " "),
        (1, 1, "G2", "T", "m", 0, None, 4, None),
    ]
    df = spark.createDataFrame(rows, "diff_id long, ord int, rule_id string, rule_name string, summary string, confidence int, file_path string, line int, evidence string")
    assert sorted(r.command for r in reports.annotations(df).collect()) == [
        "::error file=a.cs,line=3,title=G1 A%3A b%2C 100%25::one%0Atwo%0ALines: 3, 9%0AEvidence:%0A  - e1%0A  - e%0A2", "::notice title=G2 T::m", "::warning file=b.cs,line=1,title=G1 A::s",
    ]


def test_report_rows(spark):
    from riskloom.sources import reports

    rows = spark.createDataFrame([("gold", "A", 0.125, 1.0, 0.0), ("silver", "B", 1 / 3, 0.5, 2 / 3)], "tier string, rule_id string, trigger_rate double, precision double, recall double")
    assert [r.row for r in reports.markdown_scorecard(rows).collect()] == ["| A | 12.5% | 100.0% | 0.0% |", "| B | 33.3% | 50.0% | 66.7% |"]
    rows = spark.createDataFrame([(0, "A", "a<b>.cs", 3, "x & y"), (1, "B", None, None, None)], "diff_id long, rule_id string, file_path string, line int, evidence string")
    assert [r.row for r in reports.html_rows(rows).collect()] == ["<tr><td>A</td><td>a&lt;b&gt;.cs</td><td>3</td><td>x &amp; y</td></tr>", "<tr><td>B</td><td></td><td></td><td></td></tr>"]


def test_light_parser(spark):
    from riskloom.operators import semantics

    texts = [(0, "diff --git a/x.cs b/x.cs\n--- a/x.cs\n+++ b/x.cs\n@@ -1 +1 @@\n-a\n+b\n c\n+d\ndiff --git a/y.md b/y.md\n--- a/y.md\n+++ b/y.md\n+e"), (1, "--- a/z.cs\n+++ /dev/null\n-gone"), (2, "")]
    df = spark.createDataFrame(texts, "diff_id long, raw_diff string")
    counts = {(r.diff_id, r.kind): r["count"] for r in semantics.light_lines(df).groupBy("diff_id", "kind").count().collect()}
    assert counts == {(0, "header"): 6, (0, "added"): 3, (0, "removed"): 1, (1, "header"): 2, (1, "removed"): 1}
    assert [tuple(r) for r in semantics.changed_sources(df).collect()] == [(0, "x.cs")]
    assert sorted(tuple(r) for r in semantics.added_text(df).collect()) == [(0, "x.cs", "b\nd"), (0, "y.md", "e")]
    assert [len(r.slice or "") for r in semantics.file_slice(df, "x.cs", 40).orderBy("diff_id").collect()] == [40, 0, 0]


def test_rule_cases(spark):
    """Each stated case fires its rule, and its counterpart doesn't."""
    from riskloom.operators import rules
    from riskloom.plans.patch_queries import _ASKED, CASES, patch

    texts = [(2 * k + i, patch(*lines[2 * i : 2 * i + 2], path)) for k, (_, _, *lines, path) in enumerate(CASES) for i in (0, 1)]
    found = {(r.diff_id, r.rule_id, r.check) for r in rules.evaluate(spark.createDataFrame(texts, "diff_id long, raw_diff string")).collect()}
    assert [x[:3] for x in _ASKED if (x[:3] in found) != bool(x[3])] == []
