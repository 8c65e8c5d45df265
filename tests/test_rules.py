"""Rules that need scopes, balanced arguments or the symbols of a whole diff."""

import pytest
from conftest import SF
from riskloom.operators import rules
from riskloom.plans import catalog


def patch(*hunks, path="src/Svc.cs"):
    """Hunks of lines that begin with +, - or a space."""
    body = "".join(f"@@ -{100 * k + 1},9 +{100 * k + 1},9 @@\n" + "".join(f"{x}\n" for x in h) for k, h in enumerate(hunks))
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n{body}"


def added(*lines, path="src/Svc.cs"):
    return patch([f"+{x}" for x in lines], path=path)


GETTER = ["int Total {", "  get {", "    {0}", "    return 1;", "  }", "}"]
getter = lambda *inner: added(*GETTER[:2], *inner, *GETTER[3:])
run = ["x.A = r.A;", "x.B = r.B;", "x.C = r.C;", "Save(x);"]
#: name: (rule and check, diffs that must fire it, diffs that must not).
CASES = {
    "0036 getter": (("GCI0036", "mutation in a pure context"), [
        getter("total = 5;"), getter("this.total += 5;"), getter("_cache = Make();"), added("[Pure]", "public int Get() {", "  total = 5;", "}"), added("int Total", "{", " get", " {", "  total = 5;", " }", "}"),
    ], [
        getter("if (total == null)", "  total = Make();"), getter("int local = 0;", "local = 5;"), getter("var total = 5;"), getter("if (total == 5) Go();"), getter("for (i = 0; i < 3; i++) { }"),
        added("int Total {", "  get { return 1; }", "  set { total = 5; }", "}"), added("void Run() {", "  total = 5;", "}"), added("int Total { get; set; }", "total = 5;"), patch([" int X {", "  get {", "-    total = 5;", "   }", " }"]),
        added("int Total {", "  get {", "    total = 5;", "  }", "}", path="tests/SvcTests.cs"),
    ]),
    "0015 unsafe binding": (("GCI0015", "unsafe http input binding"), [added("Use(Request.Form);", *run)], [
        added(*run), added("Use(Request.Form);", *run[:2], "Save(x);"), added("Use(Request.Form);", *run[:3]), added("Use(Request.Form);", "mapper.Map<X>(r);", *run), added("Use(Request.Form);", "x.A = r.A;", "x.B = r.B;", "Go();", "x.C = r.C;", "Go();"),
    ]),
    "0015 mass assignment": (("GCI0015", "mass assignment"), [added("Use(Request.Form);", "Go();", "Go();", *run), added("Use(Request.Form);", "if (r == null) return;", "Go();", "Go();", *run)], [
        added("Use(Request.Form);", "if (r == null) return;", "Go();", *run), added("Use(Request.Form);", "x.A = r.A;", "x.B = null;", "x.C = r.C;", "Save(x);"),
    ]),
    "0003 crypto": (("GCI0003", "cryptographic arguments changed"), [
        patch(["-var h = ComputeHash(text);", "+var h = ComputeHash(text + salt);"]), patch(["-var h = Encrypt(", "-  key,", "-  f(text));", "+var h = Encrypt(", "+  key,", "+  f(other));"]), patch(['-Sign("(", a);', '+Sign("(", b);']),
    ], [
        patch(["-var h = ComputeHash(text);", "+var hash = ComputeHash(text);"]), patch(["-Sign(a);", "+Sign(a); // Sign(b)"]),
        patch(["-Encrypt(a);", "+Decrypt(b);"]), patch(["-Encrypt(a", "+Encrypt(b"]), patch(["-Encrypt(a);", "+Encrypt(b);"], path="tests/SvcTests.cs"),
    ]),
    "0021 enum member": (("GCI0021", "enum member removed"), [patch([" enum Kind {", '-  [EnumMember(Value = "a")]', "-  A,", "   B", " }"]), patch([" enum Kind", " {", "-  [EnumMember]", "-  // old", "-  A = 1,", " }"])], [
        patch([" enum Kind {", "-  A,", "   B", " }"]), patch([" enum Kind {", "-  [EnumMember]", "-  A,", "+  [EnumMember]", "+  A = 2,", " }"]), patch([" class Kind {", "-  [EnumMember]", "-  A,", " }"]),
        patch([" enum Kind {", "-  [EnumMember]", "   Z,", "-  A,", " }"]), patch([" enum Kind { One }", "-  [EnumMember]", "-  A,"]),
    ]),
    "0032 empty catch": (("GCI0032", "empty catch blocks"), [added("try { Go(); }", "catch { }"), added("catch (Exception ex)", "{", "  // nothing", "}"), added("} catch (Exception ex) { /* fine */ }")], [
        added("catch (Exception ex)", "{", "  Log(ex);", "}"), added("catch { throw; }", "Go();"), added("catch { }", path="src/SvcTests.cs"), added("catch { }", "var m = new Mock<X>();"), added("var catcher = 1; {", "}"),
    ]),
    "0045 interface": (("GCI0045", "single-use interface"), [added("interface IFoo {", "}", "class Foo : IFoo {", "}"), added("public interface IFoo { }"), added("interface IFoo {", "}") + added("class A : IBar", path="src/B.cs")], [
        added("interface IFoo {", "}", "class Foo : IFoo {") + added("class Bar : Base, IFoo {", path="src/Bar.cs"), added("interface IFoo {", path="tests/FooTests.cs"), patch([" interface IFoo {", "+}"]),
    ]),
    "0046 pair": (("GCI0046", "mixed sync and async"), [added("public Task LoadAsync()", "public int Load()"), patch([" public int Load()", "+public Task LoadAsync()"]), patch([" public async Task LoadAsync()", "+public int Load()"])], [
        added("public Task LoadAsync()"), added("public Task OpenAsync()", "public int Open()"), patch([" public int Load()", " public Task LoadAsync()", "+int x;"]), added("public Task LoadAsync()", "public int Load()", path="tests/LoadTests.cs"), patch(["-public int Load()", "+public Task LoadAsync()"]),
    ]),
    "0046 locator": (("GCI0046", "service locator outside set-up"), [added("var s = sp.GetService<IFoo>();"), added("x = container.Resolve(y);")], [added('var p = ".GetService<";'), added("var s = sp.GetService<IFoo>();", path="src/Startup.cs"), patch([" var s = sp.GetService<IFoo>();", "+int a;"])]),
    "0021 attribute": (("GCI0021", "serialisation attribute removed"), [patch(["-  [JsonIgnore]"]), patch(["-[precision(18, 2)]"])], [patch(["-  x[Key] = 1;"]), patch(["+  [JsonIgnore]"]), patch(["-[Column(1)]"], path="src/Startup.cs")]),
    "0016 in literals": (("GCI0016", "lock on this"), [added("lock (this) {"), patch(["+/* a", "+b */ lock(this) {"])], [patch(["+/* a", "+lock(this) {", "+*/"]), patch(['+var s = @"', "+lock(this) {", '+";']), patch(['+var s = """', "+lock(this) {", '+""";'])]),
}


@pytest.fixture(scope="module")
def found(spark):
    """(rule, check) of every case's diffs, through one plan."""
    texts = [t for _, yes, no in CASES.values() for t in (*yes, *no)]
    out = [set() for _ in texts]
    for r in rules.evaluate(spark.createDataFrame(list(enumerate(texts)), "diff_id long, raw_diff string")).collect():
        out[r.diff_id].add((r.rule_id, r.check))
    return dict(zip(texts, out, strict=False)) if len(set(texts)) == len(texts) else {t: o for t, o in zip(texts, out, strict=True)}


@pytest.mark.parametrize("name", CASES)
def test_fires_and_is_silent(found, name):
    expected, yes, no = CASES[name]
    assert [t for t in yes if expected not in found[t]] == [] and [t for t in no if expected in found[t]] == []


def test_layers(spark):
    """A forbidden import of a layer, case ignored; silent without layers, in other layers and beside mocks."""
    texts = [added("using App.Data.Sql;", path="src/Web/A.cs"), added("using app.data.sql;", path="src/web/a.cs"), added("using App.Core;", path="src/Web/A.cs"), added("using App.Data.Sql;", path="src/Jobs/A.cs"), added("using App.Data.Sql;", "new Mock<X>();", path="src/Web/A.cs"), patch([" using App.Data.Sql;", "+int a;"], path="src/Web/A.cs")]
    diffs = spark.createDataFrame(list(enumerate(texts)), "diff_id long, raw_diff string")
    layers = {"/Web/": [".Data."], "/Core/": ["Web", ".Data."]}
    assert sorted((r.diff_id, r.line) for r in rules.evaluate(diffs, layers).filter("rule_id = 'GCI0035'").collect()) == [(0, 1), (1, 1)]
    assert rules.evaluate(diffs).filter("rule_id = 'GCI0035'").count() == 0


def test_allowed_pairs(spark):
    diffs = spark.createDataFrame([(0, added("public Task LoadAsync()", "public int Load()"))], "diff_id long, raw_diff string")
    assert rules.evaluate(diffs, allowed_pairs=["Load"]).filter("rule_id = 'GCI0046'").count() == 0


def test_evidence(spark):
    text = patch(["-var h = Encrypt(", "-  key,", "-  f(a));", "+var h = Encrypt(", "+  key,", "+  f(b));"])
    rows = rules.evaluate(spark.createDataFrame([(0, text)], "diff_id long, raw_diff string")).filter("check like 'crypto%'").collect()
    assert [(r.confidence, r.line, r.evidence) for r in rows] == [(2, None, "Encrypt: key, f(a) | key, f(b)")]


def test_lines_do_not_carry_their_file(spark):
    """What a file gathers stands once: no window of the plan lists the lines of a file."""
    plan = catalog.QUERIES["rule_findings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    whole = "specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())"
    assert not [line for line in plan.splitlines() if "Window [collect" in line and whole in line]


def test_code_tree_feeds_all_rules(spark, tmp_path):
    """Whole files go through line, frame, file and diff rules."""
    from riskloom.sources import stores

    (tmp_path / "A.cs").write_text("\n".join(["var h = MD5.Create();", *GETTER[:2], "total = 5;", *GETTER[3:], "interface IFoo { }"]))
    found = {(r.rule_id, r.check) for r in rules.evaluate_tree(stores.code_tree(spark, str(tmp_path))).collect()}
    assert {("GCI0012", "weak hash"), ("GCI0036", "mutation in a pure context"), ("GCI0045", "single-use interface")} <= found


def test_more_documents_take_more_tasks(spark, monkeypatch):
    """Whole texts are dealt once, by as many tasks as there are documents for, and cut into lines where they lie."""
    monkeypatch.setattr(catalog, "DOCS_AT_ONCE", 10)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ["rule_findings", "flagship"]:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and f", {-(-n // 10)}), REPARTITION_BY_NUM" in plan


#: Groups of words and the terms of tests that ask for them.
ASKED = {
    "linq": rules.LINQ, "cipher": rules.WEAK_CIPHERS, "hash": rules.WEAK_HASHES, "log": rules.LOG_PREFIXES, "locator": rules.SERVICE_LOCATORS, "silenced": rules.TEST_SILENCERS, "authority": rules.AUTHORITY_HOSTS, "located": rules.LOCATOR_CALLS,
    "cancellable": rules.CANCELLABLE_CALLS, "stub": rules.STUBS, "timeout": rules.TIMEOUTS, "cleanup": rules.CLEANUPS, "error": rules.ERROR_LOGS, "limit": rules.ITERATION_LIMITS, "resource": rules.RESOURCE_LIMITS, "input": rules.HTTP_INPUT,
    "mock": rules.MOCKS, "crypto": rules.CRYPTO_METHODS, "disposable": rules.DISPOSABLES, "quote": rules.SQL_STARTS,
}


@pytest.mark.parametrize("name", ASKED)
def test_words_stand_in_each_term(name):
    assert [t for t in ASKED[name] if not any(w.lower() in t.lower() for w in rules.SAYS[name])] == []


def test_words_of_diffs_change_no_finding(spark, monkeypatch):
    """With every test made on every line, the findings are the same; lines of diffs without the words are not tested."""
    from riskloom.plans import patch_queries

    texts = [t for _, yes, no in CASES.values() for t in (*yes, *no)]
    texts += [patch_queries.patch(*lines[2 * i : 2 * i + 2], path) for _, _, *lines, path in patch_queries.CASES for i in (0, 1)]
    diffs = spark.createDataFrame(list(enumerate(texts)), "diff_id long, raw_diff string")
    gated = sorted(map(str, rules.evaluate(diffs).collect()))
    plain = spark.range(1).select(rules._said(rules.F.lit("// nothing to see")).alias("said")).first().said
    assert plain == 0
    monkeypatch.setattr(rules, "_said", lambda text: rules.F.lit(-1).cast("long"))
    assert gated == sorted(map(str, rules.evaluate(diffs).collect())) and len(gated) > 50
