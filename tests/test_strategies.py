"""What changes say for rules: stated cases."""

import pytest
from riskloom.operators import labels, strategies


def _diff(path, *lines, new=None):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ {'b/' + path if new is None else new}\n@@ -1,9 +1,9 @@\n" + "\n".join(lines)


_MIGRATION = "src/Migrations/20240101000000_Add.cs"
#: A change, and the rules that it bears out.
CASES = [
    (_diff("src/A.cs", "+var x = LoadAsync().Result;"), {"GCI0016"}), (_diff("src/A.cs", "+var x = response.Result;"), set()), (_diff("src/A.cs", "+task.Wait(1000, CancellationToken.None);"), {"GCI0016"}),
    (_diff("src/A.cs", "+public async void Run()"), {"GCI0016"}), (_diff("src/A.cs", "+async void OnClick(object sender, EventArgs e)"), set()), (_diff("src/A.cs", "+lock (this) {"), {"GCI0016"}),
    (_diff("src/A.cs", "+Thread.Sleep(5);"), {"GCI0016"}), (_diff("src/ATests.cs", "+Thread.Sleep(5);"), set()), (_diff("src/A.cs", "+  // Thread.Sleep(5);"), set()), (_diff("src/A.cs", "-x.Wait();"), set()),
    # signatures: gone and new, in production
    (_diff("src/A.cs", "-public int Get(int a)", "+public int Get(long a)"), {"GCI0003"}), (_diff("src/A.cs", "-public int Get(int a)"), set()), (_diff("tests/A.cs", "-public int Get(int a)", "+public int Get(long a)"), set()),
    (_diff("samples/A.cs", "-\tinternal int Get(int a)", "+public int Get(long a)"), set()), (_diff("src/A.cs", "-\tinternal int Get(int a)", "+\tprotected int Get(long a)"), {"GCI0003"}),
    # schema: attributes, and operations of migrations by the old path
    (_diff("src/A.cs", '-  [jsonproperty("x")]'), {"GCI0021"}), (_diff(_MIGRATION, '-migrationBuilder.DropColumn("a");'), {"GCI0021"}), (_diff(_MIGRATION, "+x", " y"), set()), (_diff("src/Migrations/Add.cs", '-migrationBuilder.DropColumn("a");'), set()),
    (_diff("src/Migrations/20240101_Add.cs", "-MIGRATIONBUILDER.CreateTable("), {"GCI0021"}),
    # cleanup, repeats and tests that go; a file deleted whole has no production lines
    (_diff("src/A.cs", "-using (var s = Open())"), {"GCI0024"}), (_diff("src/A.cs", "-  ~A() { }"), {"GCI0024"}), (_diff("src/A.cs", "-s.Dispose();", new="/dev/null"), set()), (_diff("src/A.cs", "-var idempotencyKey = k;"), {"GCI0022"}),
    (_diff("tests/A.cs", "-    [Fact]"), {"GCI0041"}), (_diff("x.txt", "-Assert.Equal(1, n);"), {"GCI0041"}),
    # layers, loops, hot paths, stubs
    (_diff("src/A.cs", "+class UserView { UserService s; }"), {"GCI0035"}), (_diff("src/A.cs", "+// UserView UserService"), set()), (_diff("src/A.cs", "+foreach (var a in b)", "+c.Where(d);"), {"GCI0044"}), (_diff("src/A.cs", "+c.Where(d);"), set()),
    (_diff("src/OrderHandler.cs", "+var a = new List<int>();"), {"GCI0044"}), (_diff("src/A.cs", "+var a = new List<int>();"), set()), (_diff("src/A.cs", "+throw new NotImplementedException();"), {"GCI0042"}), (_diff("src/A.cs", "+// TODO Implement"), {"GCI0042"}),
    # nulls
    (_diff("src/A.cs", "+a = null;"), {"GCI0006"}), (_diff("src/A.cs", "+string? a = null;"), set()), (_diff("src/A.cs", "-if (a != null)"), {"GCI0006"}), (_diff("src/A.cs", "+a!.b();"), {"GCI0043"}), (_diff("src/A.g.cs", "-a!.b();"), set()), (_diff("src/A.cs", "+#pragma warning disable CS8600"), {"GCI0043"}),
    # secrets, hashes, queries, in production only
    (_diff("src/A.cs", '+var password = "hunter2";'), {"GCI0012"}), (_diff("src/A.cs", "+var password = Get();"), set()), (_diff("src/A.cs", "+var password ="), set()), (_diff("tests/A.cs", '+var password = "hunter2";'), set()), (_diff("src/A.cs", "+MD5.Create();"), {"GCI0012"}),
    (_diff("src/A.cs", '+var q = "select a" + b;'), {"GCI0012"}), (_diff("src/A.cs", '+var q = $"delete from t where {x}";'), {"GCI0012"}), (_diff("src/A.cs", '+var q = "selection" + b;'), set()),
    # two files: a line belongs to its own
    (_diff("tests/A.cs", "+x") + "\n" + _diff("src/B.cs", "+MD5.Create();"), {"GCI0012"}), (_diff("src/B.cs", "+x") + "\n" + _diff("tests/A.cs", "+MD5.Create();"), set()),
    ("", set()), (None, set()), ("+no path: MD5.Create();", set()), (_diff("src/A.cs", "+x.Wait();").replace("\n", "\r\n"), {"GCI0016"}),
]


def test_strategies(spark):
    df = spark.createDataFrame([(k, d) for k, (d, _) in enumerate(CASES)], "diff_id int, raw_diff string")
    found = {}
    for r in strategies.diff_strategies(df).collect():
        found.setdefault(r.diff_id, set()).add(r.rule_id)
        assert r.confidence == strategies.CONFIDENCE[r.rule_id]
    wrong = {d: (found.get(k, set()), want) for k, (d, want) in enumerate(CASES) if found.get(k, set()) != want}
    assert not wrong
    assert strategies.diff_strategies(df.limit(0)).count() == 0


@pytest.mark.parametrize("path,want", [("src/A.cs", True), ("a/test/A.cs", False), ("My.Tests/A.cs", False), ("tests.core/A.cs", False), ("src/Latest.cs", False), ("obj/A.cs", True), ("x/obj/A.cs", False), ("a/My.Benchmarks/A.cs", False), ("src/sample.cs", True), ("A.txt", False), ("src/AssemblyInfo.cs", False)])
def test_production_paths(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(strategies.is_production_source(df.p).alias("x")).first().x is want


def test_one_exchange(spark):
    plan = strategies.diff_strategies(spark.createDataFrame([(1, "x")], "diff_id int, raw_diff string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_labels_of_a_change(spark):
    """From diffs to settled labels: blocking calls beside a stub, in one fixture."""
    df = spark.createDataFrame([(1, _diff("src/A.cs", "+x.Wait();", "+c.Where(d); foreach"))], "diff_id int, raw_diff string")
    none = spark.createDataFrame([], "diff_id int, rule_id string, file_path string")
    out = labels.infer(df.select("diff_id"), strategies.diff_strategies(df), none, none.drop("rule_id"), "diff_id")
    assert {(r.rule_id, r.confidence) for r in out.collect() if r.should_trigger} == {("GCI0016", 0.65), ("GCI0044", 0.75)}
    assert out.count() == len(labels.OF_STRATEGIES)
