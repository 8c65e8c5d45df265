"""Readers of files, exports and settings, reports that are written, and plans that must keep their shape."""

import gzip
import json
import subprocess

import pytest
from conftest import SF
from pyspark.sql import functions as F
from riskloom.operators import corpus, delivery, rules
from riskloom.plans import catalog
from riskloom.sources import reports, stores
from riskloom.streaming import logs


def test_git_modes(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "A.cs").write_text("one\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "A.cs").write_text("one\ntwo\n")
    git("commit", "-qam", "second change")
    row = stores.diffs_from_git(spark, str(tmp_path), "HEAD").first()
    assert "+two" in row.raw_diff and row.commit_message == "second change"
    (tmp_path / "A.cs").write_text("one\ntwo\nthree\n")
    diff = lambda mode: stores.diffs_from_git(spark, str(tmp_path), mode).first()
    assert "+three" in diff("unstaged").raw_diff and diff("staged").raw_diff == "" and diff("all-changes").commit_message is None
    git("add", ".")
    assert "+three" in diff("staged").raw_diff and diff("unstaged").raw_diff == ""
    assert rules.context(stores.diffs_from_text(spark, diff("staged").raw_diff)).filter("kind = 'added'").count() == 1


def test_code_tree_feeds_the_rules(spark, tmp_path):
    (tmp_path / "obj").mkdir()
    (tmp_path / "obj" / "B.cs").write_text("x")
    (tmp_path / "A.cs").write_text("var h = MD5.Create();\r\nint a;")
    (tmp_path / "ATests.cs").write_text("int b;")
    lines = stores.code_tree(spark, str(tmp_path))
    assert lines.count() == 3 and lines.filter("is_test").count() == 1 and lines.select("diff_id").distinct().count() == 2
    assert [r.check for r in rules.line_rules(lines).collect()] == ["weak hash"]
    row = stores.scan_estimate(spark, str(tmp_path)).first()
    assert (row.files, row.loc, row.seconds) == (2, 3, 1.0)


def test_exports(spark, tmp_path):
    (tmp_path / "expected.json").write_text(json.dumps([{"Rule_Id": "GCI0001", "should_trigger": True}]))
    assert [r.rule_id for r in stores.documents(spark, str(tmp_path / "expected.json"), "rule_id string, should_trigger boolean").collect()] == ["GCI0001"]
    assert stores.documents(spark, str(tmp_path / "none.json"), "a int").count() == 0
    event = lambda n, merged, repo="a/b": {"type": "PullRequestEvent", "repo": {"name": repo}, "payload": {"pull_request": {"number": n, "merged": merged, "language": "C#"}}, "created_at": "2026-01-01T00:00:00Z"}
    with gzip.open(tmp_path / "2026-01-01-0.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, [event(1, True), event(1, True), event(2, False), event(3, True, "Bad/Repo"), {"type": "PushEvent"}])) + "\nbroken\n")
    found = stores.archive_candidates(spark, str(tmp_path / "2026-01-01-0.json.gz"), "c#", ("bad/repo",)).collect()
    assert [(r.repo, r.number) for r in found] == [("a/b", 1)]
    slots = stores.hour_slots(spark, "2026-01-01", "2026-01-02").collect()
    assert len(slots) == 48 and slots[-1].slot == "2026-01-02-23"
    (tmp_path / "incidents.json").write_text(json.dumps([{"id": str(k), "title": "t", "created_at": f"2026-01-0{k}T00:00:00Z"} for k in (1, 2, 3)]))
    assert [r.id for r in stores.incidents(spark, str(tmp_path / "incidents.json"), "2026-01-02", "2026-01-02 12:00:00").collect()] == ["2"]
    (tmp_path / "alerts.json").write_text(json.dumps([{"tool": "s", "key": "k", "path": "a"}, {"tool": "s", "key": "k", "path": "a"}, {"tool": "s", "key": "m"}]))
    assert stores.alerts(spark, str(tmp_path / "alerts.json")).count() == 1
    records = spark.createDataFrame([("o", "r", 1, "pr"), ("o", "r", 1, "pr"), ("o", "r", 1, "issue")], "owner string, repo string, number int, type string")
    assert sorted(r.record for r in stores.maintainer_records(records).collect()) == ["o/r#1:issue", "o/r#1:pr"]


def test_settings():
    assert stores.ignore_entries("# all\nGCI0001\n\nGCI0002:src/**  # why\n") == ["GCI0001", "GCI0002:src/**"]
    assert stores.editor_severities("[*.cs]\ndotnet_diagnostic.gci0001.severity = Error\nindent = 2") == {"GCI0001": "error"}
    assert stores.settings('// c\n{"rules": {"gci0003": {"severity": "Warn"}, "gci0004": {}}}') == {"GCI0003": "Warn"} and stores.settings("nonsense") == {}


def test_stage_order():
    assert corpus.stage_order({"c": ["a", "b"], "a": [], "b": ["a"]}) == ["a", "b", "c"]
    for bad in ({"a": ["b"], "b": ["a"]}, {"a": ["x"]}):
        with pytest.raises(ValueError):
            corpus.stage_order(bad)


def test_enrichment_runs_in_order(spark):
    df = spark.createDataFrame([(1,)], "x int")
    out = corpus.enrich_findings(df, {"b": (["a"], lambda d: d.withColumn("z", F.col("y") + 1)), "a": ([], lambda d: d.withColumn("y", F.col("x") + 1))})
    assert out.first().z == 3


def test_boosts_come_before_the_cap(spark):
    """Six findings of a rule that another rule makes surer: with the boost first, the cap keeps the surest."""
    rows = [(1, "GCI0016", 2, 1, "b.cs", 1)] + [(1, "GCI0039", 2, 0, "a.cs", k) for k in range(6)] + [(1, "GCI0039", 2, 2, "a.cs", None)]
    found = spark.createDataFrame(rows, "diff_id int, rule_id string, severity int, confidence int, file_path string, line int").selectExpr("*", "'x' AS check", "'e' AS evidence")
    out = delivery.deliver(found).filter("rule_id = 'GCI0039'").collect()
    assert len(out) == 5 and {r.confidence for r in out} == {1}  # a finding with a line outranks a surer one without
    assert all(r.line is not None for r in out)


def test_relocated_lines_silence_findings(spark):
    rows = [(1, "GCI0016", "a.cs", 3), (1, "GCI0003", "a.cs", 3), (1, "GCI0016", "a.cs", 4), (1, "GCI0016", None, None)]
    found = spark.createDataFrame(rows, "diff_id int, rule_id string, file_path string, line int")
    gone = spark.createDataFrame([(1, "a.cs", 3), (1, "a.cs", 3), (1, None, None)], "diff_id int, file_path string, line int")
    left = sorted(map(str, (tuple(r) for r in delivery.drop_relocated(found, gone).collect())))
    assert len(left) == 3 and str((1, "GCI0016", "a.cs", 3)) not in left


def test_sarif(spark):
    rows = [(1, "GCI0016", 3, "a.cs", 3, "e"), (1, "GCI0001", 1, None, None, "f")]
    text = stores.sarif(spark.createDataFrame(rows, "diff_id int, rule_id string, severity int, file_path string, line int, evidence string")).first().sarif
    run = json.loads(text)["runs"][0]
    assert {r["ruleId"]: r["level"] for r in run["results"]} == {"GCI0016": "error", "GCI0001": "note"} and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["GCI0001", "GCI0016"]
    assert [bool(r.get("locations")) for r in sorted(run["results"], key=lambda r: r["ruleId"])] == [False, True]


def test_snapshots(spark, tmp_path):
    for k in (1, 2):
        reports.snapshot(spark.createDataFrame([("A", 0.5)], "rule_id string, precision double"), f"s{k}", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).select("snapshot_id").distinct().count() == 2


def test_rules_cut_and_deal_a_diff_once(spark):
    plan = catalog.QUERIES["rule_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("Generate ") == 3


def test_empty_and_null_diffs(spark):
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "diff_id long, raw_diff string")
    assert rules.evaluate(empty).count() == 0 and delivery.deliver(rules.evaluate(empty.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["distinct", "slots"])
def test_streams(spark, tmp_path, name):
    """Repeated events arrive once; slots close when the watermark passes them, and null times are in none."""
    rows = [(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:11:00", "a"), (2, "2024-01-01 00:20:00", "b"), (3, "2024-01-01 05:00:00", "a")]
    events = spark.createDataFrame(rows, "event_id long, at string, event_type string").selectExpr("event_id", "cast(at as timestamp) AS ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = logs.distinct_events(stream) if name == "distinct" else logs.hourly_slots(stream)
    q = out.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.table(f"out_{name}")
    if name == "distinct":
        assert sorted(r.event_id for r in found.collect()) == [1, 2, 3]
    else:
        assert sorted((r.event_type, r.n) for r in found.collect()) == [("a", 2), ("b", 1)]
