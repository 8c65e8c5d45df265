from pyspark.sql import functions as F
from riskloom.operators import enrich, scoring
from riskloom.sources import stores


def test_labelled_metrics_of_the_latest_completed_run(spark):
    runs = spark.createDataFrame([("r1", "f1", "2026-01-01", "Completed"), ("r2", "f1", "2026-02-01", "COMPLETED"), ("r3", "f1", "2026-03-01", "Failed"), ("r4", "f2", "2026-01-01", "completed")], "id string, fixture_id string, completed_at_utc string, status string")
    expected = spark.createDataFrame([("f1", "GCI0004", 1, 0), ("f2", "GCI0004", 0, 0), ("f2", "GCI0009", 1, 1)], "fixture_id string, rule_id string, should_trigger int, is_inconclusive int")
    actual = spark.createDataFrame([("f1", "r1", "GCI0004", 0), ("f1", "r2", "GCI0004", 1), ("f1", "r2", "GCI0004", 1), ("f2", "r4", "GCI0004", 1)], "fixture_id string, run_id string, rule_id string, did_trigger int")
    row = scoring.confusion_matrix(scoring.labelled_pairs(expected, runs, actual), "rule_id").collect()
    assert [(r.rule_id, r.labeled, r.tp, r.fp, r.fn, r.precision, r.recall) for r in row] == [("GCI0004", 2, 1, 1, 0, 0.5, 1.0)]


def test_entropy(spark):
    files = spark.createDataFrame([("one", "a", 3), ("two", "a", 2), ("two", "b", 2), *[("four", c, 1) for c in "abcd"]], "d string, f string, n int")
    found = {r.d: (r.entropy, r.normalised) for r in scoring.entropy(files, "d", "f", files.n).collect()}
    assert found == {"one": (0.0, 0.0), "two": (1.0, 1.0), "four": (2.0, 1.0)}


def test_enrichers(spark):
    df = spark.createDataFrame([("Fixes #12 and closes a/b#7, fixed #12",)], "t string")
    assert df.select(enrich.issue_references(df.t)).first()[0] == [7, 12]
    assert enrich.taxonomy_hits(spark.createDataFrame([(1, "A deadlock, null check missing"), (2, None)], "k int, t string"), "k", F.col("t")).count() == 2


def test_logs_and_reports(spark, tmp_path):
    (tmp_path / "log.ndjson").write_text('{"scan_id": "a", "finding_count": 0}\n\nbroken\n{"scan_id": "b", "findings": [{"rule_id": "GCI0001", "line": 3}]}\n')
    log = stores.audit_log(spark, str(tmp_path / "log.ndjson")).filter("scan_id is not null")
    assert sorted((r.scan_id, r.rule_id) for r in stores.audit_csv(log).collect()) == [("a", None), ("b", "GCI0001")]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.cs").write_text("a\nb")
    assert stores.code_tree(spark, str(tmp_path / "src")).count() == 2
