"""The store of snapshots: what is published counts, whole, and nothing else."""

import pytest
from riskloom.sources import snapshots

SCHEMA = "rule_id string, tp long, precision double"


def _rows(df):
    return sorted((r.rule_id, r.tp, r.snapshot_id) for r in df.collect())


def _metrics(spark, *rows):
    return spark.createDataFrame([(r, n, 0.5) for r, n in rows], SCHEMA)


def test_snapshots_by_time(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.manifest(spark, path).count() == 0
    with pytest.raises(ValueError):
        snapshots.as_of(spark, path)
    assert snapshots.publish(_metrics(spark, ("A", 1), ("B", 1)), path, "2024-01-01 00:00:00", "first") == 1
    assert snapshots.publish(_metrics(spark, ("A", 2)), path, "2024-03-01 00:00:00") == 2
    assert snapshots.publish(_metrics(spark, ("C", 3)), path, "2024-02-01 00:00:00") == 3  # told late
    assert _rows(snapshots.as_of(spark, path)) == [("A", 2, 2)]
    assert _rows(snapshots.as_of(spark, path, "2024-02-29 00:00:00")) == [("C", 3, 3)]
    assert _rows(snapshots.as_of(spark, path, "2024-01-01 00:00:00")) == [("A", 1, 1), ("B", 1, 1)]
    with pytest.raises(ValueError):
        snapshots.as_of(spark, path, "2023-12-31 00:00:00")
    assert _rows(snapshots.latest_per_rule(spark, path)) == [("A", 2, 2), ("B", 1, 1), ("C", 3, 3)]
    assert [(r.snapshot_id, r.rules_snapped, r.notes) for r in snapshots.manifest(spark, path).orderBy("snapshot_id").collect()] == [(1, 2, "first"), (2, 1, None), (3, 1, None)]


def test_only_one_partition_is_read(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in (1, 2):
        snapshots.publish(_metrics(spark, ("A", k)), path, f"2024-01-0{k} 00:00:00")
    df = snapshots.as_of(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(attempt" in plan
    read = df.select("_metadata.file_path").distinct().collect()
    assert len({r.file_path.split("attempt=")[1].split("/")[0] for r in read}) == 1


def test_lost_and_competing_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    snapshots.publish(_metrics(spark, ("A", 1)), path, "2024-01-01 00:00:00")
    _metrics(spark, ("LOST", 9)).write.parquet(f"{path}/rows/attempt=alost")  # a writer that died before its entry had a name
    (tmp_path / "store" / "manifest" / ".alost").write_text('{"snapshot_id": 7')  # and one that died while it wrote it
    assert _rows(snapshots.latest_per_rule(spark, path)) == [("A", 1, 1)] and _rows(snapshots.as_of(spark, path)) == [("A", 1, 1)]
    monkeypatch.setattr(snapshots, "_numbers", lambda *_: [])  # as if the first entry came while we looked
    assert snapshots.publish(_metrics(spark, ("A", 2)), path, "2024-01-02 00:00:00") == 2
    monkeypatch.undo()
    assert snapshots.manifest(spark, path).count() == 2 and _rows(snapshots.as_of(spark, path, "2024-01-01 12:00:00")) == [("A", 1, 1)]


def test_empty_snapshot(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.publish(_metrics(spark, ("A", 1)), path, "2024-01-01 00:00:00")
    assert snapshots.publish(spark.createDataFrame([], SCHEMA), path, "2024-01-02 00:00:00") == 2
    assert _rows(snapshots.as_of(spark, path)) == [] and _rows(snapshots.latest_per_rule(spark, path)) == [("A", 1, 1)]


def test_rule_audit(spark):
    made = spark.createDataFrame
    snapshot = made([("A", 1, 2, 3, 1 / 3, 0.25), ("Z", 0, 0, 0, None, None)], "rule_id string, tp long, fp long, fn long, precision double, recall double")
    expected = made([("A", 1, False), ("A", 1, True), ("A", 0, False), ("B", 1, None)], "rule_id string, should_trigger int, is_inconclusive boolean")
    actual = made([(1, 10, "A", 1), (1, 11, "A", 1), (2, 20, "A", 1), (2, 20, "A", 1), (1, 11, "C", 1), (1, 11, "D", 0)], "fixture_id int, run_id int, rule_id string, did_trigger int")
    found = {r.rule_id: tuple(r)[1:] for r in snapshots.rule_audit(snapshot, expected, actual, made([(11,), (20,)], "run_id int")).collect()}
    assert found == {"A": (1, 2, 3, 0.333, 0.25, 1, 2, 4), "B": (None,) * 5 + (1, None, None), "C": (None,) * 6 + (1, 1), "Z": (0, 0, 0) + (None,) * 5}
