"""A store of snapshots: rows by attempt, and a manifest that says which attempts count.

Rows are written first, under a partition of their own. A snapshot exists from the moment its manifest entry has its final
name, which a rename that never replaces gives it: readers see all of a snapshot or nothing, writers that meet on a number take
the next, and what a lost writer left behind is read by nobody. The file system must rename atomically. The driver touches
manifest entries only, one small file a snapshot.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "snapshot_id long, snapped_at string, rules_snapped long, notes string, attempt string"
MOST_TRIES = 1000


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; only a local master may go without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/riskloom/{name}-{uuid.uuid4().hex[:12]}"


def _files(spark: SparkSession, path: str):
    """The JVM's path class, and path's file system and file context."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    return hadoop.Path, fs, hadoop.FileContext.getFileContext(fs.getUri(), conf)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that are published."""
    of, fs, _ = _files(spark, path)
    at = of(f"{path}/manifest")
    names = [s.getPath().getName().removesuffix(".json") for s in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n) for n in names if n.isdigit()]


def _named(spark: SparkSession, path: str, entry: dict) -> bool:
    """Whether the entry got its number; false if another writer has it."""
    of, fs, files = _files(spark, path)
    draft, final = of(f"{path}/manifest/.{entry['attempt']}"), of(f"{path}/manifest/{entry['snapshot_id']:010d}.json")
    out = fs.create(draft, True)
    out.write((json.dumps(entry) + "\n").encode())
    out.close()
    never_replace = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(draft, final, never_replace)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def publish(metrics: DataFrame, path: str, snapped_at: str | None = None, notes: str | None = None) -> int:
    """Adds metrics (rule_id and more) as a snapshot of the time snapped_at (UTC, `yyyy-MM-dd HH:mm:ss`; now if not given) and
    returns its number. An empty table is a snapshot without rules."""
    spark, attempt = metrics.sparkSession, "a" + uuid.uuid4().hex
    metrics.write.parquet(f"{path}/rows/attempt={attempt}")
    n = spark.read.parquet(f"{path}/rows/attempt={attempt}").count()
    entry = {"snapped_at": snapped_at or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), "rules_snapped": n, "notes": notes, "attempt": attempt}
    number = max(_numbers(spark, path), default=0)
    for _ in range(MOST_TRIES):
        number += 1
        if _named(spark, path, entry | {"snapshot_id": number}):
            return number
    raise RuntimeError(f"no free number for a snapshot under {path} after {MOST_TRIES} tries")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published snapshots."""
    if not _numbers(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{path}/manifest/*.json")


def as_of(spark: SparkSession, path: str, at: str | None = None) -> DataFrame:
    """The rows of the last snapshot up to the time `at` (the last of all if not given; of one time that with the higher
    number), with snapshot_id. Only its partition is read. Raises where there is none."""
    known = manifest(spark, path)
    row = (known if at is None else known.filter(F.col("snapped_at") <= at)).orderBy(F.desc("snapped_at"), F.desc("snapshot_id")).first()
    if row is None:
        raise ValueError(f"no snapshot under {path}" + (f" up to {at}" if at else ""))
    return spark.read.parquet(f"{path}/rows").filter(F.col("attempt") == row.attempt).drop("attempt").withColumn("snapshot_id", F.lit(row.snapshot_id).cast("long"))


def latest_per_rule(spark: SparkSession, path: str, key: str = "rule_id") -> DataFrame:
    """Of each rule its row in the last snapshot that holds it, with snapshot_id. One aggregate; the manifest, one row a
    snapshot, is broadcast. Of a rule's several rows in one snapshot the greatest stays."""
    known = manifest(spark, path).select("snapshot_id", "snapped_at", "attempt")
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c != "attempt"]
    last: Column = F.max(F.struct("snapped_at", "snapshot_id", *[c for c in columns if c != key])).alias("l")
    return rows.join(F.broadcast(known), "attempt").groupBy(key).agg(last).select(key, *[f"l.{c}" for c in columns if c != key], "l.snapshot_id")


def rule_audit(snapshot: DataFrame, expected: DataFrame, actual: DataFrame, latest: DataFrame) -> DataFrame:
    """snapshot: rule_id, tp, fp, fn, precision, recall; expected: rule_id, should_trigger, is_inconclusive; actual: fixture_id,
    run_id, rule_id, did_trigger; latest: run_id (of each fixture's latest run). A row for each rule that any of them knows: the
    snapshot's numbers (shares to three decimals), its positive labels, the distinct fixtures that it fired on in latest runs,
    and how often it fired in all runs; null where a part doesn't know the rule."""
    names = {"tp": "long", "fp": "long", "fn": "long", "precision": "double", "recall": "double", "expected_triggers": "long", "fixtures_latest": "long", "triggers_all_runs": "long"}

    def part(rows: DataFrame, **known: Column) -> DataFrame:
        return rows.select("rule_id", *[(known[n] if n in known else F.lit(None)).cast(t).alias(n) for n, t in names.items()])

    count = F.count(F.lit(1)).alias("n")
    due = expected.filter((F.col("should_trigger") == 1) & ~F.coalesce(F.col("is_inconclusive").cast("boolean"), F.lit(False))).groupBy("rule_id").agg(count)
    fired = actual.filter("did_trigger = 1")
    current = fired.join(latest.select("run_id").distinct(), "run_id", "left_semi").groupBy("rule_id").agg(F.countDistinct("fixture_id").alias("n"))
    share = lambda c: F.round(F.col(c), 3)
    parts = part(snapshot, tp=F.col("tp"), fp=F.col("fp"), fn=F.col("fn"), precision=share("precision"), recall=share("recall"))
    for rows, name in ((due, "expected_triggers"), (current, "fixtures_latest"), (fired.groupBy("rule_id").agg(count), "triggers_all_runs")):
        parts = parts.unionByName(part(rows, **{name: F.col("n")}))
    return parts.groupBy("rule_id").agg(*[F.max(n).alias(n) for n in names])
