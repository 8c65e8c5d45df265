"""Readers and writers: diffs, code trees, logs, keyed Parquet tables."""

from __future__ import annotations

import json
import re
import subprocess

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from riskloom.functions.paths import is_generated_file, is_test_file

#: One audit log entry in each line of the log.
AUDIT = "scan_id string, timestamp timestamp, repo_path string, commit_sha string, files_changed int, files_eligible int, rules_evaluated int, finding_count int, findings array<struct<rule_id: string, rule_name: string, summary: string, confidence: string, file_path: string, line: int>>"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def diffs_from_files(spark: SparkSession, path: str) -> DataFrame:
    """One diff for each file under path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("raw_diff"))


#: What the reference trees of `git diff` are called.
MODES = {"staged": ["--cached"], "unstaged": [], "all-changes": ["HEAD"]}


def diffs_from_git(spark: SparkSession, repo: str, ref: str, context: int = 10) -> DataFrame:
    """The diff of a commit against its parent, of a range as given (a..b), or of a mode (staged, unstaged, all-changes), with
    the commit's message (null if there is none). Read on the driver, which has the repository."""
    span = MODES.get(ref) if ref in MODES else [ref if ".." in ref else f"{ref}^..{ref}"]
    text = subprocess.run(["git", "-C", repo, "diff", f"-U{context}", *span], capture_output=True, text=True, check=True).stdout
    said = None if ref in MODES else subprocess.run(["git", "-C", repo, "log", "-1", "--format=%s", ref], capture_output=True, text=True, check=False)
    message = said.stdout.strip() if said is not None and said.returncode == 0 else None
    return spark.createDataFrame([(ref, text, message)], "diff_id string, raw_diff string, commit_message string")


def diffs_from_text(spark: SparkSession, text: str, name: str = "stdin") -> DataFrame:
    return spark.createDataFrame([(name, text)], "diff_id string, raw_diff string")


EXCLUDED = r"/(bin|obj|node_modules|\.git)/"


def _sources(spark: SparkSession, root: str, excluded: str) -> DataFrame:
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.cs")
    path = F.regexp_replace(F.input_file_name(), "^.*" + re.escape(root.rstrip("/")) + "/", "")  # within the tree
    return files.select(path.alias("file_path"), "value").filter(~F.concat(F.lit("/"), "file_path").rlike(excluded))


def code_tree(spark: SparkSession, root: str, excluded: str = EXCLUDED) -> DataFrame:
    """Every source file under root as a diff that adds it: the line table of operators.rules, one diff a file, so that no
    window holds more than a file."""
    files = _sources(spark, root, excluded)
    lines = files.select("file_path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("line_ord", "content"))
    return lines.select(
        F.col("file_path").alias("diff_id"), F.lit(0).alias("file_ord"), F.lit(0).alias("hunk_ord"), "line_ord", F.lit("added").alias("kind"), F.lit(0).alias("old_line"), (F.col("line_ord") + 1).alias("new_line"),
        "content", "file_path", is_test_file(F.col("file_path")).alias("is_test"), is_generated_file(F.col("file_path")).alias("is_generated"),
    )


def scan_estimate(spark: SparkSession, root: str, excluded: str = EXCLUDED, measured: int = 100) -> DataFrame:
    """files, bytes and lines of the first `measured` files by path, lines carried on to all files, and seconds to expect."""
    files = _sources(spark, root, excluded)
    n = files.count()
    first = files.orderBy("file_path").limit(measured).agg(F.sum(F.octet_length("value")).alias("bytes"), F.sum(F.size(F.split("value", "\n"))).alias("loc"))
    scale = n / measured if n > measured else 1.0
    return first.select(F.lit(n).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce((F.col("loc") * scale).cast("long"), F.lit(0)).alias("loc"), F.lit(max(1.0, 0.001 * n)).alias("seconds"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents that hold a list of objects or one object; keys in any case; a path without files gives no rows."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    text = F.trim("value")
    items = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<map<string,string>>")
    rows = files.select(F.explode(items).alias("m")).filter("m is not null").select(F.transform_keys("m", lambda k, v: F.lower(k)).alias("m"))
    value = lambda f: F.try_element_at("m", F.lit(f.name.lower()))
    nested = lambda f: F.from_json(value(f), f.dataType.simpleString()) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else value(f).try_cast(f.dataType)
    return rows.select(*[nested(f).alias(f.name) for f in StructType.fromDDL(schema)])


def hour_slots(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row for each hour of the days from start to end, named as the archive names its files."""
    day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    hours = spark.range(1).select(day).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.select("day", "hour", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("-"), F.col("hour").cast("string")).alias("slot"))


ARCHIVE = "type string, repo struct<name: string>, payload struct<action: string, pull_request: struct<number: int, merged: boolean, language: string>>, created_at timestamp"


def archive_candidates(spark: SparkSession, path: str, language: str | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """Merged pull requests of hourly archive files (JSON lines, gzip or plain): repo, number, created_at."""
    events = spark.read.schema(ARCHIVE).option("mode", "DROPMALFORMED").json(path).filter((F.col("type") == "PullRequestEvent") & F.col("payload.pull_request.merged"))
    out = events.select(F.col("repo.name").alias("repo"), F.col("payload.pull_request.number").alias("number"), F.col("payload.pull_request.language").alias("language"), "created_at")
    out = out if language is None else out.filter(F.lower("language") == language.lower())
    return (out.filter(~F.lower("repo").isin([b.lower() for b in blocked])) if blocked else out).dropDuplicates(["repo", "number"])


INCIDENT = "id string, title string, description string, source string, created_at timestamp"


def incidents(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Exported incidents with since <= created_at <= until."""
    at = F.col("created_at")
    return documents(spark, path, INCIDENT).filter((at >= F.lit(since).cast("timestamp")) & (at <= F.lit(until).cast("timestamp")))


ALERT = "tool string, key string, rule_id string, severity string, path string, line int"


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """Exported alerts of scanners, one for each tool and key."""
    return documents(spark, path, ALERT).filter("path is not null").dropDuplicates(["tool", "key"])


def maintainer_records(records: DataFrame) -> DataFrame:
    """records: owner, repo, number, type and more; one for each owner/repo#n:type."""
    key = F.concat("owner", F.lit("/"), "repo", F.lit("#"), F.col("number").cast("string"), F.lit(":"), "type")
    return records.withColumn("record", key).dropDuplicates(["record"])


def ignore_entries(text: str) -> list[str]:
    """Of an ignore file: its lines without comments and blanks."""
    return [x for x in (line.split("#", 1)[0].strip() for line in text.splitlines()) if x]


def editor_severities(text: str) -> dict[str, str]:
    """Of an .editorconfig: dotnet_diagnostic.RULE.severity = word."""
    found = re.findall(r"(?mi)^\s*dotnet_diagnostic\.(\w+)\.severity\s*=\s*(\w+)", text)
    return {rule.upper(): word.lower() for rule, word in found}


def settings(text: str) -> dict[str, str]:
    """Severities by rule of a JSON configuration; comments and an unreadable text count as none."""
    try:
        found = json.loads(re.sub(r"(?m)^\s*//.*$", "", text))
    except ValueError:
        return {}
    rules = found.get("rules", {}) if isinstance(found, dict) else {}
    return {k.upper(): str(v.get("severity")) for k, v in rules.items() if isinstance(v, dict) and v.get("severity")}


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Blank and malformed lines are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def audit_csv(entries: DataFrame) -> DataFrame:
    """One row for each finding; a scan without findings keeps one row."""
    return entries.select("scan_id", "timestamp", "commit_sha", F.explode_outer("findings").alias("f")).select("scan_id", "timestamp", "commit_sha", "f.*")


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 document (a JSON text) for each diff."""
    level = F.when(F.col("severity") == 3, "error").when(F.col("severity") == 2, "warning").otherwise("note")
    place = F.when(F.col("file_path").isNotNull() & F.col("line").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("evidence").alias("text")).alias("message"), place.alias("locations"))
    by = findings.groupBy("diff_id").agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    driver = F.struct(F.struct(F.lit("riskloom").alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.col("results"))
    return by.select("diff_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
