"""Reports of findings as texts: JSON, Markdown, annotations, check runs, reviews, chat and console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ANNOTATIONS, COMPOUND = 50, 4


def _level(high: str, middle: str, low: str) -> Column:
    return F.when(F.col("severity") == 3, high).when(F.col("severity") == 2, middle).otherwise(low)


def json_report(findings: DataFrame) -> DataFrame:
    """One JSON text for each diff: how many findings of each severity, and the findings in order of rule, file and line."""
    item = F.struct(F.col("rule_id").alias("rule"), F.col("file_path").alias("file"), "line", "severity")
    by = findings.groupBy("diff_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == 3).alias("blocks"), F.array_sort(F.collect_list(item)).alias("findings"))
    return by.select("diff_id", F.to_json(F.struct("total", "blocks", "findings")).alias("json"))


def _escaped(text: Column) -> Column:
    for mark, code in (("%", "%25"), (",", "%2C"), (":", "%3A"), ("\r", ""), ("\n", "")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, one for each rule and file of a diff: diff_id, rule_id, file_path, command.

    findings: diff_id, ord (their order), rule_id, rule_name, summary, confidence, file_path, line, evidence. The first finding
    gives the level and the summary; then follow the lines, if several, and each distinct evidence in the order it came.
    Without a file the place is left out, without a line it is line 1.
    """
    plain = lambda x: F.replace(F.replace(x, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("%0A"))
    said = F.when(F.trim(F.coalesce("evidence", F.lit(""))) != "", F.struct("ord", "evidence"))
    groups = findings.withColumn("file_path", F.coalesce("file_path", F.lit(""))).groupBy("diff_id", "rule_id", "file_path").agg(
        F.min(F.struct("ord", "rule_name", "summary", "confidence")).alias("first"), F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_list(said)).alias("said"),
    )
    evidence = F.array_distinct(F.transform("said", lambda x: x["evidence"]))
    level = F.when(F.col("first.confidence") == 2, "error").when(F.col("first.confidence") == 1, "warning").otherwise("notice")
    place = F.when(F.col("file_path") != "", F.concat(F.lit("file="), "file_path", F.lit(",line="), F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(1)).cast("string"), F.lit(","))).otherwise("")
    title = F.concat(F.lit("title="), _escaped(F.concat_ws(" ", "rule_id", "first.rule_name")), F.lit("::"))
    lines = F.when(F.size("lines") > 1, F.concat(F.lit("%0ALines: "), F.array_join(F.transform("lines", lambda x: x.cast("string")), ", "))).otherwise("")
    shown = F.when(F.size(evidence) > 0, F.concat(F.lit("%0AEvidence:"), F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("%0A  - "), plain(e))), ""))).otherwise("")
    return groups.select("diff_id", "rule_id", "file_path", F.concat(F.lit("::"), level, F.lit(" "), place, title, plain(F.coalesce("first.summary", F.lit(""))), lines, shown).alias("command"))


def check_runs(diffs: DataFrame, findings: DataFrame) -> DataFrame:
    """The conclusion of each diff, and its annotations: the first MOST_ANNOTATIONS findings with a place, blocks first."""
    by = findings.groupBy("diff_id").agg(F.max("severity").alias("worst"), F.count_if(F.col("line").isNotNull() & F.col("file_path").isNotNull()).alias("placed"))
    out = diffs.select("diff_id").join(by, "diff_id", "left")
    conclusion = F.when(F.col("worst") == 3, "failure").when(F.col("worst").isin(1, 2), "neutral").otherwise("success")
    return out.select("diff_id", conclusion.alias("conclusion"), F.least(F.coalesce("placed", F.lit(0)), F.lit(MOST_ANNOTATIONS)).cast("long").alias("annotations"))


def review_parts(findings: DataFrame) -> DataFrame:
    """Whether each finding goes inline (it has a place) or into the review's summary, with its body."""
    inline = F.col("line").isNotNull() & F.col("file_path").isNotNull()
    body = F.concat(F.lit("**"), "rule_id", F.lit("** "), F.coalesce("evidence", F.lit("")))
    return findings.select("diff_id", "rule_id", F.when(inline, "inline").otherwise("summary").alias("part"), body.alias("body"))


def chat_message(findings: DataFrame, first: int = 3) -> DataFrame:
    """One line for each diff: the number of blocks and the first rules by severity and id."""
    rank = F.row_number().over(Window.partitionBy("diff_id").orderBy(F.desc("severity"), "rule_id", "id"))
    top = findings.withColumn("rn", rank)
    by = top.groupBy("diff_id").agg(F.count_if(F.col("severity") == 3).alias("blocks"), F.array_sort(F.collect_list(F.when(F.col("rn") <= first, F.struct("rn", "rule_id")))).alias("top"))
    return by.select("diff_id", F.concat(F.col("blocks").cast("string"), F.lit(" blocking: "), F.array_join(F.transform("top", lambda x: x["rule_id"]), ", ")).alias("message"))


def console(findings: DataFrame) -> DataFrame:
    """Counts of each diff by severity, and whether COMPOUND or more rules of the two upper severities meet."""
    serious = F.when(F.col("severity").isin(2, 3), F.col("rule_id"))
    return findings.groupBy("diff_id").agg(
        *[F.count_if(F.col("severity") == k).alias(n) for k, n in ((3, "blocks"), (2, "warnings"), (1, "notes"))], (F.countDistinct(serious) >= COMPOUND).alias("compound"),
    )


def markdown_scorecard(scores: DataFrame) -> DataFrame:
    """A table row for each rule of a tier, shares with one decimal."""
    share = lambda c: F.concat(F.format_string("%.1f", F.round(F.col(c) * 100, 1)), F.lit("%"))
    return scores.select("tier", "rule_id", F.concat(F.lit("| "), "rule_id", F.lit(" | "), share("trigger_rate"), F.lit(" | "), share("precision"), F.lit(" | "), share("recall"), F.lit(" |")).alias("row"))


def html_rows(findings: DataFrame) -> DataFrame:
    """Table rows with the texts escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return findings.select("diff_id", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *map(safe, ("rule_id", "file_path", "line", "evidence"))), F.lit("</td></tr>")).alias("row"))


def snapshot(metrics: DataFrame, snapshot_id: str, path: str) -> None:
    """Appends the rows of a snapshot under its own partition."""
    metrics.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(path)
