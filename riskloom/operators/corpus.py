"""Corpus joins, enrichers, labels and reports' aggregates as grouped plans.

Inputs are relations with the named columns; each function says which. Joins are on keys, groups are aggregated before
they are joined, and a side is broadcast only where a constant bounds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.paths import file_name, normal_path

#: Labels of fixtures in the order of their tests (fixed values).
DEPENDABOT, GHOST, SILENT, UNVALIDATED, HOT, STANDARD, INSUFFICIENT = (
    "DEPENDABOT_FIX", "HIGH_RISK_GHOST", "SILENT_LOGIC_CHANGE", "UNVALIDATED_BEHAVIORAL_RISK", "HOT_PATH_UNREVIEWED", "STANDARD_CHANGE", "INSUFFICIENT_DATA",
)
LABEL_RULES = [(DEPENDABOT, "GCI0012"), (GHOST, "GCI0014"), (SILENT, "GCI0036"), (UNVALIDATED, "GCI0003"), (HOT, "GCI0003")]
WIP_WORDS = ["wip", "work in progress", "draft", "do not merge", "dnm", "temp", "hack", "fixme", "todo"]
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
MOST_RULES = 100_000
LIBRARY_SILENT = ["GCI0022", "GCI0038", "GCI0046", "GCI0024", "GCI0035"]


def triggered_fixtures(actual: DataFrame, latest: DataFrame) -> DataFrame:
    """actual: fixture_id, run_id, rule_id, did_trigger; latest: run_id. Distinct fixtures a rule fired on in latest runs."""
    return actual.filter("did_trigger = 1").join(latest.select("run_id"), "run_id").groupBy("rule_id").agg(F.countDistinct("fixture_id").alias("fixtures"))


def all_run_outcomes(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Inner on (fixture_id, rule_id), over all runs: tp, fp, fn of each rule."""
    met, fired, due = actual.join(expected, ["fixture_id", "rule_id"]), F.col("did_trigger") == 1, F.col("should_trigger") == 1
    return met.groupBy("rule_id").agg(F.count_if(fired & due).alias("tp"), F.count_if(fired & ~due).alias("fp"), F.count_if(~fired & due).alias("fn"))


def alerts_on_changed_files(alerts: DataFrame, changed: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """Alerts on a changed file, one for each key."""
    return alerts.join(changed.select(on).distinct(), on, "left_semi").dropDuplicates(key)


#: Names meet texts in their first so many characters, or in all if they have fewer.
ANCHOR = 4
#: So many names at most are broadcast at once.
NAME_BLOCK = 20_000


def incidents_of_files(incidents: DataFrame, files: DataFrame) -> DataFrame:
    """incidents: id, title, description; files: file_path, any number. Each pair where the text holds the file's name (and so
    wherever it holds its path), case ignored; a name without characters meets nothing.

    Names are broadcast in blocks of bounded size. A text meets those whose first characters it holds and is compared with them
    whole in the same row: texts and their pieces are neither broadcast nor shuffled.
    """
    name = F.lower(F.substring_index(F.translate("file_path", "\\", "/"), "/", -1))
    named = files.select("file_path", name.alias("_name")).distinct().filter("_name <> ''")
    named = named.withColumn("_anchor", F.substring("_name", 1, ANCHOR))
    n, sizes = named.agg(F.count(F.lit(1)), F.collect_set(F.length("_anchor"))).first()
    texts = incidents.select("id", F.lower(F.concat_ws(" ", "title", "description")).alias("_text"))
    pieces = F.flatten(F.array(*[F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sorted(sizes) or [1]]))
    cut, blocks, out = texts.select("id", "_text", F.explode(F.array_distinct(pieces)).alias("_anchor")), max(1, -(-n // NAME_BLOCK)), None
    for b in range(blocks):
        part = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("file_path"), F.lit(blocks)) == b)
        met = cut.join(F.broadcast(part), "_anchor").filter(F.contains("_text", F.col("_name"))).select("id", F.sha2("_text", 256).alias("_sha"), "file_path")
        out = met if out is None else out.unionByName(met)
    return out.distinct().select("id", "file_path")


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def operation_lookup(findings: DataFrame, operations: DataFrame, least: float = 0.85) -> DataFrame:
    """findings: file_path, line and more; operations: op_id, file_path, line, risk. Each finding with the first operation of
    high risk on its line, else the first in its file; findings without any have a null op_id."""
    risky = operations.filter(F.col("risk") >= least)
    exact = first_by(risky, ["file_path", "line"], F.asc("op_id")).select("file_path", "line", F.col("op_id").alias("_exact"))
    any_ = first_by(risky, ["file_path"], F.asc("op_id")).select("file_path", F.col("op_id").alias("_any"))
    return findings.join(exact, ["file_path", "line"], "left").join(any_, "file_path", "left").select(*[findings[x] for x in findings.columns], F.coalesce("_exact", "_any").alias("op_id"))


def uncovered_blocks(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """findings: id, severity, file_path; coverage: file_path, coverage. Blocks on files without any coverage."""
    none = coverage.filter("coverage = 0").select("file_path").distinct()
    return findings.filter("severity = 3").join(none, "file_path", "left_semi").select("id", "file_path")


def baseline_filter(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not in the baseline."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def baseline(findings: DataFrame) -> DataFrame:
    """Distinct fingerprints, sorted."""
    return findings.select("fingerprint").distinct().orderBy("fingerprint")


def should_block(findings: DataFrame, by: str, passes: Column) -> DataFrame:
    """Whether any finding that passes the sensitivity filter blocks."""
    return findings.groupBy(by).agg(F.bool_or(passes & (F.col("severity") == 3)).alias("blocks"))


def with_all_tags(fixtures: DataFrame, wanted: list[str]) -> DataFrame:
    """fixtures: tags. Those that hold all wanted tags, case ignored."""
    low = F.transform("tags", F.lower)
    return fixtures.filter(reduce(lambda a, b: a & b, [F.array_contains(low, t.lower()) for t in wanted], F.lit(True)))


def purge(fixtures: DataFrame, language: str | None, need_comments: bool, blocked: list[str]) -> DataFrame:
    """The fixtures that stay: purged are those of another or no language, without comments, of a blocked repository."""
    tests = []
    if language:
        tests.append(F.col("language").isNull() | (F.lower("language") != language.lower()))
    if need_comments:
        tests.append(~F.col("has_comments"))
    if blocked:
        tests.append(F.lower("repo").isin([b.lower() for b in blocked]))
    return fixtures.filter(~F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False)))


def curated_scores(outcomes: DataFrame) -> DataFrame:
    """outcomes: rule_id, fire (expected), fired. tp, fp, fn, tn and f1 (0 where undefined) of each rule."""
    e, f = F.col("fire"), F.col("fired")
    by = outcomes.groupBy("rule_id").agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & ~f).alias("tn"))
    return by.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def heatmap(findings: DataFrame, by: str = "file_path") -> DataFrame:
    """Files, case ignored: the highest severity, how many findings and rules."""
    return findings.groupBy(F.lower(by).alias(by)).agg(F.max("severity").alias("severity"), F.count(F.lit(1)).alias("findings"), F.countDistinct("rule_id").alias("rules"))


def audit_stats(log: DataFrame) -> DataFrame:
    """log: scan_id, n_findings. Scans, scans with findings, findings."""
    return log.agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("n_findings") > 0).alias("with_findings"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"))


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def clusters(outcomes: DataFrame, cut: int = 50, examples: int = 3) -> DataFrame:
    """outcomes: id, evidence. By the first line cut to `cut` characters: how many, and the first examples."""
    head = F.substring(F.substring_index(F.coalesce("evidence", F.lit("")), "\n", 1), 1, cut)
    ranked = outcomes.withColumn("cluster", head).withColumn("_rn", F.row_number().over(Window.partitionBy("cluster").orderBy("id")))
    return ranked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= examples, F.col("id")))).alias("examples"))


def noise(fired: DataFrame, required: DataFrame, key: str = "fixture_id") -> DataFrame:
    """fired, required: key, rule_id (distinct within a key). Required that fired, required that didn't, fired beyond them."""
    both = fired.withColumn("_f", F.lit(1)).join(required.withColumn("_r", F.lit(1)), [key, "rule_id"], "full")
    return both.groupBy(key).agg(F.count_if(F.col("_f").isNotNull() & F.col("_r").isNotNull()).alias("hits"), F.count_if(F.col("_f").isNull()).alias("missed"), F.count_if(F.col("_r").isNull()).alias("noise"))


def rollup_by_tool(catches: DataFrame, by: list[str]) -> DataFrame:
    """catches: tool, caught, ci_required and more. Caught, total and rate over what is required."""
    out = catches.filter("ci_required").groupBy(*by).agg(F.count_if("caught").alias("caught"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", F.col("caught") / F.col("total"))


def label_totals(labels: DataFrame) -> DataFrame:
    return labels.groupBy("rule_id").agg(F.coalesce(F.sum("should_trigger"), F.lit(0)).alias("positive"), F.count(F.lit(1)).alias("total"))


def inferred_language(files: DataFrame, key: str) -> DataFrame:
    """files: key, pos, hint. The most frequent non-empty hint, of equal ones that seen first."""
    seen = files.filter(F.trim(F.coalesce("hint", F.lit(""))) != "").groupBy(key, "hint").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return first_by(seen, [key], F.desc("n"), F.asc("first")).select(key, F.col("hint").alias("language"))


def top_share(people: DataFrame, share: float = 0.05, least: int = 10) -> DataFrame:
    """people: login, contributions. The first ceil(share * n), at least `least`; ties by login. n is counted first, so that
    no task holds all rows."""
    n = people.count()
    return people.orderBy(F.desc("contributions"), "login").limit(max(least, -(-n * round(share * 100) // 100)))


def test_coverage(files: DataFrame) -> DataFrame:
    """files: diff_id, is_source, is_test. Production and test sources, the gap, and tests for each production source."""
    by = files.filter("is_source").groupBy("diff_id").agg(F.count_if(~F.col("is_test")).alias("production"), F.count_if("is_test").alias("tests"))
    return by.withColumn("gap", (F.col("production") > 0) & (F.col("tests") == 0)).withColumn("ratio", F.when(F.col("production") == 0, 1.0).otherwise(F.col("tests") / F.col("production")))


def structural_score(sensitive: Column, churn: Column, files: Column) -> Column:
    return F.when(sensitive, 0.4).otherwise(0.0) + F.when(churn >= 10, 0.3).when(churn >= 5, 0.2).otherwise(0.0) + F.when(files >= 5, 0.1).otherwise(0.0)


def description_signals(title: Column, body: Column) -> Column:
    """Empty body, linked issue, words of unfinished work."""
    b = F.coalesce(body, F.lit(""))
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), b))
    linked = b.rlike(r"(?i)(fixes|closes|resolves)\s+(#\d+|https://github\.com/[^/]+/[^/]+/issues/\d+)")
    return F.struct((F.length(F.trim(b)) < 30).alias("empty"), linked.alias("linked"), reduce(lambda x, y: x | y, [F.contains(both, F.lit(w)) for w in WIP_WORDS]).alias("unfinished"))


def is_dependabot(login: Column, title: Column) -> Column:
    return F.lower(F.coalesce(login, F.lit(""))).isin("dependabot[bot]", "dependabot-preview[bot]", "dependabot") | F.coalesce(title, F.lit("")).rlike(r"(?i)^(build\(deps|chore\(deps|bump\s+\S+\s+from\s+\S+\s+to\s)")


def first_contributors(authors: DataFrame, known: DataFrame) -> DataFrame:
    """Authors who are not among the known."""
    return authors.join(known.select("login").distinct(), "login", "left_anti")


def worst_findings(findings: DataFrame, key: str) -> DataFrame:
    """findings: key, rule_id, severity (a word of SEVERITIES, INFO where it is none). Count, rules, highest severity."""
    rank = F.coalesce(*[F.when(F.upper("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(0))
    by = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("rules"), F.max(rank).alias("_rank"))
    return by.withColumn("highest", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_rank") + 1)).drop("_rank")


def advisories(packages: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """packages: key, package; known: package, severity. Case ignored: packages, advisories and the highest severity."""
    met = packages.select(key, F.lower("package").alias("package")).distinct().join(known.select(F.lower("package").alias("package"), "severity"), "package", "left")
    return worst_findings(met.filter("severity is not null").withColumn("rule_id", F.col("package")), key)


def negative_labels(fixtures: DataFrame, rules: DataFrame, positive: DataFrame) -> DataFrame:
    """fixtures: fixture_id; rules: rule_id; positive: both. Rules without a positive label, at 0.4. Raises if there are more
    than MOST_RULES rules: each fixture is asked about each rule."""
    known = [r for (r,) in rules.select("rule_id").distinct().limit(MOST_RULES + 1).collect()]
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    asked = fixtures.select("fixture_id", F.explode(F.lit(known).cast("array<string>")).alias("rule_id"))
    return asked.join(positive.select("fixture_id", "rule_id").distinct(), ["fixture_id", "rule_id"], "left_anti").select("fixture_id", "rule_id", F.lit(0).alias("should_trigger"), F.lit(0.4).alias("confidence"))


def path_correlation(fired: DataFrame, commented: DataFrame, positive: DataFrame) -> DataFrame:
    """fired: fixture_id, rule_id, file_path; commented: fixture_id, file_path. Rules on a commented file, not yet positive, at 0.55."""
    met = fired.join(commented.select("fixture_id", "file_path").distinct(), ["fixture_id", "file_path"], "left_semi").select("fixture_id", "rule_id").distinct()
    return met.join(positive.select("fixture_id", "rule_id").distinct(), ["fixture_id", "rule_id"], "left_anti").withColumn("confidence", F.lit(0.55))


def composite_label(signals: DataFrame) -> DataFrame:
    """signals: one row a fixture with the enrichers' columns (null: not enriched; nlp may be absent). label and confidence, the
    first test wins. Counts of no alert are no data, but for semgrep, which says that it ran."""
    x = F.col
    if "nlp" not in signals.columns:
        signals = signals.withColumn("nlp", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(x(c), F.lit(False))
    n = lambda c: F.coalesce(x(c), F.lit(0))
    score = x("social_score")
    scanner, known = (n("sonar") + n("codeql") + n("semgrep")) > 0, score.isNotNull()
    low, high = F.coalesce(score < 0.3, F.lit(False)), F.coalesce(score >= 0.7, F.lit(False))
    below = lambda limit: F.coalesce(score < limit, F.lit(False))
    data = ["dependabot", "social_score", "semgrep", "structural_score", "advisories", "hotspot", "nlp", "test_gap", "entropy", "migration"]
    none = reduce(lambda a, b: a & b, [x(c).isNull() for c in data], (n("sonar") == 0) & (n("codeql") == 0))
    label = (
        F.when(none, INSUFFICIENT).when(yes("dependabot"), DEPENDABOT).when(yes("migration") | (n("advisories") > 0) | scanner, GHOST)
        .when(yes("sensitive_path") & (n("structural_score") >= 0.6) & below(0.5), HOT).when((n("hotspot") >= 0.7) & below(0.5), HOT).when((n("entropy") >= 0.8) & below(0.4), HOT)
        .when(known & ~high & (n("reviewers") <= 1), SILENT).when(yes("test_gap") & below(0.5), UNVALIDATED).when(yes("empty_body") & yes("unfinished") & low, UNVALIDATED)
        .when(yes("first_contributor") & yes("empty_body"), UNVALIDATED).when(low, UNVALIDATED).when(high, STANDARD).otherwise(INSUFFICIENT)
    )
    out = signals.withColumn("label", label)
    sure = (
        F.when(x("label") == DEPENDABOT, 0.95).when(x("label") == GHOST, F.when((n("sonar") + n("codeql")) > 0, 0.8).when(n("advisories") > 0, 0.85).otherwise(0.6)).when(x("label") == SILENT, 0.55)
        .when(x("label") == UNVALIDATED, F.when(yes("linked_issue"), 0.4).otherwise(0.5)).when(x("label") == HOT, 0.65).when(x("label") == STANDARD, F.when(n("reviewers") >= 2, 0.75).otherwise(0.6)).otherwise(0.0)
    )
    return out.select("fixture_id", "label", sure.alias("confidence"))


def expected_of_labels(labels: DataFrame, known: DataFrame, migrations: DataFrame | None = None) -> DataFrame:
    """labels: fixture_id, label, confidence. The rules of the labels that known (fixture_id, rule_id) lacks; a detected
    migration (fixture_id, confidence) gives GCI0021 whatever its label."""
    rules = F.create_map(*[F.lit(x) for pair in LABEL_RULES for x in pair])
    new = labels.select("fixture_id", F.try_element_at(rules, F.col("label")).alias("rule_id"), "confidence").filter("rule_id is not null")
    if migrations is not None:
        new = new.unionByName(migrations.select("fixture_id", F.lit("GCI0021").alias("rule_id"), "confidence"))
    return new.join(known.select("fixture_id", "rule_id").distinct(), ["fixture_id", "rule_id"], "left_anti")


def promotions(labels: DataFrame, most: int = 3) -> DataFrame:
    """labels: rule_id, fixture_id, should_trigger, confidence, label_source. Of each rule its surest positives that neither a
    model nor a generator gave."""
    own = labels.filter((F.col("should_trigger") == 1) & ~F.lower("label_source").rlike("llm|syn"))
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("confidence"), "fixture_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= most).select("rule_id", "fixture_id", "confidence", "rank")


def refinement(metrics: DataFrame) -> DataFrame:
    """metrics: rule_id, precision, recall, tp, fp. Issues of each rule and their priority, the last one deciding."""
    p, r, dead = F.col("precision") < 0.8, F.col("recall") < 0.6, (F.col("tp") == 0) & (F.col("fp") == 0)
    issues = F.array_compact(F.array(F.when(p, "HighFalsePositiveRate"), F.when(r, "LowRecall"), F.when(dead, "NoSignal")))
    return metrics.select("rule_id", F.when(dead, "CRITICAL").when(p | r, "HIGH").otherwise("NONE").alias("priority"), F.array_join(issues, ",").alias("issues"))


def generated_cases(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """outcomes: rule_id, fixture_id, status. The first FP and FN fixtures of each rule."""
    wrong = outcomes.filter(F.col("status").isin("FP", "FN"))
    rank = F.row_number().over(Window.partitionBy("rule_id", "status").orderBy("fixture_id"))
    return wrong.withColumn("rank", rank).filter(F.col("rank") <= most).select("rule_id", "status", "fixture_id", "rank")


def missed(expected: DataFrame, latest: DataFrame, actual: DataFrame) -> DataFrame:
    """Positive labels (fixture_id, rule_id, should_trigger) that did not trigger in the fixture's latest run (fixture_id, run_id)."""
    due = expected.filter("should_trigger = 1").join(latest.select("fixture_id", "run_id"), "fixture_id")
    return due.join(actual.filter("did_trigger = 1").select("fixture_id", "run_id", "rule_id").distinct(), ["fixture_id", "run_id", "rule_id"], "left_anti").select("fixture_id", "rule_id")


def overridden(labels: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """overrides: key, is_inconclusive, reason. Labels with the override's flag, and its reason where it gives one."""
    new = overrides.select(*key, F.col("is_inconclusive").alias("_flag"), F.col("reason").alias("_reason"))
    met = labels.join(new, key, "left")
    return met.withColumn("is_inconclusive", F.coalesce("_flag", "is_inconclusive")).withColumn("reason", F.coalesce("_reason", "reason")).drop("_flag", "_reason")


def missing_keys(labels: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """Overrides without a label."""
    return overrides.select(key).join(labels.select(key), key, "left_anti")


def retained_events(events: DataFrame, most: int, drop: int) -> DataFrame:
    """events: sent, ts, event_id. A queue over `most` loses its first `drop` rows, unsent last; the count is taken first, so
    only the dropped ones are ordered."""
    if events.count() <= most:
        return events
    gone = events.orderBy(F.desc("sent"), "ts", "event_id").limit(drop).select("event_id")
    return events.join(gone, "event_id", "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """What a conditional delete leaves; null conditions delete nothing."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(column)))


def token_frequency(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Tokens of a `;` list that begin with a prefix, and how often they occur."""
    tokens = df.select(F.explode(F.split(F.coalesce(column, F.lit("")), ";")).alias("token")).select(F.trim("token").alias("token"))
    return tokens.filter(F.col("token").startswith(prefix)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def risk_band(points: list[Column]) -> Column:
    """The sum of points as one of four bands."""
    total = reduce(lambda a, b: a + b, points)
    return F.when(total >= 5, "critical").when(total >= 3, "high").when(total >= 1, "medium").otherwise("low")


def keywords(summary: Column, most: int = 8) -> Column:
    """The first distinct words of four letters or more, lower case."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(summary), F.lit(r"([a-z]{4,})"), F.lit(1))), 1, most)


def domain_filter(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """domains: diff_id, domain. In a library the rules of services are silent."""
    met = findings.join(domains.select("diff_id", F.col("domain").alias("_domain")), "diff_id", "left")
    return met.filter(~(F.coalesce("_domain", F.lit("unknown")).eqNullSafe("library") & F.col("rule_id").isin(LIBRARY_SILENT))).drop("_domain")


def repo_domain(override: Column, web_projects: Column, library_projects: Column, web_signal: Column) -> Column:
    """The configured domain, else by projects, else by the diff's signals."""
    configured = F.when(F.lower(override) == "library", "library").when(F.lower(override) == "web", "web")
    return F.coalesce(configured, F.when(web_projects > 0, "web").when((library_projects > 0) & ~web_signal, "library").when(web_signal, "web").otherwise("unknown"))


def semantic_boost(findings: DataFrame, operations: DataFrame, least: float = 0.85) -> DataFrame:
    """Findings (id, rule_id, confidence, file_path, line) of four rules become sure where a changed condition (operations:
    file_path, line, kind, risk) of that risk stands on their own line; paths are normalised and compared without case."""
    at = lambda path: F.lower(normal_path(path))
    risky = operations.filter((F.col("kind") == "ConditionalModified") & (F.col("risk") >= least))
    risky = risky.select(at(F.col("file_path")).alias("_path"), F.col("line").alias("_line")).distinct().withColumn("_hit", F.lit(True))
    met = findings.join(risky, (at(F.col("file_path")) == F.col("_path")) & (F.col("line") == F.col("_line")), "left")
    raised = F.upper("rule_id").isin("GCI0058", "GCI0059", "GCI0003", "GCI0007") & F.col("_hit").isNotNull() & (F.col("file_path") != "")
    return met.withColumn("confidence", F.when(raised, F.lit(2)).otherwise(F.col("confidence"))).select(findings.columns)


def stage_summary(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows after each stage of a delivery, in order."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "n") for k, (name, df) in enumerate(stages)]
    return reduce(DataFrame.unionByName, counts)


#: Review comments' keywords, in order: rule, keywords, confidence (fixed values).
COMMENT_RULES = [
    ("GCI0041", ["needs tests", "add test", "missing test", "no test", "untested"], 0.65),
    ("GCI0006", ["null", "can this be null", "null reference", "nullreferenceexception", "nullable"], 0.6),
    ("GCI0004", ["breaking change", "backwards compat", "backward compat", "semver", "api break"], 0.65),
    ("GCI0016", [".result", ".wait()", "async", "blocking", "deadlock", "configureawait", "socket", "thread pool", "concurrency", "cpu bound"], 0.65),
    ("GCI0010", ["hardcoded", "hard-coded", "magic string", "magic number"], 0.6),
    ("GCI0032", ["exception", "catch", "swallowing", "ignored exception"], 0.6),
    ("GCI0012", ["secret", "password", "credential", "api key", "api_key"], 0.75),
    ("GCI0022", ["idempotent", "idempotency", "idempotency key", "duplicate request", "retry safe", "insert duplicate", "upsert"], 0.65),
    ("GCI0021", ["migration", "schema change", "db migration", "database migration"], 0.65),
    ("GCI0047", ["contradictory method", "wrong method name", "naming inversion", "method semantics", "misleading name", "method name contradicts"], 0.65),
    ("GCI0024", ["dispose", "using statement", "memory leak", "resource leak", "not disposed", "idisposable", "undisposed"], 0.65),
    ("GCI0029", ["pii", "personal data", "gdpr", "personally identifiable", "sensitive data", "user data in log", "privacy"], 0.7),
    ("GCI0032", ["unhandled exception", "exception propagation", "missing catch", "throw without catch", "uncaught"], 0.6),
    ("GCI0036", ["[pure]", "side effect in getter", "getter has side effect", "mutation in getter", "pure method mutates"], 0.55),
    ("GCI0038", ["service locator", "captive dependency", "scoped in singleton", "getrequiredservice", "getservice", "di anti-pattern"], 0.65),
    ("GCI0039", ["httpclient", "http client factory", "socket exhaustion", "ihttpclientfactory", "timeout missing", "cancellation token missing"], 0.65),
    ("GCI0041", ["missing assertion", "skipped test", "test ignored", "[ignore]", "uninformative test name", "test quality"], 0.6),
    ("GCI0042", ["todo", "fixme", "not implemented", "notimplementedexception", "stub left", "incomplete implementation"], 0.7),
    ("GCI0043", ["null forgiving", "pragma warning disable nullable", "nullable warning", "cs8600", "null safety", "null-forgiving operator"], 0.6),
    ("GCI0044", ["linq in loop", "allocation in loop", "performance hotpath", "hot path", "gc pressure", "memory pressure", "linq overhead"], 0.6),
    ("GCI0045", ["over-engineering", "unnecessary abstraction", "single use interface", "passive wrapper", "delegation wrapper", "yagni"], 0.55),
    ("GCI0046", ["inconsistent naming", "missing async suffix", "sync async naming", "pattern inconsistency", "naming convention"], 0.55),
    ("GCI0047", ["contradictory name", "misleading method name", "method rename", "naming contradiction", "boolean naming inversion"], 0.55),
    ("GCI0049", ["float comparison", "floating point equality", "double equality", "use epsilon", "math.abs comparison", "floating-point"], 0.65),
    ("GCI0015", ["mass assignment", "over-posting", "sql ignore", "on conflict do nothing", "input binding", "unchecked cast", "data integrity"], 0.6),
    ("GCI0035", ["layer violation", "architecture violation", "cross layer", "wrong layer", "should not reference", "dependency inversion"], 0.65),
    ("GCI0048", ["insecure random", "use securerandom", "cryptographic rng", "system.random", "randomnumbergenerator", "not cryptographically"], 0.7),
    ("GCI0050", ["sql truncation", "column too short", "string length", "max length", "nvarchar too small", "data truncation"], 0.6),
    ("GCI0053", ["lockfile only", "lockfile changed without", "no source change", "why is the lockfile", "bump without source"], 0.55),
]
#: Strategies on added lines: rule, pattern, confidence.
STRATEGIES = [
    ("GCI0016", r"\.GetAwaiter\(\)\.GetResult\(\)|\.Wait\(\)|(Task|Async).*\.Result|lock ?\(this\)", 0.65),
    ("GCI0012", r"MD5\.Create|SHA1\.Create|DESCryptoServiceProvider|Process\.Start\(", 0.7),
    ("GCI0032", r"throw new (?!ArgumentNullException|ArgumentException|NotImplementedException)", 0.6),
    ("GCI0006", r"\w\.Value\b(?!\?)", 0.55),
    ("GCI0043", r"\w!\.|#nullable disable", 0.55),
    ("GCI0015", r"(?i)insert ignore|insert or ignore|on conflict do nothing", 0.6),
]


def strategy_labels(added: DataFrame, key: str) -> DataFrame:
    """added: key, text (one added line a row). One positive label for each strategy that a line bears out."""
    hits = [F.bool_or(F.col("text").rlike(p)).alias(f"s{k}") for k, (_, p, _) in enumerate(STRATEGIES)]
    by = added.groupBy(key).agg(*hits)
    found = F.array_compact(F.array(*[F.when(F.col(f"s{k}"), F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("confidence"))) for k, (r, _, c) in enumerate(STRATEGIES)]))
    return by.select(key, F.explode(found).alias("f")).select(key, "f.*")


def coordinated_labels(labels: DataFrame, key: str, least: dict[str, float], turned: dict[str, float], by: str = "GCI0016") -> DataFrame:
    """labels: key, rule_id, should_trigger, confidence. Where `by` triggers, positive labels of `least` are at least so sure,
    and negative ones of `turned` become positive."""
    present = F.max(F.when((F.col("rule_id") == by) & (F.col("should_trigger") == 1), 1).otherwise(0)).over(Window.partitionBy(key)) == 1
    out = labels.withColumn("_on", present)
    floor = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(c)) for r, c in least.items()], F.lit(0.0))
    turn = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(c)) for r, c in turned.items()], F.lit(None).cast("double"))
    positive = F.col("should_trigger") == 1
    sure = F.when(F.col("_on") & positive, F.greatest("confidence", floor)).when(F.col("_on") & ~positive & turn.isNotNull(), turn).otherwise(F.col("confidence"))
    fires = F.when(F.col("_on") & ~positive & turn.isNotNull(), 1).otherwise(F.col("should_trigger"))
    return out.select(key, "rule_id", fires.alias("should_trigger"), sure.alias("confidence"))


#: Parts of lines that change a schema, in any case, and annotations of a mapped one (fixed values).
DDL = ["CREATE TABLE", "ALTER TABLE", "DROP TABLE", "DROP COLUMN", "ADD COLUMN", "ALTER COLUMN", "CREATE INDEX", "DROP INDEX"]
MAPPED = ["[Table(", "[Column(", "[ForeignKey(", "[Index("]


def migration_signals(added: DataFrame, key: str) -> DataFrame:
    """added: key, path, text (null for a file without added lines). Signs of a schema migration and their confidence: the
    migration's own file, then SQL, then code; a snapshot alone is detected at 0."""
    path, t = F.translate("path", "\\", "/"), F.col("text")
    any_of = lambda text, terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in terms])
    signs = {
        "migration_file": F.contains(F.lower(path), F.lit("/migrations/")) & file_name(path).rlike(r"^\d{14}_.*\.cs$"), "snapshot_file": F.lower(path).endswith("contextmodelsnapshot.cs"), "sql_file": F.lower(path).endswith(".sql"),
        "migration_code": (F.contains(t, F.lit("public partial class")) & F.contains(t, F.lit("Migration"))) | F.contains(t, F.lit("migrationBuilder.")), "ddl": any_of(F.upper(t), DDL), "annotation": any_of(t, MAPPED),
    }
    by = added.groupBy(key).agg(*[F.coalesce(F.bool_or(s), F.lit(False)).alias(n) for n, s in signs.items()])
    c = F.col
    sure = F.when(c("migration_file"), 0.95).when(c("sql_file") | c("ddl"), 0.85).when(c("migration_code") | c("annotation"), 0.75).otherwise(0.0)
    return by.withColumn("confidence", sure).withColumn("detected", (sure > 0) | c("snapshot_file"))


def stage_order(depends: dict[str, list[str]]) -> list[str]:
    """Stages after all that they depend on, otherwise as given; raises on a cycle or an unknown stage."""
    unknown = {d for ds in depends.values() for d in ds} - set(depends)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    out: list[str] = []
    while len(out) < len(depends):
        ready = [s for s, ds in depends.items() if s not in out and all(d in out for d in ds)]
        if not ready:
            raise ValueError(f"a cycle among {sorted(set(depends) - set(out))}")
        out.append(ready[0])
    return out


def enrich_findings(findings: DataFrame, stages: dict[str, tuple[list[str], object]]) -> DataFrame:
    """Applies stages (name: what it depends on, and a function from findings to findings) in their order."""
    for name in stage_order({k: d for k, (d, _) in stages.items()}):
        findings = stages[name][1](findings)
    return findings
