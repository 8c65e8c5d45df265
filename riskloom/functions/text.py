"""Small scalar functions on text, JSON and numbers, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags and the parts of a diff that give them (fixed values).
TAGS = [
    ("async", ["async", "await", ".Result", ".Wait("]),
    ("contract-change", ["public ", "interface ", "abstract "]),
    ("early-return", ["return ", "throw "]),
    ("null-safety", ["null", "?.", "??"]),
    ("state-mutation", ["= new ", "List<", "Dictionary<", "HashSet<"]),
    ("logging", ["_logger", "Log.", "ILogger"]),
    ("exception-flow", ["catch ", "throw ", "Exception"]),
]
#: Diagnostics and their rules (fixed values).
DIAGNOSTIC_RULES = {
    "CA2100": "GCI0012", "CA2101": "GCI0012", "CA2153": "GCI0012", "CA1031": "GCI0007", "CA2000": "GCI0024",
    "CA1001": "GCI0024", "CA1822": "GCI0008", "CA1062": "GCI0006", "CA2227": "GCI0015", "CA1819": "GCI0015",
}


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def duration_minutes(text: Column) -> Column:
    """24h, 7d, 30m, 2w as minutes; what is no positive number and unit counts as a day."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.nullif(F.regexp_extract(t, r"^(\d{1,9}).$", 1), F.lit("")).cast("bigint")
    unit = {"h": 60, "d": 1440, "m": 1, "w": 10080}
    minutes = F.coalesce(*[F.when(F.lower(F.substring(t, -1, 1)) == u, n * k) for u, k in unit.items()])
    return F.when(n > 0, F.coalesce(minutes, F.lit(1440))).otherwise(1440)


def percent(rate: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.bround(rate * 100, 0).cast("int").cast("string"), F.lit("%"))


def issue_key(text: Column) -> Column:
    """The first ABC-1, else abc-1, else #1 or GH-1, with its provider."""
    t = F.coalesce(text, F.lit(""))
    one = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    upper, lower, number = one(r"\b([A-Z][A-Z0-9]+-\d+)\b"), one(r"\b([a-z][a-z0-9]+-\d+)\b"), one(r"(?:#|GH-)(\d+)\b")
    provider = F.when(upper.isNotNull(), "Jira").when(lower.isNotNull(), "Linear").when(number.isNotNull(), "GitHub")
    return F.struct(F.coalesce(upper, lower, number).alias("key"), provider.alias("provider"))


def is_polarity_flip(before: Column, after: Column) -> Column:
    """Two conditions differ in negation, or one says `: false` where the other says `: true`."""
    negated = lambda c: c.startswith("!") | c.rlike(r"(?i)==\s*false\b|!=\s*true\b")
    says = lambda c, x: c.rlike(rf"(?i):\s*{x}\b")
    return (negated(before) != negated(after)) | (says(before, "false") & says(after, "true")) | (says(before, "true") & says(after, "false"))


def predicate_symbols(condition: Column) -> Column:
    """Distinct names Is... and called names of a condition."""
    called = F.transform(F.regexp_extract_all(condition, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda x: F.concat(x, F.lit("(")))
    return F.array_distinct(F.concat(F.regexp_extract_all(condition, F.lit(r"\b(Is[A-Z]\w+)\b"), F.lit(1)), called))


def evidence_snippet(evidence: Column) -> Column:
    """What follows the second colon; the whole where there are fewer."""
    parts = F.split(evidence, ":")
    return F.when(F.size(parts) > 2, F.trim(F.array_join(F.slice(parts, 3, 1 << 20), ":"))).otherwise(evidence)


def package_name(line: Column) -> Column:
    """Of a project's package reference, or of a lock file's entry; null on other lines."""
    project, lock = F.regexp_extract(line, r'<PackageReference\s+Include="([^"]+)"', 1), F.regexp_extract(line, r'^\s*"([A-Za-z][\w.-]*)":\s*\{', 1)
    return F.coalesce(F.nullif(project, F.lit("")), F.nullif(lock, F.lit("")))


def rule_id(text: Column) -> Column:
    """The rule id of any text that ends in digits: GCI and four digits."""
    return F.concat(F.lit("GCI"), F.lpad(F.regexp_extract(text, r"(\d{1,4})$", 1), 4, "0"))


def masked(evidence: Column) -> Column:
    """String bodies of an evidence as stars."""
    return F.regexp_replace(evidence, r'"[^"]*"', '"***"')


def tags(diff: Column) -> Column:
    """Sorted tags of a diff's text."""
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(diff, parts), F.lit(tag)) for tag, parts in TAGS])))


def diagnostic_rule(diagnostic: Column) -> Column:
    return F.coalesce(*[F.when(diagnostic == d, F.lit(r)) for d, r in DIAGNOSTIC_RULES.items()])


def target_framework(project: Column) -> Column:
    """The first framework of a project file, and whether it is version 8 or later."""
    found = F.nullif(F.regexp_extract(project, r"<TargetFrameworks?>\s*([^;<]+)", 1), F.lit(""))
    version = F.coalesce(F.nullif(F.regexp_extract(found, r"^net(\d+)\.\d", 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(F.trim(found).alias("framework"), (version >= 8).alias("modern"))


def without_token(items: Column, token: str) -> Column:
    """A `;` list without one token, and how many are left."""
    left = F.filter(F.split(items, ";"), lambda x: (F.trim(x) != token) & (F.trim(x) != ""))
    return F.struct(F.array_join(left, ";").alias("items"), F.size(left).alias("n"))


def label_of_reply(reply: Column) -> Column:
    """A model's reply as a label: fences cut, null unless all fields parse, inconclusive below 0.4."""
    body = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    p = F.from_json(body, "should_trigger boolean, confidence double, reason string")
    whole = p["should_trigger"].isNotNull() & p["confidence"].isNotNull() & p["reason"].isNotNull()
    return F.when(whole, F.struct(p["should_trigger"].alias("should_trigger"), p["confidence"].alias("confidence"), (p["confidence"] < 0.4).alias("is_inconclusive")))


def severity_setting(configured: Column, editor: Column, default: Column) -> Column:
    """The configured severity, else the editor's (error, warning, suggestion, none), else the default; ranks."""
    rank = lambda c: F.coalesce(*[F.when(F.lower(F.trim(c)) == n, F.lit(r)) for n, r in (("none", 0), ("info", 1), ("suggestion", 1), ("warn", 2), ("warning", 2), ("block", 3), ("error", 3), ("advisory", 4))])
    return F.coalesce(rank(configured), rank(editor), default)
