"""Corpus signals and text taxonomies as column expressions and grouped plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CANDIDATES = 10_000
#: Keyword groups of review comments, in order: rule, keywords (the first that occurs counts), confidence (fixed values).
TAXONOMY = [
    ("GCI0016", ["race condition", "thread safe", "concurrent access", "not thread-safe", "lock contention"], 0.7),
    ("GCI0016", ["deadlock", "async over sync", ".result", ".wait()", "blocking call", "configureawait"], 0.7),
    ("GCI0043", ["null reference", "nullreferenceexception", "can this be null", "null check missing"], 0.65),
    ("GCI0024", ["memory leak", "not disposed", "should be disposed", "idisposable", "using statement"], 0.65),
    ("GCI0012", ["security", "injection", "xss", "csrf", "authentication bypass", "authorization"], 0.7),
    ("GCI0004", ["breaking change", "backwards compat", "backward compat", "api break", "semver"], 0.65),
    ("GCI0010", ["hardcoded", "hard-coded", "magic number", "magic string", "should use config"], 0.6),
    ("GCI0032", ["unhandled exception", "exception propagation", "missing catch", "uncaught"], 0.65),
    ("GCI0044", ["performance", "hot path", "n+1", "allocation", "boxing", "linq in loop"], 0.6),
    ("GCI0029", ["pii", "personal data", "gdpr", "sensitive data", "user data in log"], 0.7),
    ("GCI0041", ["missing test", "needs test", "add a test", "no test coverage", "untested"], 0.65),
    ("GCI0003", ["behavioral change", "side effect", "unexpected behavior", "regression"], 0.6),
    ("GCI0049", ["floating point", "float equality", "double equality", "use epsilon"], 0.65),
    ("GCI0021", ["schema change", "migration", "db schema", "database schema", "column removed"], 0.7),
]


def taxonomy_hits(df: DataFrame, key: str, text: Column, groups: list[tuple[str, list[str], float]] | None = None) -> DataFrame:
    """key, rule_id, keyword, confidence: of each group its first keyword that the text holds, of each rule its first group."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for order, (rule, words, sure) in enumerate(TAXONOMY if groups is None else groups):
        word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words])
        found.append(F.when(word.isNotNull(), F.struct(F.lit(order).alias("o"), F.lit(rule).alias("rule_id"), word.alias("keyword"), F.lit(sure).alias("confidence"))))
    rows = df.select(key, F.explode(F.array_compact(F.array(*found))).alias("h")).select(key, "h.*")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, "rule_id").orderBy("o"))).filter("rn = 1").drop("rn", "o")


def social_score(minutes: Column, reviewers: Column, reviews: Column, bot_merged: Column) -> Column:
    """From one half, by time to merge (negative: unknown), human reviewers, number of reviews and merge by a bot; between 0 and 1."""
    time = F.when((minutes >= 0) & (minutes < 10), -0.3).when(minutes >= 60, 0.15).otherwise(0.0)
    people = F.when(reviewers == 0, -0.25).when(reviewers == 1, 0.1).otherwise(0.2)
    count = F.when(reviews == 0, -0.1).when(reviews >= 3, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + time + people + count - F.when(bot_merged, 0.15).otherwise(0.0)))


def experience_tier(commits: Column) -> Column:
    n = F.least(commits, F.lit(1000))
    return F.when(n == 0, "none").when(n <= 5, "low").when(n <= 50, "medium").otherwise("high")


def hotspot(commits: Column) -> Column:
    return F.least(commits / 30.0, F.lit(1.0))


def issue_references(text: Column) -> Column:
    """Distinct issue numbers that a text closes, fixes or resolves, ascending."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+(?:[\w.-]+/[\w.-]+)?#(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("long"))))


def closest(words: DataFrame, candidates: DataFrame, most: int = 2) -> DataFrame:
    """words: word; candidates: candidate (a vocabulary of MOST_CANDIDATES commands at most). The nearest within `most` edits."""
    if candidates.distinct().limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    d = F.levenshtein(F.lower("word"), F.lower("candidate"), most)
    near = words.join(F.broadcast(candidates.distinct()), d >= 0).withColumn("distance", d)
    return near.withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))).filter("rn = 1").drop("rn")


def closest_n(words: DataFrame, candidates: DataFrame, n: int, most: int = 2) -> DataFrame:
    """Like closest, but the first n that differ from the word."""
    if candidates.distinct().limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    d = F.levenshtein(F.lower("word"), F.lower("candidate"), most)
    near = words.join(F.broadcast(candidates.distinct()), d > 0).withColumn("distance", d)
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= n)
