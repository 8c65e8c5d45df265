"""Label scoring: latest runs, confusion matrices, scorecards, drift; all as grouped plans over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    own = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").drop("_rn")


def latest_completed_run(runs: DataFrame) -> DataFrame:
    """runs: id, fixture_id, completed_at_utc, status. The text timestamps decide, then the id."""
    return latest_per_key(runs.filter(F.upper("status") == "COMPLETED"), "fixture_id", F.desc("completed_at_utc"), F.desc("id"))


def labelled_pairs(expected: DataFrame, runs: DataFrame, actual: DataFrame) -> DataFrame:
    """One verdict for each (rule, fixture, expectation) in the fixtures' latest runs; a finding that is missing counts as none."""
    latest = latest_completed_run(runs).select("fixture_id", F.col("id").alias("run_id"))
    usable = expected.filter(F.coalesce("is_inconclusive", F.lit(0)) == 0).select("fixture_id", "rule_id", "should_trigger")
    fired = actual.select("fixture_id", "rule_id", "run_id", "did_trigger")
    met = usable.join(latest, "fixture_id").join(fired, ["fixture_id", "rule_id", "run_id"], "left")
    return met.groupBy("rule_id", "fixture_id", "should_trigger").agg(F.coalesce(F.max("did_trigger"), F.lit(0)).alias("did_trigger"))


def ratio(part: Column, whole: Column) -> Column:
    """Null where the denominator is 0; three places, half to even."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 3)


def confusion_matrix(pairs: DataFrame, *by: str) -> DataFrame:
    """pairs: should_trigger and did_trigger (0 or 1)."""
    hit = lambda s, d: F.count_if((F.col("should_trigger") == s) & (F.col("did_trigger") == d))
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("labeled"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))


def classify_outcomes(expected: DataFrame, fired: DataFrame) -> DataFrame:
    """Full outer meeting of labels and fired rules: TP, FP, FN, TN, or Unknown where no label exists."""
    labels = expected.filter(F.coalesce("is_inconclusive", F.lit(0)) == 0).select("fixture_id", "rule_id", "should_trigger")
    met = labels.join(fired.select("fixture_id", "rule_id", F.lit(1).alias("fired")).distinct(), ["fixture_id", "rule_id"], "full_outer")
    should, did = F.col("should_trigger") == 1, F.col("fired").isNotNull()
    status = F.when(F.col("should_trigger").isNull(), "Unknown").when(should & did, "TP").when(should, "FN").when(did, "FP").otherwise("TN")
    return met.select("fixture_id", "rule_id", status.alias("status"))


def scorecard(outcomes: DataFrame, fixtures: DataFrame, usefulness: DataFrame) -> DataFrame:
    """Per (rule, tier): counts, labelled total, trigger rate over the tier's fixtures, precision and recall (0 where undefined)."""
    tiers = fixtures.groupBy("tier").agg(F.countDistinct("fixture_id").alias("tier_fixtures"))
    count = lambda s: F.count_if(F.col("status") == s)
    by = outcomes.join(fixtures.select("fixture_id", "tier"), "fixture_id").groupBy("rule_id", "tier")
    out = by.agg(*[count(s).alias(s.lower()) for s in ("TP", "FP", "FN", "TN", "Unknown")], F.countDistinct(F.when(F.col("status").isin("TP", "FP", "Unknown"), F.col("fixture_id"))).alias("fired_fixtures"))
    out = out.join(tiers, "tier").join(usefulness.groupBy("rule_id").agg(F.avg("usefulness").alias("avg_usefulness")), "rule_id", "left")
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return out.select(
        "rule_id", "tier", "tp", "fp", "fn", "tn", "unknown", (c("tp") + c("fp") + c("fn") + c("tn")).alias("labeled"), zero(c("fired_fixtures"), c("tier_fixtures")).alias("trigger_rate"),
        zero(c("tp"), c("tp") + c("fp")).alias("precision"), zero(c("tp"), c("tp") + c("fn")).alias("recall"), F.coalesce("avg_usefulness", F.lit(0.0)).alias("avg_usefulness"),
    )


def drift(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between two metric tables, over shared keys only: key, field, before, after."""
    b = before.select(key, *[F.col(f).cast("double").alias(f"b_{f}") for f in fields])
    met = b.join(after.select(key, *[F.col(f).cast("double").alias(f"a_{f}") for f in fields]), key)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields])).alias("d")
    return met.select(key, rows).select(key, "d.*").filter(~F.col("before").eqNullSafe(F.col("after")))


def entropy(df: DataFrame, by: str, item: str, weight: Column) -> DataFrame:
    """Shannon entropy in bits of the items' weights, normalised by log2 of their number (0 for one item)."""
    parts = df.groupBy(by, item).agg(F.sum(weight).alias("w")).filter("w > 0")
    total = parts.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(by)))
    out = total.groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("n_items"))
    bits = F.when(F.col("n_items") <= 1, 0.0).otherwise(F.round("h", 6))
    return out.select(by, "n_items", bits.alias("entropy"), F.when(F.col("n_items") <= 1, 0.0).otherwise(F.round(F.col("h") / F.log2("n_items"), 6)).alias("normalised"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, nearest-rank 95th percentile and upper median (sorted[n div 2])."""
    own = Window.partitionBy(by).orderBy(value)
    ranked = df.select(by, value, F.row_number().over(own).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"))
    pick = lambda at: F.max(F.when(F.col("rn") == at, F.col(value)))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), pick(F.ceil(F.col("n") * 95 / 100)).alias("p95"), pick(F.expr("n div 2 + 1")).alias("upper_median"))


def merge_labels(old: DataFrame, new: DataFrame, key: list[str], protected: list[str]) -> DataFrame:
    """Labels by key, later wins, but a protected source survives."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    keep = (F.col("_new") == 0) & F.col("label_source").isin(protected)
    return latest_per_key(both.withColumn("_first", keep.cast("int")), key, F.desc("_first"), F.desc("_new"), F.desc("confidence"), F.asc("label_source")).drop("_first", "_new")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Last write wins: rows of new replace those of old with the same key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """First write wins: only rows of new whose key is absent are added."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def islands(df: DataFrame, by: str, order: list[str], value: str, least: int) -> DataFrame:
    """Runs of at least `least` equal values that a different value closes: by, value, run_length, run_start (of order[0])."""
    seq = Window.partitionBy(by).orderBy(*order)
    same = Window.partitionBy(by, value).orderBy(*order)
    marked = df.select(by, value, *order, F.row_number().over(seq).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"), (F.row_number().over(seq) - F.row_number().over(same)).alias("island"))
    runs = marked.groupBy(by, value, "island").agg(F.count(F.lit(1)).alias("run_length"), F.min(order[0]).alias("run_start"), F.max("rn").alias("last"), F.max("n").alias("n"))
    return runs.filter((F.col("run_length") >= least) & (F.col("last") < F.col("n"))).select(by, value, "run_length", "run_start")


def diversified(df: DataFrame, group: str, cap: int, most: int, *order: Column) -> DataFrame:
    """The first `most` rows in the order, with at most `cap` of each group."""
    own = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= cap).drop("_rn").orderBy(*order).limit(most)
