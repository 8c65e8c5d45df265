"""Labels of fixtures from all that speaks for a rule: strategies, review comments, commented files, then coordination.

Rows are reduced on their way: by fixture and path, by fixture and rule, and only then by fixture, where at most one entry a
rule is left. No step holds a fixture's raw rows, however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scoring import merge_labels

#: Coordinations in their order (fixed values): rules that must be positive, with the confidence that each must have; the
#: confidence to which positive labels are raised; the confidence at which negative labels turn positive.
COORDINATIONS = [
    ({"GCI0016": 0.0}, {"GCI0039": 0.80, "GCI0044": 0.75}, {"GCI0039": 0.70}),
    ({"GCI0032": 0.0, "GCI0003": 0.0}, {"GCI0003": 0.85, "GCI0032": 0.75}, {}),
    ({"GCI0032": 0.0, "GCI0016": 0.0}, {"GCI0016": 0.88, "GCI0032": 0.78}, {}),
    ({"GCI0024": 0.0, "GCI0015": 0.0}, {"GCI0024": 0.80, "GCI0015": 0.75}, {}),
    ({"GCI0015": 0.0, "GCI0029": 0.0}, {"GCI0015": 0.88, "GCI0029": 0.82}, {}),
    ({"GCI0012": 0.0, "GCI0015": 0.0}, {"GCI0012": 0.90, "GCI0015": 0.86}, {}),
    ({"GCI0044": 0.50, "GCI0035": 0.50}, {"GCI0044": 0.78, "GCI0035": 0.85}, {}),
    ({"GCI0039": 0.55, "GCI0048": 0.60}, {"GCI0039": 0.90, "GCI0048": 0.92}, {}),
    ({"GCI0045": 0.60, "GCI0016": 0.55}, {"GCI0045": 0.82, "GCI0016": 0.88}, {}),
]
#: Rules that have a heuristic (fixed values): only these take labels from commented files.
WITH_HEURISTICS = [
    "GCI0003", "GCI0004", "GCI0006", "GCI0010", "GCI0012", "GCI0015", "GCI0016", "GCI0021", "GCI0022", "GCI0024", "GCI0029", "GCI0032", "GCI0035", "GCI0036", "GCI0038",
    "GCI0039", "GCI0041", "GCI0042", "GCI0043", "GCI0044", "GCI0045", "GCI0046", "GCI0047", "GCI0048", "GCI0049", "GCI0050", "GCI0053",
]
#: Rules of the strategies (fixed values): they get a negative label where nothing speaks for them.
OF_STRATEGIES = ["GCI0003", "GCI0006", "GCI0012", "GCI0016", "GCI0021", "GCI0022", "GCI0024", "GCI0032", "GCI0035", "GCI0041", "GCI0042", "GCI0043", "GCI0044"]
#: Sources of labels that a person gave (fixed values).
OF_PEOPLE = ["HumanReview", "Manual", "Seed"]
CORRELATED, NEGATIVE = 0.55, 0.40


def _doubles(of: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair]).cast("map<string,double>")


def _settled(state: Column) -> Column:
    """A map of rule to (should_trigger, confidence, label_source) after all coordinations, in order."""
    steps = F.array(*[F.struct(_doubles(needs).alias("needs"), _doubles(floors).alias("floors"), _doubles(turns).alias("turns")) for needs, floors, turns in COORDINATIONS])

    def entry(step: Column, rule: Column, label: Column) -> Column:
        fires, floor, turn = label["should_trigger"] == 1, F.try_element_at(step["floors"], rule), F.try_element_at(step["turns"], rule)
        turned = ~fires & turn.isNotNull()
        return F.struct(
            F.when(turned, F.lit(1)).otherwise(label["should_trigger"]).alias("should_trigger"),
            F.when(turned, turn).when(fires, F.greatest(label["confidence"], floor)).otherwise(label["confidence"]).alias("confidence"),
            F.when(turned, F.lit("Heuristic")).otherwise(label["label_source"]).alias("label_source"),
        )

    def met(step: Column, labels: Column) -> Column:
        own = lambda need: F.try_element_at(labels, need["key"])
        return F.forall(F.map_entries(step["needs"]), lambda n: F.coalesce((own(n)["should_trigger"] == 1) & (own(n)["confidence"] >= n["value"]), F.lit(False)))

    return F.aggregate(steps, state, lambda labels, step: F.when(met(step, labels), F.transform_values(labels, lambda k, v: entry(step, k, v))).otherwise(labels))


def _by_fixture(labels: DataFrame, key: str) -> DataFrame:
    """labels: key, rule_id (null for a fixture of which only the key is known), _order, should_trigger, confidence,
    label_source. Of each rule the label with the highest _order, then a positive one, then the surest; as a map a fixture."""
    best = F.max(F.struct("_order", "should_trigger", "confidence", "label_source"))
    one = labels.groupBy(key, "rule_id").agg(best.alias("l"))
    item = F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", F.struct("l.should_trigger", "l.confidence", "l.label_source")))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(item)).alias("state"))


def _rows(by: DataFrame, key: str) -> DataFrame:
    return by.select(key, F.explode("state").alias("rule_id", "l")).select(key, "rule_id", "l.should_trigger", "l.confidence", "l.label_source")


def _typed(labels: DataFrame, key: str, order: int) -> DataFrame:
    return labels.select(
        key, "rule_id", F.lit(order).alias("_order"), F.coalesce(F.col("should_trigger").cast("int"), F.lit(0)).alias("should_trigger"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.col("label_source").cast("string").alias("label_source"),
    )


def coordinate(labels: DataFrame, key: str) -> DataFrame:
    """labels: key, rule_id, should_trigger, confidence, label_source. Each fixture's labels after COORDINATIONS.

    A rule's repeated labels count as one: a positive one, then the surest. A null should_trigger is negative, a null confidence
    0; labels without a rule are no labels. Rows with a null key are one fixture.
    """
    by = _by_fixture(_typed(labels.filter("rule_id is not null"), key, 0), key)
    return _rows(by.withColumn("state", _settled(F.col("state"))), key)


def _path(column: str) -> Column:
    return F.lower(F.translate(column, "\\", "/"))


def infer(fixtures: DataFrame, evidence: DataFrame, fired: DataFrame, commented: DataFrame, key: str) -> DataFrame:
    """fixtures: key; evidence: key, rule_id, confidence (what strategies and comments found); fired: key, rule_id, file_path
    (findings of a run); commented: key, file_path (files that a reviewer commented on).

    Of a rule the surest evidence counts. A rule of WITH_HEURISTICS without any is positive at CORRELATED where it fired on a
    commented file (separators and case don't matter). Then follow the coordinations, and a negative label at NEGATIVE for each
    rule of OF_STRATEGIES that is not positive. Rows of no fixture in `fixtures` make a fixture of their own. Null paths
    and rules say nothing.
    """
    none = F.lit(None).cast("string")
    heard = F.upper("rule_id").isin(WITH_HEURISTICS)
    places = fired.filter(heard).select(key, _path("file_path").alias("_path"), F.upper("rule_id").alias("rule_id"), F.lit(False).alias("_said")).unionByName(commented.select(key, _path("file_path").alias("_path"), none.alias("rule_id"), F.lit(True).alias("_said")))
    said = places.filter("_path is not null").groupBy(key, "_path").agg(F.collect_set("rule_id").alias("rules"), F.bool_or("_said").alias("_said")).filter("_said")
    of = lambda rows, rule, order, sure, source: rows.select(key, rule.alias("rule_id"), F.lit(order).alias("_order"), F.lit(1).alias("should_trigger"), sure.alias("confidence"), F.lit(source).alias("label_source"))
    rows = of(evidence.filter("rule_id is not null"), F.col("rule_id"), 2, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), "Heuristic")
    rows = rows.unionByName(of(said.select(key, F.explode("rules").alias("rule_id")), F.col("rule_id"), 1, F.lit(CORRELATED), "FilePathCorrelation"))
    by = _by_fixture(rows.unionByName(of(fixtures, none, 0, F.lit(0.0), "Heuristic")), key).withColumn("state", _settled(F.col("state")))
    positive = F.map_filter("state", lambda k, v: v["should_trigger"] == 1)
    silent = F.filter(F.lit(OF_STRATEGIES), lambda r: ~F.map_contains_key(positive, r))
    negative = F.struct(F.lit(0).alias("should_trigger"), F.lit(NEGATIVE).alias("confidence"), F.lit("Heuristic").alias("label_source"))
    kept = F.map_filter("state", lambda k, v: ~F.array_contains(silent, k))
    return _rows(by.withColumn("state", F.map_concat(kept, F.map_from_arrays(silent, F.transform(silent, lambda r: negative)))), key)


def merged(existing: DataFrame, inferred: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Both: key, rule_id, should_trigger, confidence, label_source. Inferred labels replace existing ones but those that a
    person gave; with overwrite they replace these too, and heuristic labels of rules outside OF_STRATEGIES go."""
    columns = [key, "rule_id", "should_trigger", "confidence", "label_source"]
    stale = F.coalesce((F.col("label_source") == "Heuristic") & ~F.col("rule_id").isin(OF_STRATEGIES), F.lit(False))
    old = existing.filter(~stale) if overwrite else existing
    return merge_labels(old.select(columns), inferred.select(columns), [key, "rule_id"], [] if overwrite else OF_PEOPLE)
