"""Signals of fixtures from any number of enrichers, put together in one exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of `corpus.composite_label`: their types, and what an enricher's several rows of a fixture come to.
SIGNALS = {
    "dependabot": ("boolean", "any"), "migration": ("boolean", "any"), "advisories": ("long", "sum"), "sonar": ("long", "sum"), "codeql": ("long", "sum"), "semgrep": ("long", "sum"),
    "social_score": ("double", "max"), "reviewers": ("long", "max"), "sensitive_path": ("boolean", "any"), "structural_score": ("double", "max"), "hotspot": ("double", "max"), "entropy": ("double", "max"),
    "test_gap": ("boolean", "any"), "empty_body": ("boolean", "any"), "unfinished": ("boolean", "any"), "first_contributor": ("boolean", "any"), "linked_issue": ("boolean", "any"), "nlp": ("boolean", "any"),
}
_HOW = {"any": F.bool_or, "sum": F.sum, "max": F.max}


def assemble(fixtures: DataFrame, enrichers: list[tuple[DataFrame, dict[str, Column]]], key: str = "fixture_id") -> DataFrame:
    """fixtures: key; enrichers: their rows (with key, any number a fixture) and the signals that each row gives. key and all of
    SIGNALS, one row a fixture of `fixtures`; a signal is null where no enricher gave one.

    The rows are one union, each with its own signals and nulls for the rest, so that a fixture's signals meet in one aggregate
    that combines before its exchange, however many enrichers there are: no join, and no fixture's rows are held. Rows of other
    fixtures are left out, repeated fixtures count once, and a null key is a fixture like any other. Raises on a signal that
    SIGNALS lacks.
    """
    unknown = {n for _, given in enrichers for n in given} - set(SIGNALS)
    if unknown:
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    row = lambda df, own, given: df.select(F.col(key), F.lit(own).alias("_own"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, (t, _) in SIGNALS.items()])
    rows = reduce(DataFrame.unionByName, [row(df, False, given) for df, given in enrichers], row(fixtures, True, {}))
    by = rows.groupBy(key).agg(F.bool_or("_own").alias("_own"), *[_HOW[how](n).alias(n) for n, (_, how) in SIGNALS.items()])
    return by.filter("_own").drop("_own")
