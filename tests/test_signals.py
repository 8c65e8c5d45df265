"""Signals put together: what repeated rows come to, missing enrichers, one exchange."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from riskloom.operators import signals
from riskloom.plans import catalog


def _of(spark, rows, schema):
    return spark.createDataFrame(rows, "fixture_id int, " + schema)


def test_assembly(spark):
    fixtures = spark.createDataFrame([(1,), (2,), (2,), (None,)], "fixture_id int")
    alerts = _of(spark, [(1, 1), (1, 1), (2, None), (9, 1), (None, 1)], "x int")
    social = _of(spark, [(1, 0.2), (1, 0.6), (2, None)], "score double")
    body = _of(spark, [(1, False), (2, None), (2, True)], "empty boolean")
    found = {r.fixture_id: r for r in signals.assemble(fixtures, [(alerts, {"sonar": F.col("x")}), (social, {"social_score": F.col("score")}), (body, {"empty_body": F.col("empty")})]).collect()}
    assert set(found) == {1, 2, None}
    assert {k: (r.sonar, r.social_score, r.empty_body, r.nlp) for k, r in found.items()} == {1: (2, 0.6, False, None), 2: (None, None, True, None), None: (1, None, None, None)}
    assert signals.assemble(fixtures.limit(0), [(alerts, {"sonar": F.col("x")})]).count() == 0
    assert signals.assemble(fixtures, []).filter("sonar is null").count() == 3
    with pytest.raises(ValueError):
        signals.assemble(fixtures, [(alerts, {"sonars": F.col("x")})])


def test_one_exchange(spark):
    plan = catalog.QUERIES["assembled_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_max" in plan
