"""Labels from evidence and their coordination: stated cases."""

import pytest
from riskloom.operators import labels

SCHEMA = "id int, rule_id string, should_trigger int, confidence double, label_source string"

#: Labels of a fixture (rule, should_trigger, confidence) and what becomes of them.
CASES = [
    # blocking calls raise two others, and turn only the first of them
    ([("GCI0016", 1, 0.65), ("GCI0039", 1, 0.65), ("GCI0044", 1, 0.60)], [("GCI0016", 1, 0.65), ("GCI0039", 1, 0.80), ("GCI0044", 1, 0.75)]),
    ([("GCI0016", 1, 0.65), ("GCI0039", 0, 0.40), ("GCI0044", 0, 0.40)], [("GCI0016", 1, 0.65), ("GCI0039", 1, 0.70), ("GCI0044", 0, 0.40)]),
    ([("GCI0016", 0, 0.40), ("GCI0039", 1, 0.65), ("GCI0044", 1, 0.60)], [("GCI0016", 0, 0.40), ("GCI0039", 1, 0.65), ("GCI0044", 1, 0.60)]),
    # what is surer already stays
    ([("GCI0016", 1, 0.65), ("GCI0039", 1, 0.85)], [("GCI0016", 1, 0.65), ("GCI0039", 1, 0.85)]),
    # swallowed exceptions, with a break, and then with blocking calls
    ([("GCI0032", 1, 0.60), ("GCI0003", 1, 0.65)], [("GCI0003", 1, 0.85), ("GCI0032", 1, 0.75)]),
    ([("GCI0032", 1, 0.60), ("GCI0003", 1, 0.65), ("GCI0016", 1, 0.65)], [("GCI0003", 1, 0.85), ("GCI0016", 1, 0.88), ("GCI0032", 1, 0.78)]),
    ([("GCI0032", 1, 0.60), ("GCI0003", 0, 0.40)], [("GCI0003", 0, 0.40), ("GCI0032", 1, 0.60)]),
    # leaks, personal data and secrets with unchecked data; the last doesn't lower the one before
    ([("GCI0024", 1, 0.65), ("GCI0015", 1, 0.60)], [("GCI0015", 1, 0.75), ("GCI0024", 1, 0.80)]),
    ([("GCI0029", 1, 0.70), ("GCI0015", 1, 0.60), ("GCI0012", 1, 0.75)], [("GCI0012", 1, 0.90), ("GCI0015", 1, 0.88), ("GCI0029", 1, 0.82)]),
    ([("GCI0012", 1, 0.75), ("GCI0015", 1, 0.60)], [("GCI0012", 1, 0.90), ("GCI0015", 1, 0.86)]),
    # these need some confidence of their own
    ([("GCI0044", 1, 0.50), ("GCI0035", 1, 0.50)], [("GCI0035", 1, 0.85), ("GCI0044", 1, 0.78)]),
    ([("GCI0044", 1, 0.49), ("GCI0035", 1, 0.65)], [("GCI0035", 1, 0.65), ("GCI0044", 1, 0.49)]),
    ([("GCI0044", 1, 0.60)], [("GCI0044", 1, 0.60)]),
    ([("GCI0039", 1, 0.55), ("GCI0048", 1, 0.60)], [("GCI0039", 1, 0.90), ("GCI0048", 1, 0.92)]),
    ([("GCI0039", 1, 0.65), ("GCI0048", 1, 0.59)], [("GCI0039", 1, 0.65), ("GCI0048", 1, 0.59)]),
    ([("GCI0045", 1, 0.60), ("GCI0016", 1, 0.55)], [("GCI0016", 1, 0.88), ("GCI0045", 1, 0.82)]),
    ([("GCI0045", 1, 0.55), ("GCI0016", 1, 0.65)], [("GCI0016", 1, 0.65), ("GCI0045", 1, 0.55)]),
    # one leads to the next: a turned label, raised and then met by a later coordination
    ([("GCI0016", 1, 0.65), ("GCI0039", 0, 0.40), ("GCI0048", 1, 0.70)], [("GCI0016", 1, 0.65), ("GCI0039", 1, 0.90), ("GCI0048", 1, 0.92)]),
    # a rule twice: the positive one, then the surest; nulls are negative and 0
    ([("GCI0016", 1, 0.40), ("GCI0016", 1, 0.65), ("GCI0016", 0, 0.9), ("GCI0044", None, None)], [("GCI0016", 1, 0.65), ("GCI0044", 0, 0.0)]),
    ([(None, 1, 0.9), ("X", 1, 0.3)], [("X", 1, 0.3)]),
]


def test_coordinations(spark):
    rows = [(k, *label, "Heuristic") for k, (given, _) in enumerate(CASES) for label in given]
    found = {}
    for r in labels.coordinate(spark.createDataFrame(rows, SCHEMA), "id").collect():
        found.setdefault(r.id, []).append((r.rule_id, r.should_trigger, r.confidence))
    assert {k: sorted(v) for k, v in found.items()} == {k: want for k, (_, want) in enumerate(CASES)}


def test_source_of_a_turned_label(spark):
    rows = [(1, "GCI0016", 1, 0.65, "Seed"), (1, "GCI0039", 0, 0.4, "Seed"), (1, "GCI0044", 1, 0.6, "Seed")]
    found = {r.rule_id: r.label_source for r in labels.coordinate(spark.createDataFrame(rows, SCHEMA), "id").collect()}
    assert found == {"GCI0016": "Seed", "GCI0039": "Heuristic", "GCI0044": "Seed"}


def _infer(spark, fixtures=(), evidence=(), fired=(), commented=()):
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = labels.infer(
        made([(f,) for f in fixtures], "id int"), made(evidence, "id int, rule_id string, confidence double"), made(fired, "id int, rule_id string, file_path string"),
        made(commented, "id int, file_path string"), "id",
    )
    return {(r.id, r.rule_id): (r.should_trigger, r.confidence, r.label_source) for r in out.collect()}


def test_fixtures_without_evidence_get_negatives(spark):
    found = _infer(spark, [1, None])
    assert found == {(f, r): (0, 0.4, "Heuristic") for f in (1, None) for r in labels.OF_STRATEGIES}
    assert _infer(spark) == {}


def test_evidence_and_commented_files(spark):
    fired = [(1, "gci0048", "src\\A.cs"), (1, "GCI0016", "src/a.cs"), (1, "GCI0099", "src/a.cs"), (1, "GCI0042", "src/B.cs"), (1, "GCI0041", None), (2, "GCI0048", "src/a.cs")]
    found = _infer(spark, [1, 2], [(1, "GCI0016", 0.55), (1, "GCI0016", 0.65), (1, "GCI0039", None), (1, None, 0.9)], fired, [(1, "SRC/a.cs"), (1, "src/a.cs"), (1, None), (3, "x")])
    positive = {k: v for k, v in found.items() if v[0] == 1}
    # found by the strategies: the surest counts, and the commented file adds nothing to it; 0039 is raised by 0016 and stays below the need of 0048
    assert positive == {(1, "GCI0016"): (1, 0.65, "Heuristic"), (1, "GCI0039"): (1, 0.8, "Heuristic"), (1, "GCI0048"): (1, 0.55, "FilePathCorrelation")}
    assert (1, "GCI0016") not in {k for k, v in found.items() if v[0] == 0} and found[(1, "GCI0042")] == (0, 0.4, "Heuristic") and found[(2, "GCI0016")] == (0, 0.4, "Heuristic")


@pytest.mark.parametrize("overwrite", [False, True])
def test_merge(spark, overwrite):
    old = [(1, "GCI0016", 1, 0.9, "Manual"), (1, "GCI0006", 1, 0.9, "Heuristic"), (1, "GCI0050", 1, 0.6, "Heuristic"), (1, "GCI0001", 1, 0.6, "Seed")]
    new = [(1, "GCI0016", 0, 0.4, "Heuristic"), (1, "GCI0006", 0, 0.4, "Heuristic"), (1, "GCI0042", 0, 0.4, "Heuristic")]
    out = labels.merged(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), "id", overwrite)
    found = {r.rule_id: r.label_source + str(r.should_trigger) for r in out.collect()}
    want = {"GCI0006": "Heuristic0", "GCI0042": "Heuristic0", "GCI0001": "Seed1", "GCI0016": "Heuristic0" if overwrite else "Manual1"}
    assert found == (want if overwrite else want | {"GCI0050": "Heuristic1"})


def test_no_task_holds_a_fixtures_rows(spark):
    """Every aggregate combines before its exchange, and no window is used."""
    plan = labels.coordinate(spark.createDataFrame([], SCHEMA), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan
