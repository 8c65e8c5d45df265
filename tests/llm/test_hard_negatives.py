"""Hard negatives against all products, the trees against plain top lists."""

import math

import duckdb
import numpy as np
import pytest
from conftest import SF
from riskloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row int, dim string, id long, block int"


def brute(rows):
    """rows: (vec_id, embedding, label), as the query reads them."""
    points = []
    for vec_id, e, label in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            points.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    last = lambda v: hn.NO_ID if v is None else v
    out = []
    for i, (a, la, x) in enumerate(points):
        if a is None or a % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), v, lb) for j, (v, lb, y) in enumerate(points) if i != j and len(x) == len(y)]
        order = lambda r: (-r[0], last(r[1]))
        for s, v, _ in sorted((r for r in scored if r[2] == la), key=order)[:5]:
            window = sorted((r for r in scored if r[2] != la and 50 * s <= 100 * r[0] <= 95 * s), key=order)[:3]
            out += [(a, v, k + 1, w, s, t) for k, (t, w, _) in enumerate(window)]
    return sorted(out, key=str)


def result(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()), key=str)


def close_rows(n, dim=6, labels=4, seed=5):
    """Clustered vectors with many ties, so that windows hold rows of other labels."""
    r = np.random.default_rng(seed)
    return [(i, [float(v) for v in np.round(r.normal(1, 0.5, dim), 1)], int(r.integers(0, labels))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, n in (("TREE_ROWS", 50), ("LEAF_ROWS", 4), ("BLOCK_ROWS", 3), ("TREES_AT_ONCE", 2), ("BUCKET_TREES", 10)):
        monkeypatch.setattr(hn, name, n)


def test_against_all_products(spark, tmp_path):
    """Nulls, values that aren't finite, other lengths, repeated rows and ids, ties, null ids, a hot label."""
    rows = close_rows(600) + [(10_000 + i, [1.0] * 6, 1) for i in range(300)] + [(50, [1.5] * 6, 2)] * 3 + [(100, [1.0] * 6, 1)] * 2
    rows += [(None, [2.0] * 6, 1), (None, [0.9] * 6, 3), (150, None, 1), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (250, [1.0] * 6, None), (300, [float("nan")] * 6, 1), (350, [float("inf")] * 6, 1)]
    rows += [(400, [1.0, 2.0], 1), (401, [1.0, 2.1], 1), (402, [1.0, 1.5], 2), (450, [], 1), (451, [], 1), (452, [], 2), (500, [-1.0] * 6, 7), (-50, [1.0] * 6, 0)]
    found = result(spark, tmp_path, rows)
    assert found == brute(rows) and len(found) > 100


def test_small_trees(spark, tmp_path, small):
    """Trees, blocks and groups of a few rows give the same."""
    rows = close_rows(1500, labels=40) + [(20_000 + i, [1.0] * 6, 3) for i in range(200)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_empty(spark, tmp_path):
    assert result(spark, tmp_path, []) == []


def test_anchors_alone(spark, tmp_path):
    assert result(spark, tmp_path, [(0, [1.0], 1), (50, [1.0], 2)]) == []


def test_scores_beyond_the_range_raise(spark, tmp_path):
    with pytest.raises(Exception, match="don't fit 62 bits"):
        result(spark, tmp_path, [(50, [1e15, 1e15], 1), (51, [1e15, 1e15], 1)])


def test_large_scores_stay_exact(spark, tmp_path):
    rows = [(50, [float(2**20 + 1), 1.0], 1), (51, [float(2**20 + 1), 3.0], 1), (53, [float(2**19 + 2**17 + 1), 1.0], 2), (54, [float(2**19 + 2**17 + 1), 2.0], 2)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_sql(spark, tmp_path):
    rows = close_rows(500)
    result(spark, tmp_path, rows)
    for at, source in ((SF, f"'{SF}/embeddings.parquet'"), (tmp_path, f"'{tmp_path}/embeddings.parquet/*.parquet'")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM {source}")
        rel = con.sql(hn.OP13_SQL)
        df = hn.op13_hard_negatives(spark, str(at))
        assert set(df.columns) == set(rel.columns)
        assert sorted(map(tuple, df.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_nodes_are_pruned():
    """A search in clustered rows takes far fewer products than there are, and finds the same."""
    r = np.random.default_rng(1)
    centres = r.normal(0, 300, (16, 8))
    x = (np.repeat(centres, 128, 0) + r.normal(0, 4, (2048, 8))).astype(np.int64)
    ids, labels = r.permutation(2048), np.arange(2048) % 2
    t = hn.Tree(x, ids, labels, np.arange(2048))
    q, best = x[::64], hn.Best(32, 5)
    taken = hn.searched(t, q, labels[::64], np.arange(0, 2048, 64), best, None)
    assert taken < 0.3 * q.shape[0] * len(x)
    for k, row in enumerate(range(0, 2048, 64)):
        want = sorted((-int(q[k] @ x[j]), int(ids[j])) for j in range(2048) if j != row and labels[j] == labels[row])[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[k], best.id[k], strict=True)] == want
    windows = np.stack([best.score // 2, best.score * 95 // 100])
    other = hn.Best(32 * 5, 3)
    taken = hn.searched(t, q, labels[::64], np.arange(0, 2048, 64), other, (windows[0], windows[1]))
    assert taken < 0.5 * q.shape[0] * len(x)
