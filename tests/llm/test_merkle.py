"""The Merkle manifest against a plain walk over nested lists."""

import hashlib
import zlib

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F
from riskloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, n long, hash string, key string, path string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def runs(nodes):
    """Levels of digests up to a single one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def walked(levels, i, at):
    """The siblings of node i up to the top, and what `at` in its place gives."""
    proof = ""
    for level in levels[:-1]:
        a = i // 16 * 16
        left, right = "".join(level[a:i]), "".join(level[i + 1 : a + 16])
        proof, at, i = proof + left + right, sha(left + at + right), i // 16
    return proof, at


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in names:
        trees[t].sort(key=lambda x: x[:3])
    grown = {t: runs([x[2] for x in trees[t]]) for t in names}
    top = runs([grown[t][-1][0] for t in names]) if names else []
    out = []
    for k, t in enumerate(names):
        for i, (_, _, h, r) in enumerate(trees[t]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            proof, at = walked(grown[t], i, leaf(*r[:4], lowered(r[4])) if hit else h)
            more, at = walked(top, k, at)
            out.append((r[0], h, grown[t][-1][0], top[-1][0], sha(proof + more), at, at == top[-1][0]))
    return sorted(out, key=str)


def found(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "a", 1, 2, "b", "c", "d") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11_merkle(spark, str(tmp_path))


AWKWARD = [
    (None, None, None, None, None), (None, None, None, None, None), (1, None, "en", 3, "ABC"), (2, "", "en", None, ""), (2, "", "en", None, ""), (10, "é", None, -5, "É ÀB"),
    (15, "z", "de", 9, "no capitals"), (-3, "z", "de", 9, "X" * 70_000), (4, "=", "-", 1, None), (5, "-", "x:1", 1, "1:2"),
]


@pytest.mark.parametrize("more", [0, 16, 17, 300])
def test_against_plain_lists(spark, tmp_path, more):
    """With sources of one row, of one full run, of one row more, of three levels; ties, nulls and repeated rows."""
    rows = AWKWARD + [(1000 + i, "hot", "en", i, f"Row {i % 40}") for i in range(more)] + [(7, "hot", "en", 1, "same")] * (more // 10) + [(k, f"s{k:02}", "en", 1, "T") for k in range(more // 5)]
    df = found(spark, tmp_path, rows)
    assert sorted(map(tuple, df.collect()), key=str) == brute(rows)


def test_empty(spark, tmp_path):
    assert found(spark, tmp_path, []).count() == 0


def test_single_row(spark, tmp_path):
    """A lone leaf is its subroot and the root; its proof is empty."""
    (r,) = found(spark, tmp_path, [(5, "a", "en", 1, "Text")]).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = merkle.op11_merkle(spark, SF)
    rel = con.sql(merkle.OP11_SQL)
    rows = sorted(map(tuple, df.select(*rel.columns).collect()), key=str)
    assert rows == sorted(rel.fetchall(), key=str) and {r[-1] for r in rows} == {True, False}


def test_places_are_even_where_one_source_holds_all(spark, tmp_path):
    """Ranges part a source, and rows that repeat a key, into even shares."""
    nodes = spark.range(20_000).select(F.lit("=s").alias("tree"), F.lit(1).alias("key"), F.lit("h").alias("hash"))
    rows = merkle.placed(nodes, str(tmp_path), "rows")
    assert rows.agg(F.countDistinct("idx"), F.max("idx"), F.min("n")).first() == (20_000, 19_999, 20_000)
    parts = [r[1] for r in spark.read.parquet(f"{tmp_path}/rows").groupBy("part").count().collect()]
    assert len(parts) >= 4 and max(parts) < 2 * 20_000 / len(parts)
