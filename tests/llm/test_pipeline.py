"""The pipeline's stages against brute force on small tables."""

import itertools
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from riskloom.llm import decontaminate, exact_dedup, jaccard_join, quality
from riskloom.llm.bpe import encoder, vocabulary_path
from riskloom.llm.common import table


def test_stages_decide_by_their_operators(spark):
    docs, ids = table(spark, SF, "documents"), lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == columns
    assert ids(kept) == {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).collect() if r.predicted == 1}
    once = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert once.columns == columns and ids(once) == {r.doc_id for r in exact_dedup.exact_dedup(docs).collect() if r.kept}
    near = corpus_pipeline.near_duplicate_stage(spark, once, SF)
    assert ids(near) == {r.component_id for r in jaccard_join.jaccard_components(once).collect()} and near.columns == columns
    clean = corpus_pipeline.decontamination_stage(spark, near, SF)
    assert ids(clean) == {r.doc_id for r in decontaminate.report(near, table(spark, SF, "benchmark")).collect() if not r.contaminated}


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (1, "a b c", "en"), (None, "x y", None), (2, "A B C", "en"), (2, "A B C", "en"), (3, None, "de"), (4, "", "de")], "doc_id long, text string, lang string")
    out = corpus_pipeline.dedup_stage(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("2", "A B C"), ("4", ""), ("None", "x y")]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_an_id_are_decided_one_by_one(spark):
    schema = "doc_id long, text string, row string"
    text = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    item = next(r.text for r in table(spark, SF, "benchmark").collect() if r.text and len(r.text.split()) > 12)
    mixed = [(d, t, "r") for d in (None, 7) for t in (f"clean words of {d}", item, None)]
    clean = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(mixed, schema), SF)
    assert clean.columns == ["doc_id", "text", "row"]
    assert text(clean) == sorted((str(d), str(t)) for d, t, _ in mixed if t != item)
    words = [f"w{i}" for i in range(60)]
    near = [(d, " ".join([*words, *(["end"] * k)]), "r") for d in (None, 7) for k in (0, 1)] + [(None, " ".join([f"v{i}" for i in range(50 + k)]), "r") for k in (0, 1, 2)]
    left = text(corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(near, schema), SF))
    assert [d for d, _ in left] == ["7", "None"] and left[0][1].startswith("w0") and left[1][1].startswith("v0")
    docs = table(spark, SF, "documents")
    judged = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, SF, "labels")).collect()}
    known = table(spark, SF, "labels").select("doc_id")
    hot = docs.join(known, "doc_id", "left_anti").withColumn("was", docs.doc_id).withColumn("doc_id", F.lit(None).cast("long"))
    both = docs.join(known, "doc_id", "left_semi").withColumn("was", docs.doc_id).unionByName(hot)
    kept = {r.was for r in corpus_pipeline.quality_stage(spark, both, SF).collect()}
    assert set(judged.values()) == {0, 1} and kept == {d for d, p in judged.items() if p == 1}


LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))


def _awkward(spark, item):
    """Equal texts in other case, near copies, benchmark passages, nulls, ties, repeated rows, a very long text, and
    columns named like those that the stages make."""
    near = [f"t{i}" for i in range(80)]
    texts = [(1, "Some plain words here"), (2, "SOME plain words HERE"), (2, "some plain words here"), (None, "some plain words here"), (3, " ".join(near)), (4, " ".join([*near, "end"])),
             (5, f"before {item} after"), (6, None), (7, ""), (8, LONG), (9, LONG + " tail"), (10, "x"), (10, "x"), (None, None), (11, "Ünïcode \u0130 words")]
    return spark.createDataFrame([(d, t, "k", 5, "n", 1.5, "s") for d, t in texts], "doc_id long, text string, row string, n int, _norm string, size double, last string"), texts


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


def test_stages_on_awkward_rows_against_brute_force(spark):
    bench = [r.text for r in table(spark, SF, "benchmark").collect() if r.text]
    item = next(t for t in bench if len(_words(t)) > 12)
    docs, rows = _awkward(spark, item)
    row = lambda r: (str(r.doc_id), str(r.text))
    found = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert found.columns == docs.columns
    by_text = {}
    for d, t in rows:
        by_text.setdefault((t or "").encode().lower(), []).append((d is not None, d or 0, t))
    kept = {t: max(group, key=lambda g: g[:2]) for t, group in by_text.items()}
    got = found.collect()
    assert Counter((r.text or "").encode().lower() for r in got) == Counter(by_text.keys()) and all(r.doc_id == (kept[(r.text or "").encode().lower()][1] or None) for r in got)
    grams = set()
    for t in bench:
        w = _words(t)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}

    def hit(text):
        w = _words(text)
        return any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert sorted(map(row, clean.collect())) == sorted((str(d), str(t)) for d, t in rows if not hit(t)) and clean.columns == docs.columns
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").encode().lower().split()) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            group = [group[i] if g == group[j] else g for g in group]
    near = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    left = {}
    for k, (d, t) in enumerate(rows):
        key = (group[k] if sets[k] else -1 - k, d is None, d or 0)
        left.setdefault(key[0], []).append((key[1:], d))
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(str(min(g)[1]) for g in left.values()) and near.columns == docs.columns
    judged = quality.score(quality.describe(docs), quality.fit(quality.describe(docs), quality.learnable(table(spark, SF, "labels")))).collect()
    accepted = corpus_pipeline.quality_stage(spark, docs, SF)
    assert accepted.count() == sum(r.predicted for r in judged) and accepted.columns == docs.columns
    library = encoder(vocabulary_path()).tokenizer
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    pieces, whole = corpus_pipeline.packing_stage(spark, docs, SF).collect(), Counter()
    for r in pieces:
        whole[str(r.doc_id)] += r.length
    lengths = Counter()
    for d, t in rows:
        lengths[str(d)] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert whole == lengths and sum(len(k) * n for k, n in want.items()) == sum(r.length for r in pieces)


def test_stages_on_an_empty_table(spark):
    docs = _awkward(spark, "item")[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run(spark, tmp_path):
    """All stages in a row on a small folder of tables, an awkward documents table among them."""
    item = next(r.text for r in table(spark, SF, "benchmark").collect() if r.text and len(r.text.split()) > 12)
    extra = _awkward(spark, item)[0].select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    table(spark, SF, "documents").unionByName(extra, True).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage", corpus_pipeline.new_folder(spark, "test"))
    library, want = encoder(vocabulary_path()).tokenizer, Counter()
    for r in docs.collect():
        want[tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
    by_doc, found = {}, Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        found[tuple(np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist())] += 1
    assert found == want
