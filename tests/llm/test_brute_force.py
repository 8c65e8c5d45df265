"""Operators that no SQL expresses, each against a plain version of its method."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from riskloom.llm import language, quality, sharding
from riskloom.llm.common import table


def test_quality_is_one_ridge_system(spark):
    """Scores against normal equations, bins and pooled blocks over all rows at once, without partitions."""
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: float(r.quality) for r in table(spark, SF, "labels").collect() if r.quality is not None}
    ids = sorted(texts)
    x = np.array([quality.statistics(texts[d]) for d in ids])
    learnt = np.array([d in labels and zlib.crc32(str(d).encode()) % 5 != 0 for d in ids])
    y = np.array([labels.get(d, 0.0) for d in ids])
    mean, deviation = x[learnt].mean(0), x[learnt].std(0)
    m = quality.Model(mean, np.where(deviation > 1e-9, deviation, 1.0), np.zeros(0), np.zeros(0), np.zeros(0))
    f = m.features(x)
    fit = learnt & np.array([zlib.crc32(f"c{d}".encode()) % 5 != 0 for d in ids])
    w = np.linalg.lstsq(np.vstack([f[fit], np.sqrt(quality.RIDGE) * np.eye(f.shape[1])]), np.r_[y[fit], np.zeros(f.shape[1])], rcond=None)[0]
    raw = f @ w
    kept = learnt & ~fit
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at[kept].tolist()))
    edge = [raw[kept & (at == b)].mean() for b in bins]
    weight, total = [int((kept & (at == b)).sum()) for b in bins], [y[kept & (at == b)].sum() for b in bins]
    # isotonic regression by its max-min formula
    level = [max(min(sum(total[i : j + 1]) / sum(weight[i : j + 1]) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    want = dict(zip(ids, np.clip(np.interp(raw, edge, level), 0, 1).tolist()))
    rows = quality.op3_quality(spark, SF).collect()
    assert len(rows) == len(ids) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert max(abs(r.score - want[r.doc_id]) for r in rows) < 1e-5


def _model(spark):
    training = table(spark, SF, "documents").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").select("text", "lang")
    return training, language.Model(*language.learn(training))


def test_language_counts(spark):
    """Counts of n-grams against every word of every text cut by itself."""
    training, _ = _model(spark)
    langs, counts, _ = language.learn(training)
    brute = {x: Counter() for x in langs}
    for text, lang in training.collect():
        for word in (text or "").split():
            if lang is not None and (w := language.letters(word)):
                own, _, _ = language.grams([w])
                brute[lang].update(own[own >= 0].tolist())
    for k, lang in enumerate(langs):
        assert {i: int(n) for i, n in enumerate(counts[:, k]) if n} == dict(brute[lang])


def test_language_paths(spark):
    """Labels against a plain Viterbi over each text, where no switch costs nothing and any switch costs SWITCH."""
    _, model = _model(spark)
    texts = [(r.text or "").split()[:400] for r in table(spark, SF, "documents").limit(40).collect()] + [["straße", "the", "über", "1", "où"], []]
    labels, rows = model.label(texts)
    for label, row, words in zip(labels, rows, texts, strict=True):
        best, path, k = np.zeros(len(model.langs)), [], len(model.langs)
        for r in row.tolist():
            came = [max(range(k), key=lambda a, b=b: (best[a] - (a != b) * language.SWITCH, a == b)) for b in range(k)]
            path.append(came)
            best = np.array([best[came[b]] - (came[b] != b) * language.SWITCH + float(model.scores[r][b]) for b in range(k)])
        cost = lambda states: sum(float(model.scores[r][s]) for r, s in zip(row.tolist(), states)) - language.SWITCH * sum(a != b for a, b in zip(states, states[1:]))
        assert len(label) == len(words)
        if len(words):
            assert abs(cost(label.tolist()) - best.max()) < 1e-2 + 1e-5 * abs(best.max())


def test_many_languages_do_not_stop_it(spark):
    training = spark.createDataFrame([(f"word{k} own{k}x only{k}y", f"l{k:03}") for k in range(300)], "text string, lang string")
    docs = spark.createDataFrame([(k, f"word{k} own{k}x only{k}y") for k in (0, 255, 256, 299)], "doc_id long, text string")
    found = language.identify(docs, training).collect()
    assert len(found) == 4 and all(r.lang_pred.startswith("l") and 0 <= r.score <= 1 for r in found)


def test_letters_of_words():
    for word in ("(Haus),", "it's", "«été»", "123", "", "né́", "-x-"):
        clean = language.letters(word)
        assert clean == clean.lower() and (not clean or (clean[0].isalpha() and (clean[-1].isalpha() or unicodedata.combining(clean[-1]))))
        assert [c for c in clean if c.isalpha()] == [c for c in word.lower() if c.isalpha()]


def test_sharding_map_and_places(spark, tmp_path):
    """The slot's map against a plain greedy one, edited move by move, and the places against a sort of each shard."""
    rows = sharding.shard(table(spark, SF, "documents"), 24, folder=str(tmp_path)).collect()
    size = Counter()
    for r in rows:
        size[r.virtual_slot] += r.size
    full, shard_of = [0] * 24, {}
    for slot in sorted(range(sharding.SLOTS), key=lambda s: (-size[s], s)):
        least = min(range(24), key=lambda s: (full[s], s))
        shard_of[slot] = least
        full[least] += size[slot]
    first = sharding.read_map(spark, str(tmp_path), 1)
    assert first.tolist() == [shard_of[s] for s in range(sharding.SLOTS)]
    second = sharding.read_map(spark, str(tmp_path))
    assert {r.virtual_slot: r.shard for r in rows} == {r.virtual_slot: int(second[r.virtual_slot]) for r in rows}
    spread = lambda m: np.ptp(np.bincount(m, [size[s] for s in range(sharding.SLOTS)], 24))
    assert spread(second) <= spread(first)
    for s in range(24):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: (r.virtual_slot, r.doc_id, r.size, r.text_crc32))
        assert [r.slot for r in own] == list(range(len(own)))


def test_sharding_slots_are_fixed(spark):
    """A record's virtual slot is the hash of its key, whatever the number of shards."""
    docs = table(spark, SF, "documents")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    want = {r.doc_id: r.v for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", crc), F.lit(sharding.SLOTS)).alias("v")).collect()}
    for shards in (5, 24):
        assert {r.doc_id: r.virtual_slot for r in sharding.shard(docs, shards).collect()} == want
