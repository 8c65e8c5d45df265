"""Each operator on awkward rows, against brute force, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from riskloom.llm import bpe, decontaminate, exact_dedup, jaccard_join, language, language_model, packing, quality, sharding, token_counts, token_files
from riskloom.llm.bpe import encoder, vocabulary_path
from riskloom.llm.common import fold, table
from riskloom.llm.components import components

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
NEAR = " ".join(f"tok{i}" for i in range(60))
ROWS = [
    (1, "Same text here"), (2, "same TEXT here"), (3, None), (4, ""), (5, LONG), (6, LONG + " tail"), (7, NEAR), (8, NEAR + " end"), (8, NEAR + " end"),
    (None, "no id at all"), (9, "é È 日本語 テキスト  double  space \n line"), (10, "a b"), (11, "a b"), (12, " \n\t "), (13, "<|endoftext|> in a text"), (14, "ÀB"), (15, "àb"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(d, t, "k", 1, "x") for d, t in ROWS], "doc_id long, text string, key string, n int, row string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def norm(t):
    return (t or "").encode().lower()


def test_exact_dedup(docs, empty):
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()]
    groups = {}
    for d, t in ROWS:
        groups.setdefault(norm(t), []).append(d)
    expected = []
    for t, ids in groups.items():
        keep, left = max(ids, key=lambda x: -1 if x is None else x), 1
        for d in sorted(ids, key=str):
            expected.append((d, keep, len(ids), d == keep and left > 0, hashlib.sha256(t).hexdigest()))
            left -= d == keep
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles_and_splits():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 1 << 12, 3000), rng.integers(0, 1 << 6, 3000)])  # the lowest prefixes are crowded
    counted = lambda depth: np.bincount(keys >> (12 - depth), minlength=1 << depth)
    d = exact_dedup.Directory.built(counted, 200, 2, 12)
    assert d.depth > 5 and d.counts.sum() == len(keys) and d.counts.max() <= 200
    assert (np.diff(d.buckets) >= 0).all() and (np.diff(d.owners(7)) >= 0).all() and d.owners(7).max() == 6


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    e = encoder(vocabulary_path()).tokenizer
    by_seq, by_doc = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == [0, *itertools.accumulate(r.length for r in seq)][:-1] and sum(r.length for r in seq) <= packing.WINDOW
    for d, t in ROWS:
        if d == 8:
            continue
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist()
        assert ids == [*e.encode(t or "", add_special_tokens=False).ids, 1] and {p.doc_tokens for p in pieces} == {len(ids)}
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_choice():
    """Each piece goes where a recount of all squares says, the fullest of equal levels first."""
    rng, w = np.random.default_rng(3), 40
    p, levels = packing.Packer(w), Counter()
    for size in rng.integers(1, w, 600).tolist():
        options = [((levels[size] + 1) ** 2 - levels[size] ** 2, 1, 0)]
        for h in (h for h, n in levels.items() if n and h + size <= w):
            after = Counter(levels)
            after[h] -= 1
            after[h + size] += h + size < w
            options.append((sum(n * n for n in after.values()) - sum(n * n for n in levels.values()), -h, h))
        to = min(options)[2]
        levels[to] -= to > 0
        levels[to + size] += to + size < w
        p.add(size, bytes(4 * size))
        assert {h: n for h, n in enumerate(p.levels.tolist()) if n} == {h: n for h, n in levels.items() if n}
    q = packing.Packer(16, most_open=9)
    for n in rng.integers(1, 40, 500).tolist():
        q.add(n, bytes(4 * n))
    q.finish()
    fill = Counter()
    for r in q.rows:
        fill[r[5]] += r[2]
    assert sum(1 for v in fill.values() if v < 16) <= 1 and max(fill.values()) == 16


def test_the_choice_closes_most_windows():
    p = packing.Packer()
    for n in (np.exp(np.random.default_rng(1).normal(5.3, 1.1, 8000)).astype(int) + 1).tolist():
        p.add(n, bytes(4 * n))
    p.finish()
    assert p.closed[0] > 9 * p.closed[1]


def test_encoder_equals_the_library():
    e = encoder(vocabulary_path())
    texts = [t or "" for _, t in ROWS] + ["it's 's x\n's <b> 3.14,", "a  b", "a\nb", "a\n\nb", " a", "a ", "a\tb", "\x1c a b", "a\r\nb c", "é" * 50, "Straße, Größe! ñandú? ''", "a\u00a0b \u2003c", "x" * 5000, "日本語 テキスト,", "1,000.5 2nd"]
    ids, n = e.ids(pa.array(texts))
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert [len(x) for x in e.ids(pa.array([], pa.string()))] == [0, 0]


def test_encoder_asks_the_library_once_for_what_comes_again(monkeypatch):
    """Units that are more than letters are kept too, and a full store keeps what slices asked for again."""
    e, asked = bpe.Encoder(vocabulary_path()), []
    others, stems = e._others, e._stems
    monkeypatch.setattr(e, "_others", lambda x: asked.extend(x) or others(x))
    monkeypatch.setattr(e, "_stems", lambda x: asked.extend(x) or stems(x))
    monkeypatch.setattr(bpe, "MOST_PIECES", 40)
    text = "often 3.14, x_y\nheads, often"
    for k in range(30):
        texts = [text, " ".join("rare" + chr(97 + k) + chr(97 + j) for j in range(9))]
        ids, n = e.ids(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in e.tokenizer.encode(t, add_special_tokens=False).ids] and n.sum() == len(ids)
    assert asked.count("often") == asked.count("\nheads") == asked.count("3.14,") == 1
    assert len(set(asked)) > 270 and len(e.ends) < 80


def test_token_ids_are_counted_as_they_are_encoded(spark, tmp_path):
    """Counts lie beside the ids, a row a task, so that the ids are read once, for the blocks; repeated in each task."""
    texts = ["to be or not to be", None, "", "3.14, x\ny"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    folder = token_files.write_tokens(docs, folder=str(tmp_path / "tokens"))
    e, want = encoder(vocabulary_path()).tokenizer, Counter()
    for t in texts:
        want.update([*e.encode(t or "", add_special_tokens=False).ids, 2])
    rows, found = spark.read.parquet(f"{folder}/ids").filter("place IS NULL").collect(), Counter()
    for r in rows:
        n = np.frombuffer(r.counts, "<i8")
        found.update({i: int(n[i]) for i in np.flatnonzero(n).tolist()})
    assert found == want and 1 < len(rows) <= 4
    assert {r.id for r in spark.read.parquet(f"{folder}/codebook").collect()} == set(want)


def test_token_files_round_trip(spark, docs, empty):
    rows = sorted(token_files.read_tokens(spark, token_files.write_tokens(docs)).collect(), key=lambda r: r.start)
    e, at = encoder(vocabulary_path()).tokenizer, 0
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ROWS), key=lambda d: -1 if d is None else d)
    texts = dict(ROWS)
    for r in rows:
        ids = np.array([*e.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty)).count() == 0


def test_token_files_of_parts_read_by_several_tasks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 30))) for i in range(2000)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    small = {"parquet.block.size": "30000", "parquet.page.size": "4000"}
    for k, v in small.items():
        hadoop.set(k, v)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        folder = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
        assert spark.read.parquet(f"{folder}/ids").rdd.getNumPartitions() > 8
        found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block").collect()
    finally:
        for k in small:
            hadoop.unset(k)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(blocks) == len(set(blocks)) > len({b.part for b in blocks})
    assert [r.doc_id for r in found] == [i for i, _ in rows]
    assert [r.start for r in found] == [0, *itertools.accumulate(r.n_tokens for r in found)][:-1]


def test_blocks_of_pieces_in_any_order():
    class Held:
        value = np.array([1, 1])

    ids = b"\x02" + np.array([0, 1], "<u2").tobytes()
    places = [(1 << 40) + 2, (1 << 40) + 3, 1 << 40, (1 << 40) + 1, 4, 5]
    batch = token_files.record(token_files._IDS, places, places, [ids] * len(places))
    found = [(r["part"], r["block"], r["doc_ids"]) for b in token_files._blocks(Held, iter([batch])) for r in b.to_pylist()]
    assert found == [(1, 2, places[:2]), (1, 0, places[2:4]), (0, 4, places[4:])]


def test_huffman_lengths_are_limited_and_decodable():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    counts = np.array(fib)
    lengths = token_files.limited_lengths(counts, 12)
    assert lengths.max() == 12 and abs((2.0**-lengths).sum() - 1) < 1e-12
    ids = np.random.default_rng(0).integers(0, 40, 5000)
    payload, starts = token_files.pack_bits(ids, token_files.canonical(lengths), lengths)
    assert (token_files.Decoder(lengths, 12).decode(payload, starts[: len(ids) : 128], len(ids)) == ids).all()
    assert token_files.limited_lengths(np.array([0, 5])).tolist() == [0, 1]


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", norm(t).decode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(str((d, len(s), least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_join(spark, docs, empty):
    found = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.jaccard_components(docs).collect())
    assert found == _components(ROWS)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_on_chains_and_families(spark):
    rng, rows, n = np.random.default_rng(5), [], 0
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(int(rng.integers(8, 90)))]
        for _ in range(14):  # each member edits the one before: chains around the threshold
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(1 << 30)}"
    rows += [(n + i, " ".join(["common passage of many documents"] * 2 + [f"own{i}x{j}" for j in range(12)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.jaccard_components(df).collect())
    assert found == _components(rows)


@pytest.mark.parametrize(("edits", "portion"), [(3, 500), (3, 40)])
def test_jaccard_join_on_families_about_the_threshold(spark, monkeypatch, edits, portion):
    """Hundreds of texts of which few pairs are linked, in one portion and in many; rows sent on stay in proportion."""
    monkeypatch.setattr(jaccard_join, "PORTION", portion)
    rng = np.random.default_rng(edits)
    base, rows = [f"w{x}" for x in rng.integers(0, 5000, 200)], []
    for k in range(240):
        words = list(base)
        for at in rng.integers(0, 200, edits).tolist():
            words[at] = f"x{rng.integers(1 << 30)}"
        rows.append((k, " ".join(words)))
    sent = []
    links = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda groups, *rest: sent.append(groups.count()) or links(groups, *rest))
    found = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == _components(rows) and sent[0] < 20 * len(rows)


def test_list_readers_find_the_same_pairs(monkeypatch):
    """Short lists side by side, and a long list row by row: the same connected parts as all pairs."""
    rng = np.random.default_rng(7)
    bases, sets = rng.integers(1, 1 << 62, (3, 150)).astype(np.uint64), []
    for k in range(60):
        s = bases[k % 3][rng.random(150) < rng.choice([0.7, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([s, rng.integers(1, 1 << 62, int(rng.integers(0, 12))).astype(np.uint64)])))
    sets.sort(key=len)
    rows = jaccard_join.Rows(np.arange(60), np.array([len(s) for s in sets]), rng.integers(0, 12, 60), pa.array([jaccard_join.bitmap(s) for s in sets], pa.binary()))
    i, j = np.triu_indices(60, 1)
    ok = rows.passing(i, j)
    want = jaccard_join._parts(60, i[ok], j[ok])
    for size in (2, 60):
        monkeypatch.setattr(jaccard_join, "SHORT_LIST", size)
        member, pivot, _ = jaccard_join._grouped(rows, np.zeros(60, np.uint64))
        assert (jaccard_join._parts(60, member, pivot) == want).all() and len(set(want.tolist())) > 1


def test_derived_answers():
    """Overlaps that are derived from the pivot's equal those counted anew, for like and unlike sets."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    sets = [base] + [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(1, 1 << 62, 30).astype(np.uint64)])) for p in rng.uniform(0, 1, 40)]
    answers = jaccard_join.Answers(base, sets)
    for s in sets:
        both = np.array([len(np.intersect1d(s, t)) for t in sets])
        assert answers.linked(s).tolist() == np.flatnonzero(both >= jaccard_join.needed(np.array([len(t) for t in sets]), len(s))).tolist()


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4), jaccard_join.new_folder(spark, "t")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}


def test_components_never_stop_short(spark, monkeypatch):
    monkeypatch.setattr("riskloom.llm.components.MOST_ROUNDS", 1, raising=False)
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)], "u long, v long").repartition(4)
    with pytest.raises(RuntimeError, match="not converged"):
        components(edges, jaccard_join.new_folder(spark, "t"))


def test_decontaminate(spark, docs, empty):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", norm(t).decode())
    items = [(1, "tok5 tok6 tok7 tok8 tok9 tok10 tok11 tok12 tok13 tok14 tok15"), (2, "Text, here!"), (3, None), (4, "..."), (11, "text here"), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(t):
        w, hit, found = word(t), set(), set()
        for item, text in items:
            v = word(text)
            for g in [v[i : i + 10] for i in range(max(1, len(v) - 9))] if v else []:
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit.update(range(i, i + len(g)))
                        found |= {item} - {None}
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)

    expected = sorted(str((d, *brute(t))) for d, t in ROWS)
    for most in (1 << 20, 20):  # one block, and many
        found = decontaminate.report(docs, bench, most).collect()
        assert sorted(str(tuple(r)) for r in found) == expected
    assert decontaminate.report(empty, bench).count() == 0
    assert not decontaminate.report(docs, bench.limit(0)).filter("contaminated").count()
    cleaned = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cleaned[1] == "Same " and cleaned[3] is None and cleaned[9] == ROWS[10][1] and "tok15" not in cleaned[7] and "tok16" in cleaned[7]


def test_token_counts(docs, empty):
    """Against the whole dynamic program of each word by itself: scores by rank first, then those learnt from its counts."""
    pieces = token_counts.pieces_of(vocabulary_path("piece_bpe_32k.model"))

    def best(word, scores):
        table = [(0.0, 0, ())]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(table[end - 1][0] + n * token_counts.UNKNOWN, table[end - 1][1] + n, table[end - 1][2])]
            options += [(table[s][0] + scores[word[s:end]], table[s][1] + 1, (*table[s][2], word[s:end])) for s in range(end - 1, -1, -1) if word[s:end] in scores]
            top = max(o[0] for o in options)
            table.append([o for o in options if o[0] == top][-1])
        return table[-1]

    first, used, known = dict(zip(pieces, token_counts.rank_scores(len(pieces)).tolist())), Counter(), {}
    for _, text in ROWS:
        for w in (text or "").split():
            known[w] = known.get(w) or best("▁" + w, first)
            used.update(known[w][2])
    counts = np.array([used[p] for p in pieces])
    scores, known = dict(zip(pieces, np.log((counts + 1) / (counts.sum() + len(pieces))).tolist())), {}
    for r in token_counts.count_tokens(docs).collect():
        text = dict(ROWS)[r.doc_id]
        each = [known.setdefault(w, None) or known.update({w: best("▁" + w, scores)}) or known[w] for w in (text or "").split()]
        assert (r.n_pretokens, r.n_tokens) == (len(each), sum(x[1] for x in each)) and math.isclose(r.score, sum(x[0] for x in each), abs_tol=1e-6)
    assert token_counts.count_tokens(empty).count() == 0


def test_trie_shares_prefixes():
    count = token_counts.counter(vocabulary_path("piece_bpe_32k.model"))
    words = ["▁pre" + x for x in ("fix", "fixes", "fixed", "sent", "sents", "")]
    trie = token_counts.Trie(words, count.automaton)
    assert len(trie.parent) - 1 == len({w[:k] for w in words for k in range(1, len(w) + 1)})  # a node a distinct prefix
    scores = token_counts.rank_scores(len(count.pieces))
    trie.forward(count.automaton, scores)
    by_piece = {p: float(scores[k]) for p, k in count.index.items()}
    alone = [token_counts.segment(w, by_piece, count.longest) for w in words]
    assert trie.tokens[trie.terminal].tolist() == [n for n, _, _ in alone] and np.allclose(trie.best[trie.terminal], [b for _, b, _ in alone])
    weights = np.arange(1.0, len(words) + 1)
    expected = Counter()
    for (_, _, parts), w in zip(alone, weights.tolist()):
        for p in parts:
            expected[count.index[p]] += w
    used = trie.used(weights, len(count.pieces))
    assert {k: used[k] for k in np.flatnonzero(used).tolist()} == dict(expected)


def test_quality(spark, docs, empty):
    rows = {r.doc_id: r for r in quality.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = [(rows[r.doc_id], r.quality) for r in table(spark, "/root/testdata/sf0.01", "labels").collect() if r.doc_id in rows]
    held = [(r.predicted, y) for r, y in truth if r.held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (7, 0), (1, 1), (10, 1)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == len(ROWS)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {quality.PRIOR}
    assert quality.classify(empty, labels).count() == 0


def test_language(spark, docs, empty):
    rows = language.op7_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    training = spark.createDataFrame([("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de"), ("кот и собака и дом", "ru"), (None, "en"), ("x", None)], "text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs.withColumn("lang", docs.key), training).collect()}
    assert found[3].lang_pred == found[4].lang_pred == found[12].lang_pred == "und" and found[3].score == 0
    mixed = spark.createDataFrame([(1, "the cat and the house the dog der hund und die katze und das haus"), (2, "собака дом 123")], "doc_id long, text string")
    spans = {r.doc_id: r for r in language.identify(mixed, training).collect()}
    assert [s.lang for s in spans[1].spans] == ["en", "de"] and spans[1].spans[0].end in (6, 7) and spans[2].lang_pred == "ru"
    assert language.identify(empty, training).count() == 0
    assert {r.lang_pred for r in language.identify(docs, training.limit(0)).collect()} == {"und"}


def test_language_model(spark, docs, empty):
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", norm(t).decode()), None]) for d, t in ROWS]
    trained = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in ROWS]
    counts = Counter(w for (_, ws), t in zip(tokens, trained) for w in ws if t)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(str((d, not t, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4))) for (d, ws), t in zip(tokens, trained))
    rows = language_model.score(docs, fold(7) != 2).collect()
    assert sorted(str((r.doc_id, not r.trained, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in rows) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert language_model.score(empty).count() == 0
    assert {r.n_known for r in language_model.score(docs, F.lit(False)).collect()} == {0}


def test_language_model_score(spark, monkeypatch):
    """The score against a sum token by token from the model's weights, and above the base on texts held out."""
    models = []
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: models.append(train(*a)) or models[-1])
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in language_model.op9_lm_scoring(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    m = models[0]
    split = {d: [*re.findall(r"[^\x20\x09-\x0D]+", norm(t).decode()), None] for d, t in texts.items()}
    counts = Counter(w for d, ws in split.items() if not rows[d].held_out for w in ws)
    own = {int(w): int(leaf) for w, leaf in zip(m.own, m.leaf_of)}
    by_hash = {int(language_model.tokens([(w or "").encode()]).hashes[0]): n for w, n in counts.items()}
    assert [by_hash[w] for w in sorted(own, key=own.get)] == sorted(counts.values(), reverse=True)[: language_model.OWN]
    for d in sorted(texts)[:12]:
        t, total, of_leaf = language_model.tokens([texts[d].encode()]), 0.0, m.leaves(language_model.tokens([texts[d].encode()]))
        for i, w in enumerate(split[d]):
            x = language_model.features(t, i, i + 1)[:, 0]
            z = m.weights[:, x].sum(1)
            a, b = divmod(own.get(int(t.hashes[i]), language_model.OWN + int(t.kinds[i])), language_model.CLASSES)
            assert a * language_model.CLASSES + b == of_leaf[i]
            za, zb = z[: language_model.CLASSES] + m.bias[0], z[language_model.CLASSES :] + m.bias[1][a]
            total += math.log10(np.exp(za[a]) / np.exp(za).sum()) + math.log10(np.exp(zb[b]) / np.exp(zb).sum())
            total += 0 if int(t.hashes[i]) in own else math.log10(counts[w] + 1) - m.spread[of_leaf[i]]
        assert math.isclose(rows[d].score, total, rel_tol=1e-4)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.04


def test_features_do_not_cross_texts():
    both, alone = language_model.tokens([b"a b c d e", b"c d e"]), language_model.tokens([b"c d e"])
    n, k = len(both.hashes), len(alone.hashes)
    assert (language_model.features(both, n - k, n) == language_model.features(alone, 0, k)).all()
    whole = language_model.features(both, 0, n)
    assert (np.concatenate([language_model.features(both, a, min(a + 2, n)) for a in range(0, n, 2)], 1) == whole).all()


def test_class_probabilities_sum_to_one(spark):
    totals = spark.createDataFrame([(i + 1, i % (language_model.LEAVES - language_model.OWN), max(0, 300 - i)) for i in range(400)], "word long, kind int, n long")
    m = language_model._untrained(totals)
    m.weights = np.random.default_rng(2).normal(size=m.weights.shape).astype(np.float32)
    t = language_model.tokens([b"some words in a text"])
    p = m.probabilities(language_model.features(t, 0, 6), m.leaves(t))
    assert np.allclose(p[: language_model.CLASSES].sum(0), 1, atol=1e-5) and np.allclose(p[language_model.CLASSES :].sum(0), 1, atol=1e-5)
    assert m.n_all == sum(range(1, 301)) and m.n_distinct == 300 and len(m.own) == language_model.OWN
    places = Counter()  # of the words of a leaf, and one for all that training does not have
    for i in range(300):
        if i >= language_model.OWN:
            places[language_model.OWN + i % (language_model.LEAVES - language_model.OWN)] += 301 - i
    assert all(math.isclose(10 ** m.spread[leaf], n + 1) for leaf, n in places.items())


def test_sharding(spark, docs, empty):
    rows = sharding.shard(docs, 3, 64).collect()
    assert len(rows) == len(ROWS)
    texts = dict(ROWS)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    totals = Counter()
    for r in sharding.op10_sharding(spark, "/root/testdata/sf0.01").collect():
        totals[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert set(totals) == set(range(24)) and max(totals.values()) < 1.02 * min(totals.values())
    assert sharding.shard(empty, 3, 64).count() == 0


def test_sharding_spreads_repeated_rows(spark):
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    other = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = sharding.shard(hot.unionByName(other).repartition(3), 24).collect()
    totals = Counter()
    for r in rows:
        totals[r.shard] += r.size
    assert len(rows) == 9000 and len(totals) == 24 and max(totals.values()) < 1.02 * min(totals.values())
    copies = Counter(r.virtual_slot for r in rows if r.doc_id is None)
    assert sum(copies.values()) == 3000 and max(copies.values()) <= 5 * sharding.COPIES
    for s in totals:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_map_versions(spark, tmp_path):
    size = np.random.default_rng(4).integers(1, 100, 256)
    first = sharding.assign(size, 4)
    grown = sharding.rebalance(size, first, 5)
    moved = grown != first
    assert set(grown[moved]) <= {4, 0, 1, 2, 3} and np.bincount(grown, size).max() < 1.05 * np.bincount(grown, size).min()
    assert (grown[moved] == 4).mean() > 0.9
    sharding.store_map(spark, str(tmp_path), first, 1)
    sharding.store_map(spark, str(tmp_path), grown, 2)
    assert (sharding.read_map(spark, str(tmp_path)) == grown).all() and (sharding.read_map(spark, str(tmp_path), 1) == first).all()


def test_repeated_rows_make_several_parts_of_the_files(spark, tmp_path):
    """Rows that repeat doc_id and text are dealt over tasks; each still has a place of its own."""
    docs = spark.range(6000, numPartitions=4).selectExpr("7L AS doc_id", "repeat('same words again ', 5) AS text").unionByName(spark.createDataFrame([(6, "before"), (8, "after")], "doc_id long, text string"))
    folder = token_files.write_tokens(docs, folder=str(tmp_path / "tokens"))
    assert spark.read.parquet(f"{folder}/blocks").select("part").distinct().count() > 2
    rows = token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert len(rows) == 6002 and [r.doc_id for r in rows] == [6] + [7] * 6000 + [8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
