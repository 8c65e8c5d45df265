"""Language identification by spans: script ranges, per-word scores, Viterbi with a switching penalty.

Learning, from the texts and non-null langs of the rows given: counts of hashed character n-grams and whole words for
each language, summed in partitions and added up in a table of BUCKETS x languages, and for each script how many letters
each language has in it. A word's scores are the mean log-probabilities of its n-grams under each language, but a
language that (nearly) never has the word's script is no candidate. Viterbi over the words of a text, with SWITCH as the
cost of changing language, labels every word, and so spans of mixed text. The language with the most letters in its
spans is the text's; the score is its share of the letters times the mean margin, as a probability.

Null texts and texts without any letter: `und`, score 0. Texts of words in unknown scripts: all languages stay
candidates. Rows without lang are not learnt from; no training row: `und`, score 0. Null doc_ids: rows without one.
Repeated rows give a row each; of equal shares the first language in alphabetical order wins. Very long texts are read
whole, with a byte for each word and language (two with more than 256 languages; a model has BUCKETS numbers for each
language). Empty table: empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import fold, mixed, record, table, tidy

BUCKETS, SWITCH, SMOOTH, MOST_WORDS = 1 << 16, 4.0, 0.5, 200_000
CANDIDATE_SHARE = 0.001

#: First code points of ranges and their scripts (fixed values of the Unicode blocks).
RANGES = [
    (0x0000, "common"), (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "common"), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({s for _, s in RANGES})
_FIRST = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])


_LATIN, _COMMON = SCRIPTS.index("latin"), SCRIPTS.index("common")
_ENDS = "".join(map(chr, [*range(33, 65), *range(91, 97), *range(123, 127)]))


def script_of(word: str) -> int:
    """The script of most of its letters, the first of them on a tie."""
    if word.isascii():
        return _LATIN if any(map(str.isalpha, word)) else _COMMON
    codes = np.array([ord(c) for c in word if c.isalpha()])
    return int(np.bincount(_SCRIPT[np.searchsorted(_FIRST, codes, "right") - 1]).argmax()) if len(codes) else _COMMON


def letters(word: str) -> str:
    """Lower case, without what is no letter or combining mark at its ends."""
    word = word.strip(_ENDS)
    if word.isalpha():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not (word[end - 1].isalpha() or unicodedata.combining(word[end - 1])):
        end -= 1
    return word[start:end].lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the joined "^word$" of all words: buckets of the n-grams of 1 to 3 characters that begin at each character
    (negative: none does), with the word's own bucket for its first character; where each word starts; n-grams of each."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(sizes, sizes) - (np.arange(len(codes)) - np.repeat(starts, sizes))  # characters from here to the end
    place = np.repeat(sizes, sizes) - left
    after = np.concatenate([codes, np.zeros(2, np.uint64)])
    two = codes * np.uint64(0x110001) + after[1:-1]
    three = two * np.uint64(0x110001) + after[2:]
    whole = np.add.reduceat(mixed(codes + (place.astype(np.uint64) << np.uint64(32))), starts)
    bucket = lambda x, kind: (mixed(x + np.uint64(kind << 61)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    out = np.full((len(codes), 4), -1)
    inner = (place > 0) & (left > 1)
    out[inner, 0] = bucket(codes[inner], 1)
    out[left > 1, 1] = bucket(two[left > 1], 2)
    out[left > 2, 2] = bucket(three[left > 2], 3)
    out[starts, 3] = bucket(whole, 4)
    return out, starts, np.add.reduceat((out >= 0).sum(1), starts)


_COUNTS = "lang string, kind int, at int, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: n-gram buckets; 1: letters by script. Words are counted first, so each distinct one is cut once."""
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    words: dict[str, dict[str, int]] = {}
    n_words = 0

    def pour() -> None:
        for lang, counts in words.items():
            if lang not in tables:
                tables[lang] = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)
            buckets, scripts = tables[lang]
            clean: dict[str, int] = {}
            for word, n in counts.items():
                if w := letters(word):
                    clean[w] = clean.get(w, 0) + n
            kept = list(clean.items())
            for i in range(0, len(kept), 50_000):
                part = kept[i : i + 50_000]
                own, starts, _ = grams([w for w, _ in part])
                weight = np.repeat(np.array([n for _, n in part]), np.diff(np.append(starts, len(own))))
                for k in range(own.shape[1]):
                    used = own[:, k] >= 0
                    buckets += np.bincount(own[used, k], weight[used], BUCKETS).astype(np.int64)
                for w, n in part:
                    scripts[script_of(w)] += n * len(w)
        words.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = words.setdefault(lang, {})
            before = len(own)
            for word in (text or "").split():
                own[word] = own.get(word, 0) + 1
            n_words += len(own) - before
            if n_words > MOST_WORDS:
                pour()
                n_words = 0
    pour()
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])
    for lang, both in tables.items():
        for kind, counts in enumerate(both):
            at = np.flatnonzero(counts)
            yield record(schema, [lang] * len(at), np.full(len(at), kind, np.int32), at.astype(np.int32), counts[at])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: BUCKETS x languages; scripts: scripts x languages."""
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        self.logs = (np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS))).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        self.candidates = share >= CANDIDATE_SHARE
        self.candidates[~self.candidates.any(1)] = True
        self.known: dict[str, int] = {"": 0}
        self.scores = np.zeros((1 << 16, len(langs)), np.float32)
        self.sizes = np.zeros(1 << 16, np.int64)

    def _add(self, new: list[str]) -> None:
        at = len(self.known)
        while at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        clean = [letters(w) for w in new]
        self.scores[at : at + len(new)] = 0
        self.sizes[at : at + len(new)] = [len(c) if c.isalpha() else sum(map(str.isalpha, c)) for c in clean]
        kept = [i for i, c in enumerate(clean) if c]
        for j in range(0, len(kept), 20_000):
            part = np.array(kept[j : j + 20_000])
            own, starts, n = grams([clean[i] for i in part])
            s = sum(np.add.reduceat(np.where(own[:, k, None] >= 0, self.logs[own[:, k]], np.float32(0)), starts) for k in range(own.shape[1])) / n[:, None]
            s -= s.max(1, keepdims=True)
            self.scores[at + part] = np.where(self.candidates[[script_of(clean[i]) for i in part]], s, np.float32(-30))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*texts).difference(self.known)
        self._add(sorted(new))
        return [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]

    def label(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the language of each word, and the row of each word in scores and sizes."""
        if len(self.known) > MOST_WORDS:
            self.known = {"": 0}
        rows = self.rows(texts)
        order = np.argsort([-len(r) for r in rows], kind="stable")
        lengths = np.array([len(rows[i]) for i in order])
        n, longest, k = len(rows), int(lengths[0]) if len(rows) else 0, len(self.langs)
        best = np.zeros((n, k), np.float32)
        first = np.cumsum(lengths) - lengths
        flat = np.concatenate([rows[i] for i in order]) if n else np.zeros(0, np.int64)
        narrow = np.min_scalar_type(max(0, k - 1))
        back = np.zeros((len(flat), k), narrow)
        active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts that have a word at this place
        for t in range(longest):  # the texts walk side by side
            a = active[t]
            at = first[:a] + t
            b = best[:a]
            top = b.argmax(1)
            switch = b[np.arange(a), top] - SWITCH
            stay = b >= switch[:, None]
            back[at] = np.where(stay, np.arange(k, dtype=narrow), top[:, None].astype(narrow))
            best[:a] = np.where(stay, b, switch[:, None]) + self.scores[flat[at]]
        labels, state = np.zeros(len(flat), narrow), best.argmax(1)
        for t in range(longest - 1, -1, -1):
            a = active[t]
            at = first[:a] + t
            labels[at] = state[:a]
            state[:a] = back[at, state[:a]]
        out: list = [None] * n
        for j, i in enumerate(order):
            out[i] = labels[first[j] : first[j] + lengths[j]]
        return out, rows


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """rows: text, lang. Sums at most BUCKETS + scripts numbers for each language."""
    sums = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null").mapInArrow(tidy(_counted), _COUNTS).groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang, kind, at, n in sums.toLocalIterator():
        found.setdefault(lang, (np.zeros(BUCKETS), np.zeros(len(SCRIPTS))))[kind][at] = n
    langs = sorted(found)
    stack = lambda k, size: np.stack([found[x][k] for x in langs], 1) if langs else np.zeros((size, 0))
    return langs, stack(0, BUCKETS), stack(1, len(SCRIPTS))


_LABELLED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])
LABELLED = "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"


def _labelled(held, keep_spans: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Model(*held.value)

    def out(ids, texts) -> pa.RecordBatch:
        words = [t.split() for t in texts]
        langs, scores, spans = [], [], []
        if not model.langs:
            return record(_LABELLED, ids, ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids])
        for label, row in zip(*model.label(words), strict=True):
            sizes = model.sizes[row]
            total = int(sizes.sum())
            if not total:
                langs.append("und")
                scores.append(0.0)
                spans.append([])
                continue
            share = np.bincount(label, sizes, len(model.langs))
            top = int(share.argmax())
            s = model.scores[row]
            others = np.delete(s, top, 1)
            margin = float((s[:, top] - others.max(1)).mean()) if others.shape[1] else 30.0
            langs.append(model.langs[top])
            scores.append(float(share[top] / total / (1 + np.exp(-4 * np.clip(margin, -7, 7)))))
            if keep_spans:
                edge = np.flatnonzero(np.r_[True, label[1:] != label[:-1], True]).tolist()
                spans.append([{"start": a, "end": b, "lang": model.langs[label[a]]} for a, b in zip(edge, edge[1:])])
            else:
                spans.append([])
        return record(_LABELLED, ids, langs, scores, spans)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > 6 << 20 or i == len(texts) - 1:
                yield out(ids[at : i + 1], texts[at : i + 1])
                at, size = i + 1, 0


def identify(docs: DataFrame, training: DataFrame, keep_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans (word places and language) of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(learn(training))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(lambda batches: _labelled(held, keep_spans, batches)), LABELLED)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.filter(fold(4) != 2), keep_spans=False)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
