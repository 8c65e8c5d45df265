"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A-Z lower-cased words between white space, then one end token. P(token | history) = P(a | history) P(b | a, history)
P(token | leaf a, b): both factors of the CLASSES x CLASSES leaves are maximum-entropy models over the same features of
the history, which are hashed from the words themselves into BUCKETS rows of weights: the word before, the one before
that (a skip), the spellings of both (first letter, last three, length), the bigram of both, and the skip pair of the
word before and the third one back. The OWN most frequent training words have a leaf each; every other word's leaf comes
from its spelling, and within it P = (c + 1) / (N + V + 1), with one place for words that training does not have, so that
the probabilities of the places of a leaf sum to 1.

Training: ROUNDS times, each on its part of the chunks of training texts, tasks start from the weights so far, take
AdaGrad steps on blocks of BATCH tokens, and send their changes of the rows they touched; the mean change of each row
over the tasks that touched it is added. Word counts grow with the corpus and are never gathered in one place: documents
are dealt to chunks, each chunk sends its distinct words' counts to the words' owners and gets the totals of its words
back. A chunk's documents are then scored in sparse numpy batches.

Null and empty texts: the end token alone. Rows with a null doc_id count as documents. Repeated rows count as often as
they occur. Empty training: N = V = 0. Very long texts are chunked with others by their size. Ties among the most
frequent words go by their hashes. Empty table: empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import doc_texts, fold, mixed, new_folder, record, slices, table, tidy, written
from riskloom.llm.words import Words

CLASSES, BUCKETS, FEATURES, ROUNDS, RATE, BATCH = 16, 1 << 15, 6, 2, 0.15, 32_768
LEAVES = CLASSES * CLASSES
OWN = LEAVES * 3 // 4
CHUNK_BYTES = 24 << 20
END = np.uint64(0)  # the end token's hash, and that of the places before a text; no word has it (its chance is 2**-64)


@dataclass
class Tokens:
    """All tokens of some texts, end tokens among them; starts: the first token of each text (one more at the end)."""

    hashes: np.ndarray
    spellings: np.ndarray
    kinds: np.ndarray  # from the spelling: the leaf of a word without one of its own, less OWN
    starts: np.ndarray
    places: np.ndarray  # within the text


def tokens(texts: list[bytes]) -> Tokens:
    w = Words(texts)
    n = len(w.starts)
    letter = lambda at: w.data[np.maximum(w.starts, at)].astype(np.int64)
    last, before, third, first = letter(w.ends - 1), letter(w.ends - 2), letter(w.ends - 3), letter(w.starts)
    size = np.minimum(w.ends - w.starts, 6)
    kind = ((last * 31 + before) * 31 + size * 7 + (first >= 128)) * np.int64(2654435761) >> 7
    starts = w.first + np.arange(len(texts) + 1)
    at = np.arange(n) + np.searchsorted(w.first[1:], np.arange(n), "right")  # each text before adds its end token
    total = n + len(texts)
    hashes, spellings, kinds = np.full(total, END), np.zeros(total, np.uint64), np.zeros(total, np.int64)
    hashes[at], kinds[at] = w.hashes, kind % (LEAVES - OWN)
    spellings[at] = mixed(((((first * 257 + third) * 257 + before) * 257 + last) * 7 + size).astype(np.uint64))
    return Tokens(hashes, spellings, kinds, starts, np.arange(total) - np.repeat(starts[:-1], np.diff(starts)))


def features(t: Tokens, begin: int, end: int) -> np.ndarray:
    """FEATURES x (end - begin) rows of weights for the histories of these tokens."""

    def back(x: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(end - begin, np.uint64)
        first = max(begin, d)
        out[first - begin :] = x[first - d : max(end - d, first - d)]
        return np.where(t.places[begin:end] >= d, out, END)

    one, two, three = (back(t.hashes, d) for d in (1, 2, 3))
    with np.errstate(over="ignore"):
        keys = [one, two, back(t.spellings, 1), back(t.spellings, 2), mixed(two) + one, mixed(three * np.uint64(3)) + one]
        return np.stack([(mixed(k + np.uint64(7919 * (i + 1))) % np.uint64(BUCKETS)).astype(np.int64) for i, k in enumerate(keys)])


@dataclass
class Model:
    """weights: 2 CLASSES x BUCKETS, first those of a, then those of b; bias: of a, and of b by a; own: sorted hashes of the
    words that have a leaf, leaf_of: their leaves; spread: log10 of N + V + 1 of each leaf (0 of a word's own)."""

    weights: np.ndarray
    bias: tuple[np.ndarray, np.ndarray]
    own: np.ndarray
    leaf_of: np.ndarray
    spread: np.ndarray
    n_all: int
    n_distinct: int

    def leaves(self, t: Tokens) -> np.ndarray:
        if not len(self.own):
            return OWN + t.kinds
        at = np.minimum(np.searchsorted(self.own, t.hashes), len(self.own) - 1)
        return np.where(self.own[at] == t.hashes, self.leaf_of[at], OWN + t.kinds)

    def probabilities(self, rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of a in the first CLASSES rows, and of b, given the a of each token's leaf, in the others."""
        z = np.empty((2 * CLASSES, rows.shape[1]), np.float32)
        for k, w in enumerate(self.weights):
            z[k] = w[rows[0]]
            for f in range(1, FEATURES):
                z[k] += w[rows[f]]
        z[:CLASSES] += self.bias[0][:, None]
        z[CLASSES:] += self.bias[1].T[:, leaf // CLASSES]
        for part in (z[:CLASSES], z[CLASSES:]):
            part -= part.max(0)
            np.exp(part, out=part)
            part /= part.sum(0)
        return z

    def log10(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of each token's leaf given its history; the leaf."""
        leaf, out = self.leaves(t), np.empty(len(t.hashes))
        for a in range(0, len(leaf), BATCH):
            b = min(a + BATCH, len(leaf))
            k, p = leaf[a:b], self.probabilities(features(t, a, b), leaf[a:b])
            each = np.arange(b - a)
            out[a:b] = np.log10(np.maximum(p[k // CLASSES, each], 1e-30)) + np.log10(np.maximum(p[CLASSES + k % CLASSES, each], 1e-30))
        return out, leaf


def _steps(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AdaGrad steps on the texts of a task: the changes of the rows of weights that it touched."""
    start = model.value
    m = Model(**{**vars(start), "weights": start.weights.copy()})
    squares = np.full(m.weights.shape, 1e-6, np.float32)
    for _, texts in slices(batches):
        t = tokens(texts)
        leaf = m.leaves(t)
        for a in range(0, len(leaf), BATCH):
            b = min(a + BATCH, len(leaf))
            rows, k, each = features(t, a, b), leaf[a:b], np.arange(b - a)
            error = -m.probabilities(rows, k)
            error[k // CLASSES, each] += 1
            error[CLASSES + k % CLASSES, each] += 1
            for c in range(2 * CLASSES):
                e = error[c].astype(np.float64)
                g = np.bincount(rows[0], e, BUCKETS)
                for f in range(1, FEATURES):
                    g += np.bincount(rows[f], e, BUCKETS)
                g = g.astype(np.float32)
                squares[c] += g * g
                m.weights[c] += RATE * g / np.sqrt(squares[c])
    change = (m.weights - start.weights).T
    touched = np.flatnonzero((change != 0).any(1))
    for at in range(0, len(touched), 4096):
        own = touched[at : at + 4096]
        flat = pa.array(change[own].astype(np.float32).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * 2 * CLASSES), flat)], names=["row", "g"])


def train(model: Model, chunked: DataFrame) -> Model:
    """chunked: chunk, trained, text. The model with learnt weights."""
    spark = chunked.sparkSession
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast(model)
        part = chunked.filter(F.col("trained") & (F.col("chunk") % ROUNDS == k)).select("text")
        moved = part.mapInArrow(tidy(lambda batches, held=held: _steps(held, batches)), "row long, g array<float>")
        mean = moved.groupBy("row").agg(*[F.avg(F.col("g")[c]).alias(f"g{c}") for c in range(2 * CLASSES)])
        found = mean.toPandas()  # BUCKETS rows at most
        weights = model.weights.copy()
        weights[:, found["row"].to_numpy(np.int64)] += found.drop(columns="row").to_numpy(np.float32).T
        model = Model(**{**vars(model), "weights": weights})
        held.unpersist()
    return model


_WORD = pa.schema([("chunk", pa.int32()), ("word", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk with their training counts."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    chunk, size = None, 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, kinds, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, first, at = np.unique(words, return_index=True, return_inverse=True)
        return words, kinds[first], np.bincount(at, n, len(words)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        words, kinds, n = merged()
        for i in range(0, len(words), 100_000):
            k = len(words[i : i + 100_000])
            yield record(_WORD, np.full(k, chunk, np.int32), words[i : i + k].view(np.int64), kinds[i : i + k].astype(np.int32), n[i : i + k])

    for batch, texts in slices(batches):
        chunks, trained = batch.column("chunk").to_numpy(), np.array(batch.column("trained").to_pylist(), bool)
        t = tokens(texts)
        own = np.repeat(trained, np.diff(t.starts))
        edges = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if chunk is not None and chunks[a] != chunk:
                yield from rows()
                held, size = [], 0
            chunk = int(chunks[a])
            part = slice(t.starts[a], t.starts[b])
            w, first, at = np.unique(t.hashes[part], return_index=True, return_inverse=True)
            held.append((w, t.kinds[part][first], np.bincount(at, own[part], len(w)).astype(np.int64)))
            size += len(w)
            if size > 1_500_000 and len(held) > 1:
                held = [merged()]
                size = 0
    if held:
        yield from rows()


_SCORED = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(held, left: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk first come the rows with its words' totals, then its documents."""
    model = held.value
    chunk, words, totals = None, [], []
    table_of: tuple[np.ndarray, np.ndarray] | None = None
    log_base = np.log10(model.n_all + model.n_distinct + 1)
    for batch in left:
        chunks, words_at = batch.column("chunk").to_numpy(), batch.column("word")
        is_word = np.array(batch.column("is_word").to_pylist(), bool)
        edges = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (is_word[1:] != is_word[:-1]), True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if chunks[a] != chunk:
                chunk, words, totals, table_of = int(chunks[a]), [], [], None
            part = batch.slice(a, b - a)
            if is_word[a]:
                words.append(words_at.slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                totals.append(part.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
                continue
            if table_of is None:
                w, t = (np.concatenate(words), np.concatenate(totals)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                order = np.argsort(w)
                table_of, words, totals = (w[order], t[order]), [], []
            for piece, texts in slices(iter([part])):
                t = tokens(texts)
                at = np.minimum(np.searchsorted(table_of[0], t.hashes), max(0, len(table_of[0]) - 1))
                c = np.where(table_of[0][at] == t.hashes, table_of[1][at], 0) if len(table_of[0]) else np.zeros(len(t.hashes), np.int64)
                plus, first = np.log10(c + 1.0), t.starts[:-1]
                by_leaf, leaf = model.log10(t)
                own = np.isin(t.hashes, model.own)
                base = np.add.reduceat(plus - log_base, first)
                score = np.add.reduceat(by_leaf + np.where(own, 0, plus - model.spread[leaf]), first)
                yield record(_SCORED, piece.column("doc_id"), piece.column("trained"), np.diff(t.starts), np.add.reduceat((c > 0).astype(np.int64), first), base, score)


def _untrained(totals: DataFrame) -> Model:
    """totals: word, kind, n of each distinct word. The model with zero weights: leaves and their frequencies only."""
    top = totals.filter("n > 0").orderBy(F.desc("n"), "word").limit(OWN).select("word", "n").collect()
    words, counts = np.array([w for w, _ in top], np.int64), np.array([n for _, n in top], np.int64)
    total, distinct = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
    total[: len(top)], distinct[: len(top)] = counts, 1
    known = totals.filter("n > 0").join(F.broadcast(totals.sparkSession.createDataFrame([(w,) for w, _ in top], "word long")), "word", "left_anti")
    for kind, n, v in known.groupBy("kind").agg(F.sum("n"), F.count(F.lit(1))).collect():  # LEAVES - OWN rows at most
        total[OWN + kind], distinct[OWN + kind] = n, v
    spread = np.log10(total + distinct + 1.0)
    spread[: len(top)] = 0
    mass = (total + 1.0).reshape(CLASSES, CLASSES)
    bias = np.log(mass.sum(1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
    order = np.argsort(words.view(np.uint64))
    return Model(np.zeros((2 * CLASSES, BUCKETS), np.float32), bias, words.view(np.uint64)[order], order, spread, int(total.sum()), int(distinct.sum()))


def score(docs: DataFrame, trained: Column | None = None) -> DataFrame:
    """Every row of docs: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score. trained: rows to learn from."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "lm")
    flagged = doc_texts(docs).withColumn("trained", F.lit(True) if trained is None else trained)
    size = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(chunks)).cast("int")
    dealt = flagged.select(chunk.alias("chunk"), "trained", "doc_id", "text").repartitionById(chunks, F.col("chunk"))
    chunked = written(dealt, "chunks", folder, compression="zstd")
    gathered = written(chunked.mapInArrow(tidy(_gathered), "chunk int, word long, kind int, n long"), "gathered", folder, compression="zstd")
    totals = written(gathered.groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "totals", folder, compression="zstd")
    model = train(_untrained(totals), chunked)
    held = spark.sparkContext.broadcast(model)
    none = lambda kind: F.lit(None).cast(kind)
    known = gathered.select("chunk", "word").join(totals.filter("n > 0").select("word", "n"), "word")  # words without a row are unknown
    asked = known.select("chunk", F.lit(True).alias("is_word"), "word", "n", none("boolean").alias("trained"), none("long").alias("doc_id"), none("string").alias("text"))
    told = chunked.select("chunk", F.lit(False).alias("is_word"), none("long").alias("word"), none("long").alias("n"), "trained", "doc_id", "text")
    met = asked.unionByName(told).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", F.col("is_word").desc())
    scored = met.mapInArrow(tidy(lambda batches: _scored(held, batches)), "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.n_all).cast("long"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), fold(7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
