"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics of the whole text (no label, lang, source or doc_id among them) are standardised with the training rows'
means and deviations; FEATURES random cosines approximate a Gaussian kernel over them. Each partition sums its normal
equations, the sums of the partitions are added up, and the driver solves a FEATURES x FEATURES ridge system. Every
fifth training row (by crc32) is kept out of the ridge fit and calibrates its raw scores by pool-adjacent-violators over
BINS bins, whose sums come from the partitions too. All labelled rows outside the held-out fold are used.

Null text counts as empty; an empty text has statistics and a score like any other. Null labels are not learnt from.
Several labels of a doc_id: their mean counts. Repeated rows give a row each. Without any training row (or an empty
table) the score is PRIOR. Null doc_ids are scored and not learnt from. Very long texts are read whole. Other columns,
whatever their names, are not read. predicted: score >= THRESHOLD.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import doc_texts, fold, new_folder, slices, table, tidy, written

FEATURES, RIDGE, BANDWIDTH, BINS, SEED = 384, 3.0, 3.5, 512, 11
THRESHOLD, PRIOR = 0.3, 0.5

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 non-ASCII, 7 mark
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 13]], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 6
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 7
_MARKS = b".,!?|#$%&*@{}<>:;=/_-()'\"\\"


def statistics(text: bytes) -> list[float]:
    """Shape of a text: sizes, shares of character kinds and marks, repetition of words, lines and pairs."""
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) / max(1, n)
    words, lines = text.split(), text.split(b"\n")
    lowered = [w.lower() for w in words]
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    bare = [w.strip(_MARKS) for w in lowered]
    distinct = len(set(lowered))
    same = sum(map(bytes.__eq__, lowered, lowered[1:]))
    counts = np.bincount(data, minlength=256)
    p = counts[counts > 0] / max(1, n)
    packed = len(zlib.compress(text, 1)) / n if n else 1.0
    marks = [int(counts[c]) / m for c in _MARKS]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *kinds.tolist(), float(sizes.mean()), float(sizes.std()), float(sizes.max()) ** 0.5,
        distinct / m, distinct / m**0.75, same / m, len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)) / 20, float(-(p * np.log2(p)).sum()), packed,
        sum(w.isupper() for w in words) / m, sum(w[:1].isupper() for w in words) / m, sum(not b for b in bare) / m, sum(len(w) - len(b) > 2 for w, b in zip(words, bare, strict=True)) / m,
        sum(l.rstrip().endswith((b".", b"!", b"?")) for l in lines) / max(1, len(lines)), sum(b.isdigit() for b in bare) / m, *[min(x, 3.0) for x in marks],
    ]


N_STATISTICS = len(statistics(b"A text."))


def _described(keys: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        stats = np.array([statistics(x) for x in texts], np.float64)
        flat = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATISTICS, dtype=np.int32), pa.array(stats.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), flat], names=[*keys, "stats"])


def _longs(keys: tuple[str, ...]) -> str:
    return "".join(f"`{k}` long, " for k in keys)


def describe(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns (longs) and stats of every row of docs."""
    keys = ("doc_id", *carried)
    texts = doc_texts(docs) if not carried else docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(lambda batches: _described(keys, batches)), _longs(keys) + "stats array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("stats")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # of the calibration's steps, over raw scores
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        omega, phase = rng.normal(0, 1 / BANDWIDTH, (N_STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ omega + phase) * np.sqrt(2 / FEATURES), z / 8, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(stats), PRIOR)
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over the rows of of(stats, y), arrays of `width` numbers: summed in each task, then by Spark in pieces."""
    step = 4096

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                total += of(_matrix(part), part.column("y").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(np.arange(width) % step == 0)
        yield pa.RecordBatch.from_arrays([pa.array(at // step, pa.int32()), pa.array([total[a : a + step].tolist() for a in at], pa.list_(pa.float64()))], names=["piece", "sums"])

    out = np.zeros(width)
    parts = rows.select("stats", "y").mapInArrow(tidy(summed), "piece int, sums array<double>").select("piece", F.posexplode("sums").alias("i", "x"))
    for piece, sums in parts.groupBy("piece", "i").agg(F.sum("x").alias("x")).groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("piece", "s.x").toLocalIterator():
        out[piece * step : piece * step + len(sums)] = sums
    return out


def _pooled(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to total / weight."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total, strict=True):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in blocks]) if blocks else np.zeros(0)


def fit(described: DataFrame, labels: DataFrame) -> Model:
    """described: doc_id, stats. labels: doc_id, y (0 to 1). Rows of the held-out fold must not be among the labels."""
    known = described.join(labels, "doc_id").select("doc_id", "stats", "y")
    rows = written(known, "training", new_folder(described.sparkSession, "quality"))
    s = _sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * N_STATISTICS)
    n = s[0]
    model = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(FEATURES + N_STATISTICS + 1), np.zeros(0), np.zeros(0))
    if not n:
        return model
    model.mean = s[1 : 1 + N_STATISTICS] / n
    deviation = np.sqrt(np.maximum(0, s[1 + N_STATISTICS :] / n - model.mean**2))
    model.scale = np.where(deviation > 1e-9, deviation, 1.0)
    d = FEATURES + N_STATISTICS + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.concatenate([(f.T @ f).reshape(-1), f.T @ y])

    part = F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")), F.lit(5))
    s = _sums(rows.filter(part != 0), normal, d * d + d)
    model.weights = np.linalg.solve(s[: d * d].reshape(d, d) + RIDGE * np.eye(d), s[d * d :])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)  # raw scores from -0.5 to 1.5
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    kept = rows.filter(part == 0)
    s = _sums(kept, binned, 3 * BINS)
    if not s[:BINS].any():  # too few rows to keep any apart
        s = _sums(rows, binned, 3 * BINS)
    used = s[:BINS] > 0
    model.edges, model.levels = s[2 * BINS :][used] / s[:BINS][used], _pooled(s[:BINS][used], s[BINS : 2 * BINS][used])
    model.edges = np.maximum.accumulate(model.edges)
    return model


def score(described: DataFrame, model: Model, *carried: str) -> DataFrame:
    """doc_id, the carried columns, score, predicted of each row."""
    keys = ("doc_id", *carried)
    held = described.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                s = held.value.score(_matrix(part))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keys, "score", "predicted"])

    return described.mapInArrow(tidy(scored), _longs(keys) + "score double, predicted int")


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and y of the labels outside the held-out fold: crc32(doc_id as text) mod 5 is not 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null")
    return rows.filter(fold(5) != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))


def classify(docs: DataFrame, labels: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns (longs), score, predicted of every row of docs."""
    described = written(describe(docs, *carried), "statistics", new_folder(docs.sparkSession, "quality"))
    return score(described, fit(described, learnable(labels)), *carried)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
