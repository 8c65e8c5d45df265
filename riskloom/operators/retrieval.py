"""Cosine retrieval over stored vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Components that a block of vectors and one of queries hold; vectors multiplied at once; blocks where there are rows for them.
BLOCK_VALUES, QUERY_VALUES, CHUNK, LEAST_BLOCKS = 1 << 23, 1 << 19, 2048, 24


def cosine(a: Column, b: Column) -> Column:
    """0 where the sizes differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


class Vectors:
    """Rows of one side of a block. `code` orders the ids of both sides, `dim` is -1 for a null vector, `odd` rows have null or
    non-finite components or a norm that single precision can't hold."""

    def __init__(self, code: np.ndarray, column: pa.ChunkedArray):
        lists = pa.concat_arrays([c.cast(pa.list_(c.type.value_type)) for c in column.chunks]) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
        self.code, self.dim = code, pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, size = lists.flatten(), np.maximum(self.dim, 0)
        self.start = np.cumsum(size) - size
        empty = flat.is_null().to_numpy(zero_copy_only=False)
        self.flat = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        self.none = (self.dim < 0) | (np.bincount(row[empty], minlength=len(size)) > 0)
        self.norm = np.zeros(len(size))
        for d in np.unique(self.dim[self.dim > 0]):
            for at in _cut(np.flatnonzero(self.dim == d), CHUNK):
                with np.errstate(all="ignore"):
                    self.norm[at] = np.sqrt(_dots(x := self.rows(at, d), x))
        self.odd = self.none | ~((self.norm == 0) | ((self.norm > 1e-100) & (self.norm < 1e100))) | (np.bincount(row[self.flat != 0], minlength=len(size)) > 0) & (self.norm == 0)

    def rows(self, at: np.ndarray, d: int) -> np.ndarray:
        return self.flat[self.start[at][:, None] + np.arange(d)].astype(np.float64)

    def unit(self, at: np.ndarray, d: int) -> np.ndarray:
        return (self.rows(at, d) / np.where(self.norm[at] == 0, 1, self.norm[at])[:, None]).astype(np.float32)


def _cut(at: np.ndarray, n: int) -> list[np.ndarray]:
    return [at[i : i + n] for i in range(0, len(at), n)]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on as `cosine` sums them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _first_ids(v: Vectors, at: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k + 1 smallest ids: no query, which passes its own id by, needs more of rows with equal scores."""
    ids = np.unique(v.code[at])
    return at if len(ids) <= k + 1 else at[v.code[at] <= ids[k]]


def _without_copies(v: Vectors, at: np.ndarray, d: int, k: int) -> np.ndarray:
    """Of equal vectors those of the k + 1 smallest ids."""
    if not len(at) or not d:
        return _first_ids(v, at, k)
    x = np.ascontiguousarray(v.flat[v.start[at][:, None] + np.arange(d)])
    _, group = np.unique(x.view(np.dtype((np.void, x.itemsize * d))).ravel(), return_inverse=True)
    order = np.lexsort((v.code[at], group))
    g, code = group[order], v.code[at][order]
    first = np.r_[True, g[1:] != g[:-1]]
    dense = np.cumsum(first | np.r_[True, code[1:] != code[:-1]])
    return at[order][dense - np.maximum.accumulate(np.where(first, dense, 0)) <= k]


def _kept(q: np.ndarray, score: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Of pairs those that lie at most margin beneath their query's k-th score."""
    order = np.lexsort((-score, q))
    by = q[order]
    place = np.arange(len(by)) - np.searchsorted(by, by)
    least = np.full(int(q.max()) + 1 if len(q) else 0, -np.inf)
    least[by[place == k - 1]] = score[order][place == k - 1]
    return score >= least[q] - margin


def _nearest(q: Vectors, qs: np.ndarray, v: Vectors, vs: np.ndarray, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of d components that can be among a query's k best: products in single precision, with a margin for their
    rounding and that of scores."""
    margin = 2 * (d + 8) * 2.0**-23 + 1.1e-6
    a, got, least = q.unit(qs, d), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(qs), -np.inf)
    by_code = np.argsort(q.code[qs], kind="stable")
    codes = q.code[qs][by_code]
    for at in _cut(vs, CHUNK):
        s = a @ v.unit(at, d).T
        lo, hi = np.searchsorted(codes, v.code[at], "left"), np.searchsorted(codes, v.code[at], "right")
        for j in np.flatnonzero(hi > lo):
            s[by_code[lo[j] : hi[j]], j] = -np.inf
        if np.isneginf(least).any() and s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - margin)
        i, j = np.nonzero(s >= np.maximum(least, -2)[:, None])
        got = tuple(np.concatenate(x) for x in zip(got, (i, at[j], s[i, j].astype(np.float64))))
        keep = _kept(got[0], got[2], k, margin)
        got = tuple(x[keep] for x in got)
        order = np.lexsort((-got[2], got[0]))
        by = got[0][order]
        kth = order[np.arange(len(by)) - np.searchsorted(by, by) == k - 1]
        least[got[0][kth]] = got[2][kth] - margin
    return qs[got[0]], got[1]


def _scores(q: Vectors, v: Vectors, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`cosine` of pairs of rows, and where it is null."""
    same, score = q.dim[i] == v.dim[j], np.zeros(len(i))
    for d in np.unique(q.dim[i][same]):
        for at in _cut(np.flatnonzero(same & (q.dim[i] == d)), CHUNK):
            with np.errstate(all="ignore"):
                norm = q.norm[i[at]] * v.norm[j[at]]
                score[at] = np.where(norm == 0, 0.0, _dots(q.rows(i[at], max(d, 0)), v.rows(j[at], max(d, 0))) / norm)
    return score, (q.dim[i] < 0) | (v.dim[j] < 0) | (same & (q.none[i] | v.none[j]))


def _best(k: int):
    """Of a block of vectors what can be among the k best of each query of a block: query_id, vec_id, score (not rounded)."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = pa.schema([queries.schema.field("query_id"), vectors.schema.field("vec_id"), ("score", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return out.empty_table()
        ids = np.concatenate([queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()])
        code = np.unique(ids, return_inverse=True)[1]
        q, v = Vectors(code[: queries.num_rows], queries.column("query")), Vectors(code[queries.num_rows :], vectors.column("embedding"))
        found = []
        for d in np.unique(q.dim):
            mine, same, null = np.flatnonzero(q.dim == d), np.flatnonzero(v.dim == d), v.dim < 0
            if d < 0:
                pairs = [(mine, _first_ids(v, np.arange(len(v.dim)), k))]
            else:
                plain = _without_copies(v, same[~v.odd[same]], d, k)
                odd, far = same[v.odd[same]], [_first_ids(v, np.flatnonzero(x), k) for x in ((v.dim != d) & ~null, null)]
                pairs = [(mine, x) for x in (odd, *far)] + [(mine[q.odd[mine]], plain)]
                found.append(_nearest(q, mine[~q.odd[mine]], v, plain, d, k))
            found += [(np.repeat(some, len(x)), np.tile(x, len(some))) for some_, x in pairs for some in _cut(some_, max(1, (1 << 22) // max(1, len(x))))]
        parts = []
        for i, j in found:
            other = q.code[i] != v.code[j]
            score, null = _scores(q, v, i := i[other], j := j[other])
            parts.append((i, j, score, null))
        i, j, score, null = (np.concatenate(x) for x in zip(*parts))
        keep = _kept(i, np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score)), k, 1.1e-6)
        i, j = i[keep], j[keep]
        return pa.table([queries.column("query_id").take(pa.array(i)), vectors.column("vec_id").take(pa.array(j)), pa.array(score[keep], mask=null[keep])], schema=out)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """queries: query_id, query; vectors: vec_id, embedding. The k best vectors of each query; ties by vec_id.

    Both sides are dealt into blocks of bounded size, and a task multiplies one block of vectors by one of queries as matrices
    in single precision. Pairs that can be among the k best are then scored as `cosine` does, so that the result is exact; only
    those, about k a query and block, are ranked. Work is queries times vectors, memory that of two blocks.
    """
    n, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    m, dims = queries.count(), max(1, most or 1)
    v_blocks, q_blocks = max(-(-n // max(1, BLOCK_VALUES // dims)), min(LEAST_BLOCKS, -(-n // CHUNK)), 1), max(1, -(-m // max(1, QUERY_VALUES // dims)))
    deal = lambda blocks, *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    v = vectors.filter("vec_id is not null").select("vec_id", "embedding", deal(v_blocks, "vec_id", "embedding").alias("vb"), all_of(q_blocks).alias("qb"))
    q = queries.filter("query_id is not null").select("query_id", "query", deal(q_blocks, "query_id", "query").alias("qb"), all_of(v_blocks).alias("vb"))
    schema = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("vec_id", v.schema["vec_id"].dataType), StructField("score", DoubleType())])
    n_tasks = v_blocks * q_blocks
    place = F.col("vb") * q_blocks + F.col("qb")
    v, q = (x.withColumn("block", place).repartition(n_tasks, "block") for x in (v, q))
    met = v.groupBy("block").cogroup(q.groupBy("block")).applyInArrow(_best(k), schema)
    scored = met.withColumn("score", F.round("score", 6))
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
