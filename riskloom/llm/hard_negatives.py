"""Hard negatives for anchors, by branch and bound over ball trees.

Vectors become integers, floor(256 * x). Rows are dealt by ranges of (length, label, vec_id, row) and each partition builds ball
trees of at most TREE_ROWS rows: a node parts its labels first, then the dimension that varies most, and keeps a centre, a
radius and its smallest and largest label. Anchors stand in blocks of at most BLOCK_ROWS in order of their label. A task takes
one block and a few trees. It walks each tree with all of the block's anchors at once and drops an anchor at a node whose
upper bound lies strictly beneath the anchor's current k-th score, or, for negatives, whose bounds lie outside the score
windows of all its positives, or whose labels can't serve. What tasks find per anchor (k rows each) meets in one ranking.

Positives and negatives each take such a pass. Both are exact: bounds carry a margin for rounding, ties are never pruned.

Scores are integers of 64 bits; where a product of two vectors could pass that, the run raises. Rows with a null label, a null
vector, or a null or non-finite component take no part; vectors of another length than the anchor's don't meet it. A null
vec_id is no anchor and ranks last; rows that repeat a vec_id are rows of their own ("other rows" means other rows, not ids),
and a repeated anchor has its results once for each of its rows. An anchor without positives gives no rows. Empty table:
empty result. Columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import new_folder, table, tidy, written

TREE_ROWS, LEAF_ROWS, BLOCK_ROWS, TREES_AT_ONCE, BUCKET_TREES = 2048, 64, 2048, 8, 4096
NO_ID = np.iinfo(np.int64).max  # stands for a null vec_id
NONE = -(1 << 62)  # no score yet; scores are larger


@dataclass(frozen=True)
class Mining:
    """positives and negatives: how many of each; a negative's score lies between low and high hundredths of its positive's."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def quantised(rows: DataFrame, every: int) -> DataFrame:
    """(row, vec_id, label, dim, vector, anchor): the rows that take part, as integers. every: an anchor's vec_id is divisible by it."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.transform(x, lambda v: F.floor(v * 256).cast("long"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.filter(good).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), whole.alias("vector"))
    return kept.withColumn("anchor", F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))


class Tree:
    """Nodes in preorder over rows in the nodes' order: first, last (rows), right (0: a leaf), centre, radius, least and most (label)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order, self.first, self.last, self.right, centre, self.radius, self.least, self.most = np.lexsort((ids, labels)), [], [], [], [], [], [], []
        x = vectors.astype(np.float64)

        def grow(a: int, b: int) -> int:
            k, own = len(self.first), order[a:b]
            mean = x[own].mean(0)
            span = labels[own].min(), labels[own].max()
            for to, v in ((self.first, a), (self.last, b), (self.right, 0), (centre, mean), (self.radius, np.sqrt(((x[own] - mean) ** 2).sum(1).max())), (self.least, span[0]), (self.most, span[1])):
                to.append(v)
            if b - a > LEAF_ROWS:
                if span[0] < span[1]:  # by label, near the middle
                    order[a:b] = own[np.argsort(labels[own], kind="stable")]
                    cuts = a + 1 + np.flatnonzero(np.diff(labels[order[a:b]]))
                    m = int(cuts[np.abs(cuts - (a + b) / 2).argmin()])
                else:
                    m = (a + b) // 2
                    if x.shape[1]:
                        order[a:b] = own[np.argsort(x[own, x[own].var(0).argmax()], kind="stable")]
                grow(a, m)
                self.right[k] = grow(m, b)
            else:
                order[a:b] = own[np.argsort(ids[own], kind="stable")]
            return k

        grow(0, len(ids))
        self.centre = np.array(centre).reshape(len(centre), x.shape[1])
        self.vectors, self.ids, self.labels, self.rows = vectors[order], ids[order], labels[order], rows[order]


def _floats_are_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products stay below 2**53; raises where they could pass 62 bits."""
    if not a.size or not b.size:
        return True
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    if most >= 1 << 62:
        raise ArithmeticError("scores of these vectors don't fit 62 bits")
    return most < 1 << 53


class Best:
    """The k best (score, id) of each query so far, best first: ids ascend within a score."""

    def __init__(self, queries: int, k: int):
        self.score, self.id = np.full((queries, k), NONE), np.full((queries, k), NO_ID)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: (len(at), m), NONE where a row doesn't count; ids: (m,)."""
        use = (score >= self.score[at, -1][:, None]).any(1) & (score > NONE).any(1)
        at, score = at[use], score[use]
        if len(at):
            k = self.score.shape[1]
            both = np.concatenate([self.score[at], score], 1)
            names = np.concatenate([self.id[at], np.broadcast_to(ids, score.shape)], 1)
            pick = np.lexsort((names, -both), axis=1)[:, :k]
            self.score[at], self.id[at] = np.take_along_axis(both, pick, 1), np.take_along_axis(names, pick, 1)


def searched(tree: Tree, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, best: Best, windows: tuple[np.ndarray, np.ndarray] | None) -> int:
    """Walks the tree with all anchors; returns how many products with rows it took.

    Without windows: rows of the anchor's own label other than itself, best has a query for each anchor. With windows
    (lowest, highest: anchors x positives): rows of other labels, best has a query for each anchor and positive.
    """
    exact = _floats_are_exact(vectors, tree.vectors)
    q = vectors.astype(np.float64)
    norm = np.sqrt((q**2).sum(1))
    points = tree.vectors.astype(np.float64) if exact else tree.vectors
    taken = 0
    stack = [(0, np.arange(len(q)))]
    while stack:
        k, at = stack.pop()
        least, most = tree.least[k], tree.most[k]
        at = at[(labels[at] >= least) & (labels[at] <= most)] if windows is None else at[~((labels[at] == least) & (least == most))]
        if not len(at):
            continue
        middle, reach = q[at] @ tree.centre[k], norm[at] * tree.radius[k]
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        above, below = middle + reach + slack, middle - reach - slack
        if windows is None:
            at = at[above >= best.kth()[at]]
        else:
            low, high = windows[0][at], windows[1][at]
            kth = best.kth().reshape(windows[0].shape)[at]
            at = at[((above[:, None] >= np.maximum(low, kth)) & (below[:, None] <= high) & (low <= high)).any(1)]
        if not len(at):
            continue
        if tree.right[k]:
            # the child whose centre is nearer to most anchors comes off the stack first: its rows raise the k-th scores
            a, b = k + 1, tree.right[k]
            nearer = (q[at] @ tree.centre[a]).sum() >= (q[at] @ tree.centre[b]).sum()
            stack += [(b, at), (a, at)] if nearer else [(a, at), (b, at)]
            continue
        own = slice(tree.first[k], tree.last[k])
        score = (q[at] @ points[own].T).astype(np.int64) if exact else vectors[at] @ points[own].T
        taken += score.size
        same = labels[at][:, None] == tree.labels[own]
        if windows is None:
            best.add(at, np.where(same & (rows[at][:, None] != tree.rows[own]), score, NONE), tree.ids[own])
        else:
            p = windows[0].shape[1]
            for j in range(p):
                ok = ~same & (score >= windows[0][at, j][:, None]) & (score <= windows[1][at, j][:, None])
                best.add(at * p + j, np.where(ok, score, NONE), tree.ids[own])
    return taken


_ARRAYS = ("vectors", "ids", "labels", "rows")
_PACKED = ", ".join(f"{c} binary" for c in _ARRAYS)
_TREE = f"tree long, dim int, held array<long>, n int, {_PACKED}, nodes binary, radius binary, centre binary"


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """vectors, ids, labels and rows of runs of at most `most` rows of one vector length."""
    dim, parts, n = 0, [], 0
    for batch in batches:
        dims, values = batch.column("dim").to_numpy(), batch.column("vector").flatten().to_numpy(zero_copy_only=False)
        ids, labels, rows = (batch.column(c).fill_null(NO_ID).to_numpy() for c in ("vec_id", "label", "row"))
        ends, a = np.cumsum(dims, dtype=np.int64), 0
        while a < len(dims):
            if n and (dims[a] != dim or n == most):
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, n = [], 0
            dim = int(dims[a])
            others = np.flatnonzero(dims[a:] != dim)
            b = min(a + int(others[0]) if len(others) else len(dims), a + most - n)
            parts.append((values[ends[a] - dim : ends[b - 1]].reshape(b - a, dim), ids[a:b], labels[a:b], rows[a:b]))
            n, a = n + b - a, b
    if n:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (f.strip().split(" ") for f in fields.split(","))])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, TREE_ROWS):
        t = Tree(*run)
        nodes = np.array([t.first, t.last, t.right, t.least, t.most], np.int64)
        values = [t.rows.min(), t.vectors.shape[1], np.unique(t.labels).tolist(), len(t.rows), *(getattr(t, c).tobytes() for c in _ARRAYS), nodes.tobytes(), np.array(t.radius).tobytes(), t.centre.tobytes()]
        yield pa.RecordBatch.from_pylist([dict(zip(_arrow(_TREE).names, values, strict=True))], _arrow(_TREE))


def _tree(row: dict) -> Tree:
    t, dim = Tree.__new__(Tree), row["dim"]
    for c in ("vectors", "ids", "labels", "rows"):
        setattr(t, c, np.frombuffer(row[c], np.int64))
    t.vectors = t.vectors.reshape(row["n"], dim)
    nodes = np.frombuffer(row["nodes"], np.int64).reshape(5, -1)
    t.first, t.last, t.right, t.least, t.most = (x.tolist() for x in nodes)
    t.radius, t.centre = np.frombuffer(row["radius"]), np.frombuffer(row["centre"]).reshape(nodes.shape[1], dim)
    return t


_BLOCK = f"block long, dim int, held array<long>, n int, {_PACKED}"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _runs(batches, BLOCK_ROWS):
        values = [x[3].min(), x[0].shape[1], np.unique(x[2]).tolist(), len(x[3]), *(v.tobytes() for v in x)]
        yield pa.RecordBatch.from_pylist([dict(zip(_arrow(_BLOCK).names, values, strict=True))], _arrow(_BLOCK))


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ["dim", "label", F.asc_nulls_last("vec_id"), "row"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "vec_id", "label", "dim", "vector")


def _block(row: dict) -> tuple[np.ndarray, ...]:
    x = [np.frombuffer(row[c], np.int64) for c in ("vectors", "ids", "labels", "rows")]
    return x[0].reshape(row["n"], row["dim"]), *x[1:]


_LOCAL_POSITIVES = "block long, slot int, anchor_id long, id long, score long"
_LOCAL_NEGATIVES = "block long, slot int, rank int, id long, score long"


def _rows_of(best: Best, fields: str, block: int, *slots: np.ndarray) -> pa.Table:
    at, _ = np.nonzero(best.score > NONE)
    ok = best.score > NONE
    columns = [np.full(len(at), block), *(s[at] for s in slots), best.id[ok], best.score[ok]]
    schema = _arrow(fields)
    return pa.table([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _find_positives(k: int):
    def find(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        (block,) = blocks.to_pylist()
        vectors, ids, labels, rows = _block(block)
        best = Best(len(ids), k)
        for t in trees.to_pylist():
            searched(_tree(t), vectors, labels, rows, best, None)
        return _rows_of(best, _LOCAL_POSITIVES, block["block"], np.arange(len(ids)), ids)

    return find


def _find_negatives(m: Mining):
    def find(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        (block,) = blocks.to_pylist()
        vectors, ids, labels, rows = _block(block)
        low, high = np.full((len(ids), m.positives), 1), np.full((len(ids), m.positives), 0)  # without a positive: empty
        for p in block["found"]:
            low[p["slot"], p["rank"] - 1] = -((-m.low * p["score"]) // 100)
            high[p["slot"], p["rank"] - 1] = m.high * p["score"] // 100
        best = Best(low.size, m.negatives)
        for t in trees.to_pylist():
            searched(_tree(t), vectors, labels, rows, best, (low, high))
        at = np.arange(low.size)
        return _rows_of(best, _LOCAL_NEGATIVES, block["block"], at // m.positives, at % m.positives + 1)

    return find


def _asked(pairs: DataFrame, trees: DataFrame, blocks: DataFrame, find, fields: str) -> DataFrame:
    """find over each block and group of TREES_AT_ONCE of the trees it is paired with; pairs: (block, tree)."""
    bucket = F.pmod(F.xxhash64("tree"), F.lit(trees.count() // BUCKET_TREES + 1))
    group = F.floor((F.row_number().over(Window.partitionBy("block", "bucket").orderBy("tree")) - 1) / TREES_AT_ONCE)
    pairs = pairs.withColumn("bucket", bucket).withColumn("part", F.struct("bucket", group))
    left = pairs.join(trees, "tree").groupBy("block", "part")
    asked = pairs.select(F.col("block").alias("at"), F.col("part").alias("asked")).distinct()
    right = asked.join(blocks, F.col("at") == F.col("block")).groupBy("at", "asked")
    return left.cogroup(right).applyInArrow(find, fields)


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(rows: DataFrame, every: int = 50, mining: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score); scores of integer vectors."""
    folder = new_folder(rows.sparkSession, "negatives")
    points = written(quantised(rows, every), "points", folder, compression="zstd")
    trees = written(_dealt(points).mapInArrow(tidy(_build), _TREE), "trees", folder, compression="zstd")
    blocks = written(_dealt(points.filter("anchor")).mapInArrow(tidy(_blocks), _BLOCK), "blocks", folder, compression="zstd")

    own, other = blocks.select("block", "dim", F.explode("held").alias("label")), trees.select("tree", "dim", F.explode("held").alias("label"))
    pairs = own.join(other, ["dim", "label"]).select("block", "tree").distinct()
    local = _asked(pairs, trees, blocks, _find_positives(mining.positives), _LOCAL_POSITIVES)
    positives = written(_ranked(local, mining.positives, "block", "slot").withColumnRenamed("place", "rank"), "positives", folder)

    lists = positives.groupBy("block").agg(F.collect_list(F.struct("slot", "rank", "score")).alias("found"))  # at most BLOCK_ROWS * positives
    asking = blocks.join(lists, "block")
    own, other = asking.select("block", "dim", F.col("held").alias("own")), trees.select("tree", "dim", "held")
    pairs = own.join(other, "dim").filter((F.size("own") > 1) | (F.size("held") > 1) | (F.col("own")[0] != F.col("held")[0])).select("block", "tree")
    local = _asked(pairs, trees, asking, _find_negatives(mining), _LOCAL_NEGATIVES)
    negatives = _ranked(local, mining.negatives, "block", "slot", "rank").select("block", "slot", "rank", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = negatives.join(positives.select("block", "slot", "rank", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "slot", "rank"])
    named = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return found.select("anchor_id", named("positive_id"), F.col("rank").alias("positive_rank"), F.col("place").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = """WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
  SELECT a.id AS anchor, a.vec_id AS anchor_id, b.id AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM points a JOIN points b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
) SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
