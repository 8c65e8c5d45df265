"""A Merkle manifest of a dataset: a tree of digests for each source, a tree of the sources' subroots, proofs for rows.

A row's leaf is the SHA-256 of its columns, each as its number of UTF-8 bytes, a colon and the value, or `-` for null. Rows get
their place in their tree by row_number; a node's place divided by FANOUT is its parent's. Each level groups at most FANOUT
sorted children by parent and hashes their digests, until a tree has one node. Then paths come down again: each level joins
its groups with their parents' paths and puts the siblings before them, so that the long paths meet few rows, and the rows
themselves move once for their place and once for their group, without their texts.

Places are counted in ranges of (tree, key, digest, row) of even size, whose sizes are summed up, so that no task holds a
whole source. A null key comes first in its tree; rows that repeat a key stand by their digest, and equal rows are each a
leaf. A null source is a tree of its own, before all others, apart from an empty name. An empty table has no root and no rows.
Columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, new_folder, table, written

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Names the tree of the subroots; the trees of sources are named "-" (null) or "=" and the source.
TOP = ""


def digest(*columns: Column) -> Column:
    """SHA-256 over the columns, each counted, in lowercase hex."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _hash(children: Column) -> Column:
    return F.sha2(_joined(F.transform(children, lambda c: c["hash"])).cast("binary"), 256)


def placed(nodes: DataFrame, folder: str, name: str) -> DataFrame:
    """nodes(tree, key, hash, ...) with idx, the place in its tree from 0, and n, the tree's size."""
    count = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a given number is not coalesced
    cut = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(count, "tree", "key", "hash", "tie")
    ranged = written(cut.withColumn("part", F.spark_partition_id()), name, folder, compression="zstd")
    sizes = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy("key", "hash", "tie")) - 1
    return ranged.withColumn("within", within).join(sizes, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("within")).drop("within", "before", "part", "tie")


def _grouped(nodes: DataFrame, *fields: str) -> DataFrame:
    """(tree, n, parent, children): the runs of at most FANOUT nodes in order."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "hash", *fields)))
    return nodes.groupBy("tree", "n", F.floor(F.col("idx") / FANOUT).alias("parent")).agg(rows.alias("children"))


def _parents(groups: DataFrame) -> DataFrame:
    """The nodes above groups. A lone node stands for itself."""
    own = F.when(F.col("n") == 1, F.col("children")[0]["hash"]).otherwise(_hash(F.col("children")))
    return groups.select("tree", F.ceil(F.col("n") / FANOUT).alias("n"), F.col("parent").alias("idx"), own.alias("hash"))


@dataclass
class Manifest:
    """levels[0] groups the rows, each further one the nodes above; subroots: (tree, hash) of each tree."""

    levels: list[DataFrame]
    subroots: DataFrame


def grown(leaves: DataFrame, fields: tuple[str, ...], folder: str, name: str) -> Manifest:
    """Levels over leaves(tree, key, hash, fields), each written."""
    levels = [written(_grouped(placed(leaves, folder, f"{name}-rows"), *fields), f"{name}-0", folder, compression="zstd")]
    largest = levels[0].agg(F.max("n")).first()[0] or 1
    finished = []
    for k in range(1, max(1, math.ceil(round(math.log(largest, FANOUT), 9))) + 1):
        nodes = _parents(levels[-1])
        finished.append(nodes.filter("n = 1").select("tree", "hash"))
        if FANOUT**k < largest:
            levels.append(written(_grouped(nodes.filter("n > 1")), f"{name}-{k}", folder, compression="zstd"))
    subroots = finished[0]
    for x in finished[1:]:
        subroots = subroots.unionByName(x)
    return Manifest(levels, written(subroots, f"{name}-subroots", folder))


def _children(groups: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, idx, path, subroot, root, child): each child's siblings to the left and right before its parent's path."""
    met = groups.join(above.withColumnRenamed("idx", "parent"), ["tree", "parent"])
    side = lambda at, length: _joined(F.transform(F.slice("children", at, length), lambda c: c["hash"]))
    rows = met.select("tree", "n", "path", "subroot", "root", "children", F.posexplode("children").alias("i", "child"))
    own = F.array(F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(FANOUT)).alias("right")))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(own, "path"))
    return rows.select("tree", F.col("child.idx").alias("idx"), path.alias("path"), "subroot", "root", "child")


def descended(manifest: Manifest, tops: DataFrame) -> DataFrame:
    """The leaves with their paths, from tops(tree, path, subroot, root)."""
    above = None
    for k in range(len(manifest.levels) - 1, -1, -1):
        groups = manifest.levels[k]
        ends = groups.filter(F.col("n") <= FANOUT).select("tree").join(tops, "tree").withColumn("idx", F.lit(0).cast("long"))
        ends = ends.select("tree", "idx", "path", "subroot", "root")
        inner = ends if above is None else ends.unionByName(above)
        children = _children(groups, inner)
        above = children.select("tree", "idx", "path", "subroot", "root") if k else children
    return above


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", source: str = "source", also: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root and path (digests left and right of the node, level by level from the leaf up), and `also`."""
    folder, also = new_folder(docs.sparkSession, "merkle"), also or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("key"), digest(*(F.col(c) for c in columns)).alias("hash"), *(c.alias(k) for k, c in also.items()))
    leaves = written(leaves, "leaves", folder, compression="zstd")  # the texts are read once
    sources = grown(leaves, ("key", *also), folder, "rows")
    top = grown(sources.subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "hash"), ("key",), folder, "sources")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    roots = top.subroots.select("tree", empty.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    subroots = descended(top, roots).select(F.col("child.key").alias("tree"), "path", F.col("child.hash").alias("subroot"), "root")
    rows = descended(sources, written(subroots, "tops", folder))
    return rows.select(F.col("child.key").alias(key), F.col("child.hash").alias("leaf"), "subroot", "root", "path", *(F.col(f"child.{k}").alias(k) for k in also))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]).cast("binary"), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against texts of which a fifth are tampered with: A-Z lower-cased."""
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    tampered = F.when(hit, digest(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS)))
    rows = proofs(table(spark, sf_dir, "documents"), also={"tampered": tampered})
    siblings = _joined(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS)
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit over the decimal digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _tree_sql(name: str, leaves: str) -> str:
    """Recursive levels of leaves(tree, idx, n, hash): every node with its level, and each tree's end."""
    return f"""{name}_nodes(tree, level, idx, n, hash) AS (
  SELECT tree, 0, idx, n, hash FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 16, n
), {name}_tops AS (SELECT tree, hash FROM {name}_nodes WHERE n = 1
), {name}_runs AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name}_nodes a JOIN {name}_nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL)"""


def _walk_sql(name: str, start: str) -> str:
    """From start(id, tree, idx, proof, fold): proof and digest of each id at its tree's end."""
    return f"""{name}_walk(id, tree, level, idx, proof, fold) AS (
  SELECT id, tree, 0, idx, proof, fold FROM {start}
  UNION ALL
  SELECT w.id, w.tree, w.level + 1, w.idx // 16, w.proof || s.l || s.r, sha256(s.l || w.fold || s.r) FROM {name}_walk w JOIN {name}_runs s ON w.tree = s.tree AND w.level = s.level AND w.idx = s.idx
), {name}_ends AS (SELECT id, tree, arg_max(proof, level) AS proof, arg_max(fold, level) AS fold FROM {name}_walk GROUP BY id, tree)"""


OP11_SQL = f"""WITH RECURSIVE documents_hashed AS (
  SELECT coalesce('=' || source, '-') AS tree, doc_id, sha256({_LEAF}) AS hash,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_LEAF.replace("CAST(text AS VARCHAR)", _ASCII_LOWER)}) END AS tampered FROM documents
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, hash) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM documents_hashed
), {_tree_sql("row", "leaves")}, sources AS (
  SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, hash FROM row_tops
), {_tree_sql("source", "sources")}, row_start AS (SELECT id, tree, idx, '' AS proof, coalesce(tampered, hash) AS fold FROM leaves
), {_walk_sql("row", "row_start")}, source_start AS (SELECT e.id, s.tree, s.idx, e.proof, e.fold FROM row_ends e JOIN sources s ON e.tree = s.source
), {_walk_sql("source", "source_start")}
SELECT l.doc_id, l.hash AS leaf, t.hash AS subroot, r.hash AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = r.hash AS verified
FROM leaves l JOIN row_tops t ON l.tree = t.tree JOIN source_ends e ON l.id = e.id CROSS JOIN source_tops r"""
