"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
doc_id stays (a null doc_id is smaller than all others). Rows repeated with the same doc_id and text: one of them
stays. Very long texts are read whole, one at a time. Empty table: empty result. Columns beside doc_id and text, whatever
their names, are not read.

1. A scan hashes each text to a 64-bit key; counts of the keys' leading bits make the directory: buckets over the
   capacity split, and when a bucket's depth passes the directory's, the directory doubles. A key's copies never part,
   so a bucket stops splitting at MAX_DEPTH.
2. A scan folds the copies within a task (bytes compared) and sends one row per text and task to its bucket's owner:
   the directory is cut into contiguous key ranges of about equal size, one for each owner task. Hot groups so arrive as
   one row from each task.
3. Owner tasks read their ranges in key order, chain the entries of a key, compare the bytes of the normalised texts,
   and write one entry for each distinct text to the index, a Parquet table in the shared folder.
4. Documents look themselves up by key and digest. Entries with many copies, at most rows / HEAVY of them and at most
   BROADCAST_MOST, are broadcast; the others join by a shuffle in which no key has more than HEAVY rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import doc_texts, new_folder, record, table, texts_of, tidy, written

CAPACITY, MAX_DEPTH, START_DEPTH = 20_000, 24, 6
HEAVY, BROADCAST_MOST = 500, 50_000
FOLD_BYTES = 24 << 20

_KEYED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text_sha256", pa.string())])
_FOLDED = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("norm", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()), ("ties", pa.int64())])
_ENTRY = pa.schema([("key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])


def _key(norm: bytes) -> int:
    k = xxhash.xxh3_64_intdigest(norm)
    return k - (1 << 64) if k >> 63 else k


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [x.lower() for x in texts_of(batch)]  # bytes.lower() changes A-Z only
        yield record(_KEYED, batch.column("doc_id"), [_key(x) for x in norms], [hashlib.sha256(x).hexdigest() for x in norms])


def _above(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _add(entry: list, doc_id: int | None, n: int, ties: int) -> None:
    """entry: largest doc_id, rows, rows that have it."""
    if _above(doc_id, entry[0]):
        entry[0], entry[2] = doc_id, ties
    elif doc_id == entry[0]:
        entry[2] += ties
    entry[1] += n


def _folded(ranges, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ranges: the first key prefix of each owner. Copies within the task as one row; what exceeds FOLD_BYTES is handed on, but for texts seen often."""
    seen: dict[bytes, list] = {}
    held = 0

    def out(items: list) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(items), 2000):
            part = items[i : i + 2000]
            keys = np.array([_key(t) for t, _ in part], np.int64)
            owner = np.searchsorted(ranges.value, keys.view(np.uint64) >> np.uint64(64 - depth), "right") - 1
            yield record(_FOLDED, owner.astype(np.int32), keys, [t for t, _ in part], *([e[k] for _, e in part] for k in range(3)))

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            norm = text.lower()
            if (entry := seen.get(norm)) is None:
                seen[norm] = [doc_id, 1, 1]
                held += len(norm) + 200
            else:
                _add(entry, doc_id, 1, 1)
            if held > FOLD_BYTES:
                often = {t: e for t, e in seen.items() if e[1] >= 8}
                if sum(map(len, often)) > FOLD_BYTES // 2:
                    often = {}
                yield from out([x for x in seen.items() if x[0] not in often])
                seen, held = often, sum(len(t) + 200 for t in often)
    yield from out(list(seen.items()))


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order. The chain of a key holds its distinct texts."""
    key, chain, out = None, {}, []

    def close() -> None:
        out.extend((key, i, hashlib.sha256(t).hexdigest(), *e) for i, (t, e) in enumerate(chain.items()))

    for batch in batches:
        for k, norm, keep_id, n, ties in zip(*(batch.column(c).to_pylist() for c in _FOLDED.names[1:]), strict=True):
            if k != key:
                if key is not None:
                    close()
                key, chain = k, {}
            entry = chain.setdefault(norm, [None, 0, 0])  # equal bytes only
            _add(entry, keep_id, n, ties)
        if len(out) >= 2000:
            yield record(_ENTRY, *zip(*out, strict=True))
            out = []
    if key is not None:
        close()
    if out:
        yield record(_ENTRY, *zip(*out, strict=True))


def _prefix(depth: int):
    """The leading bits of the key, as a number from 0."""
    return F.shiftrightunsigned("key", 64 - depth).cast("long")


class Directory:
    """buckets[prefix of `depth` bits]: the bucket's number. Buckets are numbered by key range."""

    def __init__(self, depth: int, local: np.ndarray, counts: np.ndarray):
        self.depth, self.local = depth, local
        first = (np.arange(len(local)) & ((1 << (depth - local)) - 1)) == 0
        self.buckets = np.cumsum(first) - 1
        self.counts = np.bincount(self.buckets, counts).astype(np.int64)

    @classmethod
    def built(cls, counted, capacity: int = CAPACITY, depth: int = START_DEPTH, most: int = MAX_DEPTH) -> Directory:
        """counted(depth): rows by prefix of so many bits, as an array of 2**depth."""
        counts = counted(depth)
        local = np.full(1 << depth, depth)
        while depth < most:
            over = (local == depth) & (counts > capacity)
            if not over.any():
                break
            local = np.repeat(local, 2)  # the directory doubles; overfull buckets split, others keep two slots
            local[np.repeat(over, 2)] += 1
            depth += 1
            counts = counted(depth)
        return cls(depth, local, counts)

    def owners(self, n: int) -> np.ndarray:
        """For each slot of the directory the owner task: contiguous ranges of about equal counts."""
        before = np.cumsum(self.counts) - self.counts
        owner = before * n // max(1, int(self.counts.sum()))
        return owner[self.buckets]


def _directory(keyed: DataFrame, total: int, capacity: int) -> Directory:
    """keyed has total rows. From one aggregate over the distinct keys, 32 to 64 numbers for each bucket that the directory will have.

    So many bits are enough for hashed keys; a bucket that is overfull even then stays so, and its owner reads it as a
    stream.
    """
    fine = min(MAX_DEPTH, max(START_DEPTH, (total // capacity).bit_length() + 5))
    counts = np.zeros(1 << fine, np.int64)
    for p, n in keyed.select("key").distinct().groupBy(_prefix(fine).alias("p")).agg(F.count("key")).toLocalIterator():
        counts[p] = n
    return Directory.built(lambda depth: counts.reshape(1 << depth, -1).sum(1), capacity, min(START_DEPTH, fine), fine)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the index is left in the shared folder."""
    spark = docs.sparkSession
    rows, folder = doc_texts(docs), new_folder(spark, "dedup")
    keyed = written(rows.mapInArrow(tidy(_keyed), "doc_id long, key long, text_sha256 string"), "keyed", folder)
    total = keyed.count()
    directory = _directory(keyed, total, capacity)
    texts = int(directory.counts.sum())
    owners = max(1, min(len(directory.counts), max(texts // capacity + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    slots = directory.owners(owners)
    runs = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])  # first slot of each owner
    spark.createDataFrame([(directory.depth, [int(x) for x in runs])], "depth int, first_slot array<long>").coalesce(1).write.parquet(f"{folder}/directory")
    ranges, depth = spark.sparkContext.broadcast(runs.astype(np.uint64)), directory.depth  # a number for each owner
    folded = rows.mapInArrow(tidy(lambda batches: _folded(ranges, depth, batches)), "owner int, key long, norm binary, keep_id long, n long, ties long")
    index = folded.repartitionById(len(runs), F.col("owner")).sortWithinPartitions("key").mapInArrow(tidy(_owned), "key long, chain int, text_sha256 string, keep_id long, group_size long, ties long")
    index = written(index, "index", folder)
    found = look_up(keyed, index, total)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if index.filter("ties > 1").isEmpty():
        return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    again = Window.partitionBy("text_sha256", "doc_id").orderBy("key")
    alike = found.filter(kept & (F.col("ties") > 1)).select("doc_id", "keep_id", "group_size", (F.row_number().over(again) == 1).alias("kept"), "text_sha256")
    return found.filter(~(kept & (F.col("ties") > 1))).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256").unionByName(alike)


def look_up(keyed: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """keyed with keep_id, group_size and ties of its text."""
    heavy = max(HEAVY, -(-total // BROADCAST_MOST))  # at most total / heavy entries have more copies: a bound for the broadcast
    on, columns = ["key", "text_sha256"], ["key", "text_sha256", "keep_id", "group_size", "ties"]
    hot = F.broadcast(index.filter(F.col("group_size") > heavy).select(columns))
    rare = index.filter(F.col("group_size") <= heavy).select(columns)
    return keyed.join(hot, on, "left_anti").join(rare, on).unionByName(keyed.join(hot, on))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
