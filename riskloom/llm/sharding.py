"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's slot is xxhash64(doc_id, text crc32) mod SLOTS, whatever the number of shards. Rows that repeat doc_id and
crc32 are numbered, and every COPIES of them hash with another salt (the first with none), so that no key fills a slot. The bytes of each slot are
aggregated (SLOTS rows at most, a constant bound), and a map from slot to shard is stored with a version in the shared
folder. The law is `bytes`: the map gives the largest slots first, each to the shard with the least bytes, and then
moves or swaps slots while that brings the fullest and the emptiest shard nearer. Rebalancing edits the stored map: it
moves as few slots as it can and writes a new version; the records' slots never change.

Size: UTF-8 bytes of the text (null: none) plus 8. `slot` is the record's place in its shard, gapless from 0: the
virtual slots of a shard follow one another, and records within a slot stand by doc_id (nulls first), size and crc32.
Repeated rows each get a place. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import doc_texts, new_folder, table, written

SLOTS, SHARDS, COPIES = 4096, 24, 16
GROUP_ROWS = 8192


def records(docs: DataFrame, slots: int, folder: str) -> DataFrame:
    """Copies of a key are numbered in groups of at most GROUP_ROWS rows, so that no task holds all of a frequent key."""
    text, key = F.coalesce("text", F.lit("")), ["doc_id", "text_crc32"]
    sized = doc_texts(docs).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sized = written(sized.withColumn("part", F.floor(F.monotonically_increasing_id() / GROUP_ROWS)), "sized", folder)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = sized.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.select(F.col("doc_id").alias("d"), F.col("text_crc32").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = sized.withColumn("k", F.row_number().over(Window.partitionBy(*key, "part").orderBy("size")) - 1)
    met = numbered.join(groups, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_crc32") == F.col("c")) & (F.col("part") == F.col("p")))
    salt = F.floor((F.col("before") + F.col("k")) / COPIES)
    slot = F.when(salt == 0, F.xxhash64(*key)).otherwise(F.xxhash64(*key, salt))
    return met.select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_totals(placed: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each virtual slot: `slots` numbers each."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for s, b, n in placed.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[s], rows[s] = b, n
    return size, rows


def assign(size: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each slot: largest first to the emptiest shard."""
    out, heap = np.zeros(len(size), np.int64), [(0, s) for s in range(shards)]
    for slot in np.argsort(-size, kind="stable").tolist():
        total, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (total + int(size[slot]), s))
    return out


def rebalance(size: np.ndarray, shard_of: np.ndarray, shards: int, tolerance: float = 0.002) -> np.ndarray:
    """Edits a map: slots move from the fullest to the emptiest shard while that lowers the spread; new shards fill so too."""
    out, totals = shard_of.copy(), np.bincount(shard_of, size, shards).astype(np.int64)
    for _ in range(4 * len(size)):
        hi, lo = int(totals.argmax()), int(totals.argmin())
        gap = int(totals[hi] - totals[lo])
        if gap <= tolerance * totals.mean():
            break
        own = np.flatnonzero((out == hi) & (size > 0) & (size < gap))
        if not len(own):
            break
        slot = own[np.abs(size[own] - gap / 2).argmin()]
        out[slot] = lo
        totals[hi] -= size[slot]
        totals[lo] += size[slot]
    return out


def store_map(spark: SparkSession, folder: str, shard_of: np.ndarray, version: int) -> DataFrame:
    """Adds a version of the map: rows (version, virtual_slot, shard)."""
    shard = F.element_at(F.lit([int(s) for s in shard_of]), (F.col("id") + 1).cast("int"))
    rows = spark.range(0, len(shard_of), 1, 1).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("virtual_slot"), shard.cast("int").alias("shard"))
    rows.write.mode("append").partitionBy("version").parquet(f"{folder}/map")
    return rows


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> np.ndarray:
    rows = spark.read.schema("version int, virtual_slot int, shard int").parquet(f"{folder}/map")
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    return np.array([s for _, s in sorted(rows.filter(F.col("version") == version).select("virtual_slot", "shard").collect())])


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot of each record; version 1 of the map is stored, edited to version 2."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    placed = written(records(docs, slots, folder), "records", folder)
    size, rows = slot_totals(placed, slots)
    shard_of = assign(size, shards)
    store_map(spark, folder, shard_of, 1)
    shard_of = rebalance(size, shard_of, shards)
    store_map(spark, folder, shard_of, 2)
    before = np.zeros(slots, np.int64)  # rows of the slots that precede a slot in its shard
    for s in range(shards):
        own = np.flatnonzero(shard_of == s)
        before[own] = np.cumsum(rows[own]) - rows[own]
    at = (F.col("virtual_slot") + 1).cast("int")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return placed.select(
        "doc_id", "size", "text_crc32", "virtual_slot",
        F.element_at(F.lit([int(x) for x in shard_of]), at).cast("int").alias("shard"),
        (F.element_at(F.lit([int(x) for x in before]), at).cast("long") + F.row_number().over(order) - 1).alias("slot"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
