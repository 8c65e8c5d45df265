"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Format, a folder of Parquet tables in shared storage: `codebook` (id, bits: the code length of each id; codes are
canonical, that is, given in order of length, then id) and `blocks`, one row for each block of whole documents in
ascending doc_id order, named by its part and the place of its first document there: doc_ids, n_tokens (ids of each
document, with its end id), start_bits (bit offset of each document in the payload), lane_bits (bit offsets of every
LANE-th id: checkpoints from which lanes decode side by side), n_ids, payload and its crc32. A block needs nothing from
other blocks, so any can be read alone.

Null text: empty (the end id alone). Null doc_id sorts first. Rows that share a doc_id, or have none, go by the hash of
their text, over several tasks if they are many; repeated rows are written as often as they occur. Empty table: no
blocks, an empty result. A document longer than a block is a block by itself. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.bpe import encoder, text_slices, vocabulary_path
from riskloom.llm.common import doc_texts, new_folder, record, table, tidy, written

MOST_BITS, LANE, BLOCK_IDS, STEP = 20, 128, 1 << 19, 1 << 14

_IDS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])
_ENCODED = _IDS.append(pa.field("counts", pa.binary()))
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("start_bits", pa.list_(pa.int64())), ("lane_bits", pa.binary()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("payload_crc32", pa.int64())])
BLOCK = "part int, block long, doc_ids array<long>, n_tokens array<long>, start_bits array<long>, lane_bits binary, n_ids long, payload binary, payload_crc32 long"


def limited_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need more than {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):  # each level: the single ids merged with the pairs of the level below
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for single in reversed(levels):
        n = int(single[:take].sum())
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as numbers of lengths[id] bits: in order of length, then id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after another, high bit first, and the bit offset of each id (one more at the end)."""
    starts = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths[ids], out=starts[1:])
    total = int(starts[-1])
    words = np.zeros(total // 64 + 3, np.uint64)
    tops = codes << (64 - lengths).astype(np.uint64)  # at the top of 64 bits
    for a in range(0, len(ids), STEP):  # arrays that stay in the processor's cache
        at, left = starts[a : a + STEP + 1], tops[ids[a : a + STEP]]
        at, ends = at[:-1], at[1:]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[edge]] |= np.bitwise_or.reduceat(left >> shift, edge)  # bits of different codes never overlap
        over = np.flatnonzero((ends - 1) >> 6 != word)  # one code at most goes on in the next word
        words[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
    return words.astype(">u8").tobytes()[: (total + 7) // 8], starts


class Decoder:
    """Table-driven: the next bits, as many as the longest code has, index the table of ids and code lengths."""

    def __init__(self, lengths: np.ndarray, most: int = MOST_BITS):
        self.most = min(most, max(1, int(lengths.max(initial=1))))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        kind = np.uint32 if len(lengths) <= 1 << 27 else np.uint64
        self.table = np.ones(1 << self.most, kind)  # the id, and 5 bits for the length of its code
        filled = np.repeat((order.astype(kind) << kind(5)) | lengths[order].astype(kind), 1 << (self.most - lengths[order]))
        self.table[: len(filled)] = filled

    def decode(self, payload: bytes, lane_bits: np.ndarray, n_ids: int, lane: int = LANE) -> np.ndarray:
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        data = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]  # 32 bits from each byte on
        at, lanes = lane_bits.astype(np.int64), len(lane_bits)
        out = np.zeros((lane, lanes), self.table.dtype)
        down, mask = np.int64(32 - self.most), np.int64((1 << self.most) - 1)
        last = n_ids - (lanes - 1) * lane if lanes else 0
        for k in range(lane if lanes > 1 else last):
            a = at if k < last else at[:-1]
            out[k, : len(a)] = found = self.table[(data[a >> 3] >> (down - (a & 7))) & mask]
            a += found & 31
        return (out >> 5).T.astype(np.uint32).reshape(-1)[:n_ids]


def _encoded(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of 16 bits where the vocabulary allows, of documents in order; `place` counts them in the task. A last row
    without a place holds how often each id occurs in the task."""
    encode, place, part = encoder(path), 0, TaskContext.get().partitionId() << 40
    total = np.zeros(0, np.int64)
    for batch in batches:
        for rows, texts in text_slices(batch):
            found, counts = encode.ids(texts)
            ids = np.insert(found, np.cumsum(counts), end_id)
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
            narrow = len(n) <= 1 << 16
            data, width, mark = ids.astype("<u2" if narrow else "<u4").tobytes(), 2 if narrow else 4, b"\x02" if narrow else b"\x04"
            ends, n = (width * np.cumsum(counts + 1)).tolist(), len(counts)
            yield record(_ENCODED, rows.column("doc_id"), np.arange(part + place, part + place + n), [mark + data[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.nulls(n, pa.binary()))
            place += n
    if place:
        yield record(_ENCODED, [None], [None], [None], [total.astype("<i8").tobytes()])


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            total = np.frombuffer(counts, "<i8")
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _blocks(codebook, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block is a run of places without a gap, named by its first one: a part may be read by several tasks, a task may
    read pieces of several parts in any order."""
    lengths = codebook.value
    codes = canonical(lengths)
    held, size, begin, after = [], 0, 0, None

    def block() -> pa.RecordBatch:
        part, number = begin >> 40, begin & (1 << 40) - 1
        ids = np.concatenate([x for _, x in held])
        payload, starts = pack_bits(ids, codes, lengths)
        n = np.fromiter((len(x) for _, x in held), np.int64, len(held))
        first = np.cumsum(n) - n
        return record(_BLOCK, [part], [number], [[d for d, _ in held]], [n.tolist()], [starts[first].tolist()], [starts[: len(ids) : LANE].astype("<i8").tobytes()], [len(ids)], [payload], [zlib.crc32(payload)])

    for batch in batches:
        for doc_id, place, data in zip(*(batch.column(c).to_pylist() for c in _IDS.names), strict=True):
            ids = _ids(data)
            if held and (size + len(ids) > BLOCK_IDS or place != after):
                yield block()
                held, size = [], 0
            if not held:
                begin = place
            after = place + 1
            held.append((doc_id, ids))
            size += len(ids)
    if held:
        yield block()


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, folder: str | None = None) -> str:
    """Writes the files and returns their folder.

    Documents are dealt by ranges of doc_id, encoded and counted once, and kept as plain ids until the counts of all are
    known. The later pass reads those in their order, so no further shuffle is needed. Rows that repeat doc_id and text stand in for
    each other, so their place in the input parts them into as many ranges as they need.
    """
    spark = docs.sparkSession
    folder, path = folder or new_folder(spark, "tokens"), vocabulary or vocabulary_path()
    rows = doc_texts(docs).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").drop("tie", "row")
    ids = written(ranged.mapInArrow(tidy(lambda batches: _encoded(path, end_id, batches)), "doc_id long, place long, ids binary, counts binary"), "ids", folder, compression="zstd")
    counts = np.zeros(1, np.int64)
    for i, n in ids.filter("place IS NULL").select("counts").mapInArrow(tidy(_counted), "id long, n long").groupBy("id").agg(F.sum("n")).toLocalIterator():  # one row an id of the vocabulary
        if i >= len(counts):
            counts = np.concatenate([counts, np.zeros(i + 1 - len(counts), np.int64)])
        counts[i] = n
    lengths = limited_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    codebook = spark.sparkContext.broadcast(lengths)
    blocks = ids.filter("place IS NOT NULL").select(*_IDS.names).mapInArrow(tidy(lambda batches: _blocks(codebook, batches)), BLOCK)
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_codebook(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("id int, bits int").parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((i for i, _ in rows), default=0) + 1, np.int64)
    for i, b in rows:
        lengths[i] = b
    return lengths


_READ = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
READ = "part int, block long, at long, doc_id long, n_tokens long, ids_crc32 long, ids binary"


def _read(codebook, keep_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(codebook.value)
    for batch in batches:
        for row in range(batch.num_rows):
            part, block, doc_ids, n_tokens, _, lanes, n, payload, crc = (batch.column(c)[row].as_py() for c in _BLOCK.names)
            if zlib.crc32(payload) != crc:
                raise ValueError(f"part {part}, block {block}: damaged payload")
            data = decoder.decode(payload, np.frombuffer(lanes, "<i8"), n).astype("<u4").tobytes()
            ends = np.cumsum(n_tokens)
            pieces = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n_tokens, strict=True)]
            m = len(doc_ids)
            yield record(_READ, [part] * m, [block] * m, (ends - n_tokens).tolist(), doc_ids, n_tokens, [zlib.crc32(x) for x in pieces], pieces if keep_ids else [None] * m)


def read_tokens(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, ids."""
    codebook = spark.sparkContext.broadcast(read_codebook(spark, folder))
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    decoded = blocks.mapInArrow(tidy(lambda batches: _read(codebook, keep_ids, batches)), READ)
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sorted((p, n) for p, n in parts.toLocalIterator())  # one number for each written part
    starts, total = {}, 0
    for p, n in before:
        starts[p] = total
        total += n
    of_part = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part int, part_start long")
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(F.broadcast(of_part), "part")
    return decoded.join(placed.drop("n_ids"), ["part", "block"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents")), keep_ids=False).drop("ids")
