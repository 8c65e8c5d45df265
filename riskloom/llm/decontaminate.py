"""Benchmark decontamination: normalised item n-grams in a broadcast hash set, token windows scanned and verified.

A-Z are lower-cased; words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, that is, runs of digits, a-z and all non-ASCII
characters. A window is 10 consecutive words of an item; an item of fewer, but not none, is one window. A document word
inside any occurrence of a window is hit. Null and empty texts have no words; null items are no windows. Repeated rows
of documents give a row each; repeated items count as one item for each distinct item_id; an item whose item_id is null
marks words, but is no item to list; null doc_ids give rows without one. Very long texts are read whole. Empty tables:
nothing is hit. Other columns, whatever their names, are not read.

The hash set is broadcast in blocks of at most BLOCK_BYTES of item text: the scan of the documents is one pass for each
block, written before the next block is read. A scan first marks the words that occur in the block at all; only runs of
such words as long as the shortest window are hashed and compared with the windows' own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import doc_texts, new_folder, table, texts_of, tidy, written

WINDOW = 10
BLOCK_BYTES = 16 << 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Windows:
    """Of a block of items: the windows by their hash, each with its words and its items; the words that occur."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int = WINDOW):
        self.of: dict[int, dict[tuple[bytes, ...], set]] = {}
        for item_id, text in items:
            w = words(text)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                gram = tuple(w[i : i + n])
                self.of.setdefault(hash(gram), {}).setdefault(gram, set()).add(item_id)
        grams = [g for same in self.of.values() for g in same]
        self.words = {x for g in grams for x in g}
        self.sizes = sorted({len(g) for g in grams})

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of hit words, and the items."""
        spans, items = [], set()
        if not self.sizes:
            return spans, items
        known = bytes(map(self.words.__contains__, w))
        shortest = b"\x01" * self.sizes[0]
        at = known.find(shortest)
        while at >= 0:
            end = known.find(b"\x00", at)
            end = len(w) if end < 0 else end
            for i in range(at, end):
                for n in self.sizes:
                    if i + n > end:
                        break
                    gram = tuple(w[i : i + n])
                    same = self.of.get(hash(gram))
                    if same and gram in same:  # equal words, not just an equal hash
                        items |= same[gram]
                        if spans and spans[-1][1] >= i:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], i + n))
                        else:
                            spans.append((i, i + n))
            at = known.find(shortest, end)
        return spans, items


_SCANNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
SCANNED = "doc_id long, row long, n_words long, spans array<long>, items array<long>"


def _scan(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows = Windows(block.value)
    for batch in batches:
        n, spans, items = [], [], []
        for text in texts_of(batch):
            w = words(text)
            s, i = windows.hits(w)
            n.append(len(w))
            spans.append([x for pair in s for x in pair])
            items.append(sorted(x for x in i if x is not None))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], schema=_SCANNED)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, streamed through the driver one by one."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        data = text.encode()
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append((item_id, data))
        size += len(data)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (start and end word of each hit span in turn) and items of every document."""
    spark = docs.sparkSession
    rows, blocks = doc_texts(docs).withColumn("row", F.lit(0).cast("long")), _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _passed(rows, first)[0].drop("row")
    # rows need an identity where several passes meet; each pass is written before the next block is read
    folder = new_folder(spark, "decontaminate")
    rows, parts = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows", folder), []
    for k, block in enumerate(chain((first, second), blocks)):
        passed, held = _passed(rows, block)
        parts.append(written(passed if not k else passed.filter(F.size("spans") > 0), f"pass-{k}", folder))
        held.destroy()
    met = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return met.drop("row")


def _passed(rows: DataFrame, block: list) -> tuple[DataFrame, Broadcast]:
    held = rows.sparkSession.sparkContext.broadcast(block)
    return rows.mapInArrow(tidy(lambda batches: _scan(held, batches)), SCANNED), held


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, n_items, sha = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            covered = end = 0
            for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                covered += max(0, b - max(a, end))
                end = max(end, b)
            hit.append(covered)
            n_items.append(len(items))
            sha.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])], schema=_DIGEST)


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return scan(docs, benchmark, block_bytes).mapInArrow(tidy(_digest), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _span_remover(windows: Windows):
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def cleaned(text: bytes) -> bytes:
        places = [m.span() for m in word.finditer(text)]
        out, at = [], 0
        for a, b in windows.hits([text[s:e].translate(_WORD) for s, e in places])[0]:
            out.append(text[at : places[a][0]])
            at = places[b - 1][1]
        return b"".join([*out, text[at:]])

    return cleaned


def remove_spans(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, each text without its hit spans (from the first hit word's first byte to the last one's last); null stays null."""
    fields = [(f.name, f.dataType) for f in docs.schema]
    out = docs
    for block in _blocks(benchmark, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, held=held):
            remove = _span_remover(Windows(held.value))
            for batch in batches:
                k = batch.schema.get_field_index("text")
                texts = [None if x is None else remove(x) for x in batch.column(k).cast(pa.binary()).to_pylist()]
                yield batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.binary()).cast(batch.schema.field(k).type))

        out = out.mapInArrow(tidy(clean), docs.schema)
    return out.select([n for n, _ in fields])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
