"""Sum-of-squares online packing of token documents into windows.

A document's ids fill as many whole windows as they can; the rest, shorter than a window, goes online to the fill level
that minimises the sum of the squared numbers of partially filled windows over all levels (level 0: a new window). A
level array holds those numbers, and a stack for each level its open windows. When a task ends, or holds MOST_OPEN open windows, the emptier windows
are cut up to fill the fuller ones, so that one window at most stays partly filled in a task. Tasks pack their own rows:
no shuffle, and a lost task packs the same again. sequence_id holds the task's number in its upper bits.

Null text: empty (one piece, the end id alone). Null doc_id: packed like others, the pieces have none. Empty table: empty
result. A very long document fills many windows. Repeated rows are packed as often as they occur. Columns beside doc_id
and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.bpe import Encoder, encoder, forget, text_slices, vocabulary_path
from riskloom.llm.common import doc_texts, record, table, tidy

WINDOW, MOST_OPEN = 2048, 4096
TASK_BITS = 36

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Pieces (doc_id, start, ids, doc_tokens) to rows; a row is a piece at its place in a sequence."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, first: int = 0):
        self.window, self.most_open, self.next = window, most_open, first
        self.levels = np.zeros(window + 1, np.int64)  # partially filled windows by fill; [0] and [window] stay 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []
        self.closed = [0, 0]  # windows of several pieces closed by the choice of a level, and by cutting up open ones

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self._close([(doc_id, at, ids[4 * at : 4 * (at + w)], n)])
        if n > whole:
            self._place((doc_id, whole, ids[4 * whole :], n), n - whole)

    def _place(self, piece: tuple, size: int) -> None:
        """Adding to level h changes the sum of squares by 2 (N[h + size] - N[h]) + 2, by 1 - 2 N[h] where it closes the
        window, and a new window by 2 N[size] + 1. Of equal changes the fullest level wins, so that open windows are few."""
        w, levels = self.window, self.levels
        fits = w - size  # the level that is closed exactly; fuller ones have no room
        change = np.full(fits + 1, 4 * w * w)
        change[:fits] = 2 * (levels[size:w] - levels[:fits]) + 2
        change[fits] = 1 - 2 * levels[fits]
        change[levels[: fits + 1] == 0] = 4 * w * w
        to = fits - int(change[::-1].argmin())
        if change[to] > 2 * levels[size] + 1:
            to = 0
        window = self._take(to) if to else []
        window.append(piece)
        if to + size == w:
            self._close(window)
            return
        self.levels[to + size] += 1
        self.open[to + size].append(window)
        self.n_open += 1
        if self.n_open >= self.most_open:
            self.compact()

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _close(self, window: list, cut: bool = False) -> None:
        at = 0
        self.closed[cut] += len(window) > 1
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at, ids))
            at += len(ids) // 4
        self.next += 1

    def compact(self) -> None:
        """Fills the fullest windows with cuts of the emptiest; one open window at most remains."""
        by_fill = [(h, x) for h in range(1, self.window) for x in self.open[h]]
        self.levels[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        lo, hi, spare = 0, len(by_fill) - 1, []
        while hi >= lo:
            fill, target = by_fill[hi]
            hi -= 1
            while fill < self.window and (spare or lo <= hi):
                if not spare:
                    spare = by_fill[lo][1][::-1]
                    lo += 1
                doc_id, start, ids, total = spare.pop()
                room = self.window - fill
                if len(ids) // 4 > room:
                    spare.append((doc_id, start + room, ids[4 * room :], total))
                    ids = ids[: 4 * room]
                target.append((doc_id, start, ids, total))
                fill += len(ids) // 4
            if fill == self.window:
                self._close(target, True)
            else:
                self.levels[fill] += 1
                self.open[fill].append(target)
                self.n_open += 1
            if spare and lo > hi:  # what is left of the last one cut
                rest = sum(len(p[2]) // 4 for p in spare)
                by_fill.append((rest, spare[::-1]))
                spare, lo = [], len(by_fill) - 1
                hi = lo

    def finish(self) -> None:
        self.compact()
        for h in range(self.window):
            while self.open[h]:
                self._close(self._take(h), True)


def packed(batches: Iterator[pa.RecordBatch], encode: Callable[[], Encoder], end_id: int, window: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder_, end = encode(), np.array([end_id], "<u4").tobytes()
    packer = Packer(window, first=TaskContext.get().partitionId() << TASK_BITS)

    def out() -> Iterator[pa.RecordBatch]:
        rows, packer.rows = packer.rows, []
        columns = [list(c) for c in zip(*rows, strict=True)]
        if not keep_ids:
            columns[-1] = [None] * len(rows)
        yield record(_PIECE, *columns)

    for batch in batches:
        for rows, texts in text_slices(batch):
            ids, counts = encoder_.ids(texts)
            data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for doc_id, a, b in zip(rows.column("doc_id").to_pylist(), [0, *ends], ends, strict=False):
                packer.add(doc_id, data[a:b] + end)
                if len(packer.rows) >= 4000:
                    yield from out()
    packer.finish()
    if packer.rows:
        yield from out()


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit numbers unless keep_ids is False."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(batches, lambda: encoder(path), end_id, window, keep_ids)
        forget(path)  # idle workers would each hold one

    return doc_texts(docs).mapInArrow(tidy(run), PIECE)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
