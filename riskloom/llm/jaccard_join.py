"""Exact n-gram Jaccard self-join: index lists with block skipping, answers derived from similar sets' answers.

A document's set: the distinct 5-word shingles of the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; with
fewer words the whole sequence is one; without words the set is empty and linked with nothing. Shingles are 64-bit
hashes. Two documents link when 100 * |intersection| >= 80 * |union|. No link between different sets is lost:

1. One scan writes each document's set size, a digest of its set, and a parity bitmap of at most MOST_BITS bits;
   documents with the same digest have the same answers, so from here on a set stands for all of them. Shingles that
   repeat within tasks are counted; the most frequent go last in the global order of shingles (this order moves work,
   never results).
2. A second scan sends each set's prefix postings to their shingle's owner. Lists with at least two sets of matching
   size are kept; lists of more than HOT_LIST sets are dealt by overlapping size classes.
3. A list is read in order of size: blocks outside a set's size window, and blocks whose sets have too few shingles left
   at their position, are skipped as a whole; then pairs by position (a pair too late in both sets is found in another
   list) and by bitmap (the parities' distance is at most the sets' symmetric difference). The pairs that pass make
   groups (their connected parts in the list); a set is sent on once for each group, to the group's set with the
   smallest number, the pivot. So a list of m sets sends m - 1 rows at most, however many pairs pass.
4. A group's texts meet at the pivot, whose overlaps with all members (its answers) are read from the group's index
   lists; each member's answers are derived from the pivot's by reading only the lists of the shingles in which the two
   differ. Links leave as a spanning forest, never as pairs.
5. Groups too large for one task meet in salted portions. Afterwards the members that aren't yet connected with their
   pivot are, in blocks, asked against the whole group; two members that are both connected with it need no question.

Null text: empty. Very long texts are read whole. Repeated rows: same set, same component. Null doc_id: the row's
component is that of its set without it. Ties have no influence: components don't depend on the pivots chosen. Empty
table: empty result. Other columns, whatever their names, are not read. A digest names a set by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import doc_texts, mixed, new_folder, record, slices, table, tidy, written
from riskloom.llm.components import Forest, components
from riskloom.llm.words import Words

SHINGLE, FREQUENT, BLOCK, SEEN, MOST_BITS = 5, 100_000, 1024, 300_000, 4096
PORTION, PORTION_SHINGLES = 500, 1 << 20
SHORT_LIST, HOT_LIST, CHUNK = 24, 20_000, 1 << 16
BROADCAST_ROWS = 300_000
HEAVY, HEAVY_MOST = 500, 50_000


def needed(a, b):
    """The least intersection of linked sets of sizes a and b: 180 i >= 80 (a + b)."""
    return -(-4 * (a + b) // 9)


def digest(tokens: np.ndarray) -> int:
    """Of a set of sorted distinct hashes."""
    with np.errstate(over="ignore"):
        x = mixed(np.array([mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))
    return int(x.view(np.int64)[0])


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the hashes in each of 2**k buckets: at least as many as the set's size and 64, at most MOST_BITS."""
    bits = min(MOST_BITS, max(64, 1 << max(0, len(tokens) - 1).bit_length()))
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").tobytes()


_SET = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.int64()), ("bitmap", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: documents' sets; kind 1: shingles (in digest) that n different sets of the task share."""
    seen, held, size = set(), [], 0

    def frequent() -> Iterator[pa.RecordBatch]:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        tokens, n = tokens[n > 1].view(np.int64), n[n > 1]
        if len(n):
            yield record(_SET, np.ones(len(n), np.int32), pa.nulls(len(n), pa.int64()), n, tokens, pa.nulls(len(n), pa.binary()))

    for batch, texts in slices(batches):
        sets = Words(texts).shingles(SHINGLE)
        digests = [digest(s) for s in sets]
        yield record(_SET, np.zeros(len(sets), np.int32), batch.column("doc_id"), [len(s) for s in sets], digests, [bitmap(s) if len(s) else None for s in sets])
        for d, s in zip(digests, sets, strict=True):
            if d not in seen and len(s):
                seen.add(d)
                held.append(s)
                size += len(s)
        if size > 4_000_000:
            yield from frequent()
            held, size = [], 0
        if len(seen) > SEEN:
            seen.clear()
    if held:
        yield from frequent()


_POSTING = pa.schema([("token", pa.int64()), ("digest", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])


def _postings(frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common, rank = frequent.value
    seen: set[int] = set()
    for _, texts in slices(batches):
        out = []
        for s in Words(texts).shingles(SHINGLE):
            if not len(s) or (d := digest(s)) in seen:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(d)
            n = len(s)
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                later = np.where(common[at] == s, rank[at], 0)
                s = s[np.argsort(later, kind="stable")] if later.any() else s
            prefix = s[: n - (4 * n + 4) // 5 + 1]  # a linked partner shares one of these: |intersection| >= 0.8 n
            out.append((prefix, d, n))
        if out:
            counts = [len(p) for p, _, _ in out]
            yield record(
                _POSTING, np.concatenate([p for p, _, _ in out]).view(np.int64), np.repeat(np.array([d for _, d, _ in out], np.int64), counts),
                np.repeat(np.array([n for _, _, n in out], np.int32), counts), np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows sorted by (token, size, digest) that have another set of matching size next to them in their list."""
    before, rest = None, []
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in _POSTING.names]
        rest = [np.concatenate([a, b]) for a, b in zip(rest, now, strict=True)] if rest else now
        t, d, s, _ = rest
        new = np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])]
        rest = [c[new] for c in rest]
        yield from _near(rest, before)
        before, rest = (rest[0][-2:-1], rest[2][-2:-1]) if len(rest[0]) > 1 else before, [c[-1:] for c in rest]
    if rest:
        yield from _near([*rest], before, last=True)


def _near(rows: list[np.ndarray], before, last: bool = False) -> Iterator[pa.RecordBatch]:
    """All rows but the last, which waits for its neighbour (unless it is the last of all)."""
    t, _, s, _ = rows
    near = (t[1:] == t[:-1]) & (5 * s[:-1].astype(np.int64) >= 4 * s[1:])
    first = before is not None and len(before[0]) and len(t) and before[0][0] == t[0] and 5 * int(before[1][0]) >= 4 * int(s[0])
    keep = np.r_[first, near] | np.r_[near, False]
    if not last:
        keep[-1] = False
    if keep.any():
        yield record(_POSTING, *(c[keep] for c in rows))


class Rows:
    """Postings in arrays with their bitmaps as matrices, one for each width."""

    def __init__(self, digests: np.ndarray, sizes: np.ndarray, positions: np.ndarray, maps: pa.Array):
        self.d, self.s = digests, sizes.astype(np.int64)
        self.room = self.s - positions  # shingles from the posting's on
        self.number = mixed(digests.view(np.uint64))
        _, offsets, data = maps.buffers()
        at = np.frombuffer(offsets, np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        self.width = np.diff(at) // 8
        self.place = np.zeros(len(maps), np.int64)
        self.maps: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.maps[w] = data[at[own][:, None] + np.arange(8 * w)].view(np.uint64)

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows can be linked at this place of their sets; rows i are at most as large as rows j."""
        si, sj = self.s[i], self.s[j]
        need = needed(si, sj)
        ok = np.flatnonzero((5 * si >= 4 * sj) & (np.minimum(self.room[i], self.room[j]) >= need))
        if not len(ok):
            return ok
        i, j, most = i[ok], j[ok], (si + sj - 2 * need)[ok]
        good = np.zeros(len(ok), bool)
        wi, wj = self.width[i], self.width[j]
        for a, b in np.unique(np.stack([wi, wj], 1), axis=0).tolist():
            pairs = np.flatnonzero((wi == a) & (wj == b))
            step = max(1, (1 << 20) // b)
            for at in range(0, len(pairs), step):
                m = pairs[at : at + step]
                right = self.maps[b][self.place[j[m]]]
                if a < b:  # a bitmap is folded to fewer buckets by exclusive or
                    right = np.bitwise_xor.reduce(right.reshape(len(m), b // a, a), axis=1)
                good[m] = np.bitwise_count(self.maps[a][self.place[i[m]]] ^ right).sum(1) <= most[m]
        return ok[good]


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n nodes with edges (i, j), the smallest node of each one's connected part."""
    part = np.arange(n)
    while True:
        least = np.minimum(part[i], part[j])
        new = part.copy()
        np.minimum.at(new, part[i], least)
        np.minimum.at(new, part[j], least)
        new = new[new]
        if (new == part).all():
            return part
        part = new


def _short_lists(rows: Rows, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that pass, of all lists of at most SHORT_LIST rows side by side."""
    left, right = [], []
    for k in range(1, SHORT_LIST):
        i = np.flatnonzero(token[k:] == token[:-k])
        if not len(i):
            break
        ok = rows.passing(i, i + k)
        left.append(i[ok])
        right.append(i[ok] + k)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _long_list(rows: Rows, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that pass in the list of rows begin to end: a row is only asked against rows that
    no part has reached yet, block by block in order of size."""
    left, right = [], []
    open_ = np.arange(begin, end)
    while len(open_):
        seed = int(open_[rows.number[open_].argmin()])
        open_, reached = open_[open_ != seed], [seed]
        while reached and len(open_):
            x = reached.pop()
            size, room, found = int(rows.s[x]), int(rows.room[x]), []
            sizes = rows.s[open_]
            low, high = np.searchsorted(5 * sizes, 4 * size, "left"), np.searchsorted(4 * sizes, 5 * size, "right")
            for at in range(int(low), int(high), BLOCK):
                y = open_[at : min(at + BLOCK, int(high))]
                if min(room, int(rows.room[y].max())) < needed(int(rows.s[y[0]]), size):  # too late in the sets of the whole block
                    continue
                own = np.full(len(y), x)
                small = rows.s[y] <= size
                found.append(y[small][rows.passing(y[small], own[small])])
                found.append(y[~small][rows.passing(own[~small], y[~small])])
            new = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(new):
                left.append(np.full(len(new), x))
                right.append(new)
                open_ = open_[~np.isin(open_, new)]
                reached.extend(new.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_GROUP = pa.schema([("member", pa.int64()), ("pivot", pa.int64()), ("size", pa.int32())])


def _grouped(rows: Rows, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, pivots and members' sizes of whole lists."""
    edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
    length = np.diff(edge)
    long = np.flatnonzero(length > SHORT_LIST)
    found = []
    if len(long) < len(length):
        short = np.repeat(length <= SHORT_LIST, length)
        own = np.where(short, np.cumsum(np.r_[True, token[1:] != token[:-1]]), -np.arange(1, len(token) + 1))  # rows of long lists stay alone
        found.append(_short_lists(rows, own))
    found += [_long_list(rows, int(edge[k]), int(edge[k + 1])) for k in long.tolist()]
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    part = _parts(len(token), i, j)
    order = np.lexsort((rows.number, part))
    first = np.r_[True, part[order][1:] != part[order][:-1]]
    pivot = np.empty(len(token), np.int64)
    pivot[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    member = np.flatnonzero(pivot != np.arange(len(token)))
    return rows.d[member], rows.d[pivot[member]], rows.s[member]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, part, size, digest: each list's groups, whole lists at a time."""
    names, held, n = ["token", "part", "digest", "size", "pos", "bitmap"], [], 0

    def taken(data: pa.Table) -> pa.RecordBatch | None:
        token = mixed(data["token"].to_numpy().view(np.uint64)) + data["part"].to_numpy().astype(np.uint64)
        maps = data["bitmap"].combine_chunks()
        rows = Rows(*(data[c].to_numpy() for c in ("digest", "size", "pos")), maps.chunk(0) if isinstance(maps, pa.ChunkedArray) else maps)
        member, pivot, size = _grouped(rows, token)
        if not len(member):
            return None
        _, one = np.unique(np.stack([member, pivot], 1), axis=0, return_index=True)
        return record(_GROUP, member[one], pivot[one], size[one].astype(np.int32))

    for batch in batches:
        held.append(batch.select(names))
        n += batch.num_rows
        if n < CHUNK:
            continue
        data = pa.Table.from_batches(held)
        token, part = data["token"].to_numpy(), data["part"].to_numpy()
        cut = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1]))
        if not len(cut):
            continue
        at = int(cut[-1]) + 1
        if (out := taken(data.slice(0, at))) is not None:
            yield out
        held = data.slice(at).combine_chunks().to_batches()
        n = data.num_rows - at
    if n and (out := taken(pa.Table.from_batches(held))) is not None:
        yield out


class Answers:
    """Index lists of a group's sets; the overlaps of any set with all of them, derived from the pivot's."""

    def __init__(self, pivot: np.ndarray, sets: list[np.ndarray]):
        self.pivot, self.n = pivot, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        all_ = np.concatenate(sets)
        order = np.argsort(all_, kind="stable")
        self.tokens, self.begin, self.count = np.unique(all_[order], return_index=True, return_counts=True)
        self.member = np.repeat(np.arange(self.n), self.sizes)[order]
        self.of_pivot = self._read(pivot)

    def _read(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set of the index has."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        n = self.count[at]
        place = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.member[place], minlength=self.n)

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """The sets of the index that a set is linked with (itself, if it is one of them)."""
        own = np.isin(tokens, self.pivot, assume_unique=True)
        kept = int(own.sum())
        if len(tokens) - kept + len(self.pivot) - kept < len(tokens):
            gone = self.pivot[~np.isin(self.pivot, tokens, assume_unique=True)]
            overlap = self.of_pivot + self._read(tokens[~own]) - self._read(gone)
        else:  # too unlike the pivot: its own lists are fewer
            overlap = self._read(tokens)
        return np.flatnonzero(overlap >= needed(self.sizes, len(tokens)))


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
PIVOT, INDEXED, ASKING = 0, 1, 2


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot, salt and role: the pivot's text, those to be indexed, those that only ask. A spanning forest
    of the links among the first two, and of those that ask with them."""
    group, pivot, ids, sets, forest, answers = None, None, [], [], Forest(), None
    out: list[tuple[int, int]] = []

    def index() -> None:
        """The sets held become the index and ask each other."""
        nonlocal answers
        if len(sets) == 2:
            a, b = sets
            if len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b)):
                forest.join(ids[0], ids[1])
            return
        answers = Answers(pivot, sets)
        for x, s in zip(ids, sets, strict=True):
            ask(x, s)

    def ask(x: int, tokens: np.ndarray) -> None:
        for k in answers.linked(tokens).tolist():
            if ids[k] != x:
                forest.join(x, ids[k])

    def end() -> None:
        if answers is None and len(sets) > 1:
            index()
        out.extend((x, r) for x in forest.up if (r := forest.root(x)) != x)

    for batch, texts in slices(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("pivot", "salt", "role", "member")), Words(texts).shingles(SHINGLE), strict=True)
        for p, salt, role, member, tokens in rows:
            if group != (p, salt):
                end()
                if role != PIVOT:
                    raise ValueError("a pivot's text is missing")
                group, pivot, ids, sets, forest, answers = (p, salt), tokens, [p], [tokens], Forest(), None
            elif role == INDEXED:
                ids.append(member)
                sets.append(tokens)
            else:
                if answers is None:
                    if len(sets) == 2:  # two sets settle without an index, but others ask
                        answers = Answers(pivot, sets)
                        for x, s in zip(ids, sets, strict=True):
                            ask(x, s)
                    else:
                        index()
                ask(member, tokens)
        if len(out) > 5000:
            yield record(_EDGE, *zip(*out, strict=True))
            out.clear()
    end()
    if out:
        yield record(_EDGE, *zip(*out, strict=True))


def _met(asked: DataFrame, pivots: DataFrame, texts: DataFrame) -> DataFrame:
    """asked: pivot, salt, role, member; pivots: pivot, salt. Edges u, v among the sets of each (pivot, salt)."""
    texts = texts.withColumnRenamed("digest", "member")
    own = pivots.select("pivot", "salt", F.lit(PIVOT).alias("role"), F.col("pivot").alias("member"))
    rows = asked.select("pivot", "salt", "role", "member").unionByName(own).join(texts, "member")
    met = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "member")
    return met.mapInArrow(tidy(_resolved), "u long, v long")


def _texts(wanted: DataFrame, sets: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """digest, text of the wanted sets: each set's text is that of its smallest doc_id."""
    reps = written(sets.join(wanted, "digest", "left_semi").select("digest", "row"), "reps", folder)
    reps = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
    return written(docs.join(reps, "row").select("digest", "text"), "texts", folder, compression="zstd")


def _portions() -> Column:
    """Of c members with s shingles."""
    return F.greatest(F.ceil(F.col("c") / PORTION), F.ceil(F.col("s") / PORTION_SHINGLES)).cast("int")


def _links(groups: DataFrame, sets: DataFrame, docs: DataFrame, folder: str) -> DataFrame | None:
    """groups: member, pivot, size. label of each linked set (node), or None where there is no group."""
    sums = groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    salts = written(sums.select("pivot", _portions().alias("salts")), "salts", folder)
    if salts.isEmpty():
        return None
    wanted = groups.select(F.col("member").alias("digest")).unionByName(salts.select(F.col("pivot").alias("digest"))).distinct()
    texts = _texts(wanted, sets, docs, folder)
    large = F.broadcast(salts.filter("salts > 1"))  # fewer than sets / PORTION, or shingles / PORTION_SHINGLES
    salted = groups.join(large, "pivot", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    asked = salted.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int")).withColumn("role", F.lit(INDEXED))
    each = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    edges = written(_met(asked, each, texts), "edges-1", folder)
    labels = written(components(edges, f"{folder}/first"), "labels-1", folder)
    if salts.filter("salts > 1").isEmpty():
        return labels
    # in the large groups, members not connected with their pivot are asked against all members
    hot = groups.join(large, "pivot").select("pivot", "member", "size")
    of_member, of_pivot = labels.select(F.col("node").alias("member"), "label"), labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    marked = hot.join(of_member, "member", "left").join(F.broadcast(large.select("pivot").join(of_pivot, "pivot", "left")), "pivot")
    marked = written(marked.withColumn("minor", ~F.coalesce("label", "member").eqNullSafe(F.coalesce("pivot_label", "pivot"))).select("pivot", "member", "size", "minor"), "marked", folder)
    minors = marked.filter("minor").groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    blocks = written(minors.select("pivot", _portions().alias("salts")), "blocks", folder)
    if blocks.isEmpty():
        return labels
    own = marked.join(F.broadcast(blocks), "pivot")
    block = F.pmod(F.xxhash64("member"), F.col("salts")).cast("int")
    indexed = own.filter("minor").select("pivot", block.alias("salt"), F.lit(INDEXED).alias("role"), "member")
    asking = own.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "member", (F.col("minor") & (block == F.col("salt"))).alias("there"), F.lit(ASKING).alias("role")).filter("not there")
    each = blocks.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    more = written(_met(indexed.unionByName(asking.drop("there")), each, texts), "edges-2", folder)
    return written(components(labels.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more), f"{folder}/second"), "labels-2", folder)


def _rows(docs: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """Rows with a key for joins back to their texts: doc_id where it is unique (True), else they are written with one."""
    rows = doc_texts(docs)
    n, distinct = rows.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if n == distinct:
        return rows.withColumn("row", F.col("doc_id")), True
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "rows", folder, compression="zstd"), False


def _dealt(shared: DataFrame, maps: DataFrame, folder: str) -> DataFrame:
    """Postings with bitmaps, each list in one task; a list of more than HOT_LIST sets goes by size classes, of which each
    also gets the sets of the class below, as linked sets differ by one class at most."""
    n = shared.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_LIST).select("token", F.lit(True).alias("hot"))
    hot = F.broadcast(written(n, "hot", folder))  # fewer than postings / HOT_LIST
    size_class = F.floor(F.log(F.col("size")) / F.log(F.lit(1.26))).cast("int")
    parts = F.when(F.col("hot"), F.array(size_class, size_class + 1)).otherwise(F.array(F.lit(0)))
    listed = shared.join(hot, "token", "left").withColumn("part", F.explode(parts)).drop("hot").join(maps, "digest")
    return listed.repartition("token", "part").sortWithinPartitions("token", "part", "size", "digest")


def _least(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """digest, copies, component_id of every set."""
    if labels is None:
        return sets.select("digest", "copies", F.col("least").alias("component_id"))
    named = sets.select("digest", "copies", "least").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c"))
    hot = F.broadcast(least.filter(F.col("c") > HEAVY).select("label", F.col("component_id").alias("hot_id")))  # fewer than sets / HEAVY
    met = named.join(hot, "label", "left")
    rest = met.filter("hot_id is null").drop("hot_id").join(least.filter(F.col("c") <= HEAVY).drop("c"), "label")
    return met.filter("hot_id is not null").select("digest", "copies", F.col("hot_id").alias("component_id")).unionByName(rest.select("digest", "copies", "component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "jaccard")
    rows, unique = _rows(docs, folder)
    keyed = rows.select(F.col("row").alias("doc_id"), "text")
    scanned = written(keyed.mapInArrow(tidy(_sets), "kind int, doc_id long, n long, digest long, bitmap binary"), "sets", folder)
    found = scanned.filter("kind = 0").select(F.col("doc_id").alias("row"), "n", "digest")
    found = found.withColumn("doc_id", F.col("row")) if unique else found.join(rows.select("row", "doc_id"), "row")
    full = found.filter("n > 0")
    top = scanned.filter("kind = 1").groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(FREQUENT).toPandas()
    common = top["digest"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], top["n"].to_numpy(np.int64)[order]))
    postings = rows.select("text").mapInArrow(tidy(lambda b: _postings(frequent, b)), "token long, digest long, size int, pos int")
    dealt = postings.repartition(F.col("token")).sortWithinPartitions("token", "size", "digest")
    shared = written(dealt.mapInArrow(tidy(_shared), "token long, digest long, size int, pos int"), "shared", folder)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("known"), "doc_id", "row"))  # of null doc_ids only where there is no other
    by_set = full.groupBy("digest").agg(least.alias("r"), F.count(F.lit(1)).alias("copies"))
    sets = written(by_set.select("digest", F.col("r.doc_id").alias("least"), F.col("r.row").alias("row"), "copies"), "distinct", folder)
    maps = scanned.filter("kind = 0 and n > 0").groupBy("digest").agg(F.first("bitmap").alias("bitmap"))
    maps = written(maps.join(shared.select("digest").distinct(), "digest", "left_semi"), "maps", folder)
    lists = _dealt(shared, maps, folder)
    groups = written(lists.mapInArrow(tidy(_groups), "member long, pivot long, size int").distinct(), "groups", folder)
    named = written(_least(sets, _links(groups, sets, rows.select("row", "text"), folder)), "components", folder)
    heavy = max(HEAVY, -(-full.count() // HEAVY_MOST))  # at most total / heavy sets have more copies: a bound for the broadcast
    hot, rare = F.broadcast(named.filter(F.col("copies") > heavy).drop("copies")), named.filter(F.col("copies") <= heavy).drop("copies")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    out = full.join(hot, "digest", "left_anti").join(rare, "digest").select(columns).unionByName(full.join(hot, "digest").select(columns))
    return out.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM t
  UNION
  SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.v) AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN reach ON reach.u = t.doc_id GROUP BY t.doc_id, n.n
"""
