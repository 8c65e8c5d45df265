"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

Pre-tokens are the words between white space, with a word mark before each. The distinct pre-tokens of a slice of texts
are inserted into a trie; a node's forward score (the best sum of piece scores over its path) and number of tokens are
computed once, from its ancestors', so words with a common prefix share them, and the terminal nodes hold the counts of
their words. All nodes of one depth are computed side by side: an automaton of the reversed pieces walks up from them.

The pieces are those of the vocabulary file and fixed; only their probabilities are learnt, from the texts: the first pass
segments all texts with scores by Zipf's law over the ranks of the pieces and counts the pieces used (each word's weight
flows down its path in the trie, so shared paths are counted once), summed over all tasks; then P = (n + 1) / (N + V).
The second pass counts with those. A character that no piece holds costs one unknown token for each of its UTF-8 bytes.
Of equal scores the segmentation with the longest last piece wins.

Null and empty texts: no pre-tokens, no tokens, score 0. Words of more than LONG characters, and so very long ones, take
the same dynamic program one word at a time. Repeated rows give a row each and count as often as they occur; null
doc_ids give rows without one. Empty table: empty result. Other columns, whatever their names, are not read. Only the
sums of the pieces (a row for each piece) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.bpe import text_slices, vocabulary_path
from riskloom.llm.common import doc_texts, record, table, tidy

MARK, LONG, TOGETHER, SLICE_BYTES = "▁", 48, 40_000, 1 << 24
UNKNOWN = -25.0

_COUNT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a vocabulary file, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def rank_scores(n: int) -> np.ndarray:
    """Log-probabilities by Zipf's law: 1 / (rank + 2.7), normalised."""
    weights = 1 / (np.arange(n) + 2.7)
    return np.log(weights / weights.sum())


def learnt_scores(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities (n + 1) / (N + V)."""
    return np.log((counts + 1) / (counts.sum() + len(counts)))


class Automaton:
    """The pieces read backwards: step(states, characters) gives the next states, -1 where no piece goes on."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.code_of = np.array([ord(c) for c in letters], np.int64)
        self.n_letters = len(letters) + 1
        index, children = {c: k for k, c in enumerate(letters)}, {}
        self.piece = [-1]  # of each state, the piece that ends there
        for k, p in enumerate(pieces):
            state = 0
            for c in reversed(p):
                key = state * self.n_letters + index[c]
                state = children.get(key, 0)
                if not state:
                    state = children[key] = len(self.piece)
                    self.piece.append(-1)
            if self.piece[state] < 0:
                self.piece[state] = k
        self.piece = np.array(self.piece)
        keys = np.array(sorted(children), np.int64)
        self.keys, self.next = keys, np.array([children[k] for k in keys.tolist()], np.int64)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Code points to the automaton's letters; those that no piece holds to the last one."""
        at = np.minimum(np.searchsorted(self.code_of, codes), len(self.code_of) - 1)
        return np.where(self.code_of[at] == codes, at, self.n_letters - 1)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        key = states * self.n_letters + letters
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


class Trie:
    """Of distinct words: nodes in order of depth with their parents and letters; `terminal` is each word's node."""

    def __init__(self, words: list[str], automaton: Automaton):
        text = np.sort(np.array(words))
        order = np.argsort(np.array(words), kind="stable")
        codes = text.view(np.uint32).reshape(len(words), -1)
        size = np.char.str_len(text)
        same = codes[1:] == codes[:-1]
        shared = np.r_[0, np.minimum(np.minimum(np.cumprod(same, axis=1).sum(1), size[1:]), size[:-1])]
        depth = np.arange(codes.shape[1])
        new = (depth >= shared[:, None]) & (depth < size[:, None])
        row, at = np.nonzero(new)
        by_depth = np.lexsort((row, at))
        row, at = row[by_depth], at[by_depth]
        self.depth_end = np.r_[1, 1 + np.cumsum(np.bincount(at, minlength=codes.shape[1]))]  # node 0 is the root
        node = np.zeros((len(words), codes.shape[1] + 1), np.int64)
        node[row, at + 1] = np.arange(1, len(row) + 1)
        node[:, 1:] = np.maximum.accumulate(node[:, 1:], axis=0)  # a row that shares the prefix passes its node on
        self.parent = np.r_[0, node[row, at]]
        code = codes[row, at].astype(np.int64)
        self.letter = np.r_[0, automaton.letters(code)]
        self.bytes = np.r_[0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)]
        self.terminal = np.zeros(len(words), np.int64)
        self.terminal[order] = node[np.arange(len(words)), size]

    def forward(self, automaton: Automaton, scores: np.ndarray) -> None:
        """best and tokens of each node, the last piece of its path (-1: an unknown character) and where that begins."""
        n = len(self.parent)
        self.best, self.tokens = np.zeros(n), np.zeros(n, np.int64)
        self.last, self.before = np.full(n, -1), self.parent.copy()
        for a, b in zip(self.depth_end[:-1].tolist(), self.depth_end[1:].tolist(), strict=True):
            parent = self.parent[a:b]
            best, tokens = self.best[parent] + self.bytes[a:b] * UNKNOWN, self.tokens[parent] + self.bytes[a:b]
            last, before = self.last[a:b], self.before[a:b]
            own, up, state = np.arange(b - a), np.arange(a, b), np.zeros(b - a, np.int64)
            while len(own):  # one character further up each time; longer last pieces win ties
                state = automaton.step(state, self.letter[up])
                alive = state >= 0
                own, up, state = own[alive], self.parent[up[alive]], state[alive]
                piece = automaton.piece[state]
                ends = np.flatnonzero(piece >= 0)
                score = self.best[up[ends]] + scores[piece[ends]]
                better = ends[score >= best[own[ends]]]
                k = own[better]
                best[k], tokens[k] = self.best[up[better]] + scores[piece[better]], self.tokens[up[better]] + 1
                last[k], before[k] = piece[better], up[better]
                inside = up > 0  # the root has no letter
                own, up, state = own[inside], up[inside], state[inside]
            self.best[a:b], self.tokens[a:b] = best, tokens

    def used(self, weights: np.ndarray, n_pieces: int) -> np.ndarray:
        """How often each piece is used by the words' best paths; weights: how often each word occurs."""
        flow, out = np.bincount(self.terminal, weights, len(self.parent)), np.zeros(n_pieces)
        for a, b in zip(self.depth_end[:-1].tolist()[::-1], self.depth_end[1:].tolist()[::-1], strict=True):
            known = self.last[a:b] >= 0
            out += np.bincount(self.last[a:b][known], flow[a:b][known], n_pieces)
            flow[: a + 1] += np.bincount(self.before[a:b], flow[a:b], a + 1)[: a + 1]
        return out


def segment(word: str, scores: dict[str, float], longest: int) -> tuple[int, float, list[str]]:
    """The dynamic program of one word: number of tokens, score and the known pieces of its best path."""
    best, tokens, begin = [0.0], [0], [-1]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode(errors="surrogatepass"))
        top, count, at = best[-1] + n * UNKNOWN, tokens[-1] + n, -1
        for start in range(end - 1, max(-1, end - longest - 1), -1):
            s = scores.get(word[start:end])
            if s is not None and best[start] + s >= top:
                top, count, at = best[start] + s, tokens[start] + 1, start
        best.append(top)
        tokens.append(count)
        begin.append(at)
    used, end = [], len(word)
    while end:
        if begin[end] >= 0:
            used.append(word[begin[end] : end])
        end = begin[end] if begin[end] >= 0 else end - 1
    return tokens[-1], best[-1], used


class Counter:
    """tokens and score of each of many distinct words; with weights also the pieces that they use."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.automaton = pieces, Automaton(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.index = {p: k for k, p in reversed(list(enumerate(pieces)))}

    def count(self, words: list[str], scores: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, best, used = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(self.pieces))
        # a zero byte is the padding of numpy's strings, so words that hold one go alone
        short = np.array([k for k, w in enumerate(words) if len(w) <= LONG and "\0" not in w], np.int64)
        for at in range(0, len(short), TOGETHER):
            own = short[at : at + TOGETHER]
            trie = Trie([words[k] for k in own.tolist()], self.automaton)
            trie.forward(self.automaton, scores)
            tokens[own], best[own] = trie.tokens[trie.terminal], trie.best[trie.terminal]
            if weights is not None:
                used += trie.used(weights[own], len(self.pieces))
        if len(short) < len(words):
            by_piece = {p: float(scores[k]) for p, k in self.index.items()}
            for k in np.setdiff1d(np.arange(len(words)), short).tolist():
                tokens[k], best[k], parts = segment(words[k], by_piece, self.longest)
                if weights is not None:
                    np.add.at(used, [self.index[p] for p in parts], weights[k])
        return tokens, best, used


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _counters:
        _counters[path] = Counter(pieces_of(path))
    return _counters[path]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each text the place of its first word (one more at the end), each word's number, and the distinct pre-tokens."""
    split = pc.utf8_split_whitespace(texts)
    flat = split.flatten()
    real = pc.binary_length(flat).to_numpy() > 0
    first = np.r_[0, np.cumsum(real)][split.offsets.to_numpy()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return first, coded.indices.to_numpy().astype(np.int64), [MARK + w for w in coded.dictionary.to_pylist()]


def _used(path: str, scores, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total = counter(path), None
    for batch in batches:
        for _, texts in text_slices(batch, SLICE_BYTES):
            _, code, words = _words(texts)
            used = count.count(words, scores.value, np.bincount(code, minlength=len(words)).astype(np.float64))[2]
            total = used if total is None else total + used
    if total is not None:
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own].round().astype(np.int64))], names=["piece", "n"])


def _counted(path: str, scores, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        for rows, texts in text_slices(batch, SLICE_BYTES):
            first, code, words = _words(texts)
            tokens, best, _ = count.count(words, scores.value)
            n = np.diff(first)
            of_text = np.repeat(np.arange(len(n)), n)
            yield record(_COUNT, rows.column("doc_id"), n, *(np.bincount(of_text, x[code], len(n)).astype(x.dtype) for x in (tokens, best)))


def learn(docs: DataFrame, path: str) -> np.ndarray:
    """The pieces' log-probabilities, from one segmentation of all texts by the scores of their ranks."""
    spark, n = docs.sparkSession, len(pieces_of(path))
    start = spark.sparkContext.broadcast(rank_scores(n))
    used = doc_texts(docs).mapInArrow(tidy(lambda batches: _used(path, start, batches)), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = np.zeros(n)
    for piece, k in used.collect():  # one row for each piece of the vocabulary at most
        counts[piece] = k
    return learnt_scores(counts)


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score of every row."""
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    scores = docs.sparkSession.sparkContext.broadcast(learn(docs, path))
    return doc_texts(docs).mapInArrow(tidy(lambda batches: _counted(path, scores, batches)), "doc_id long, n_pretokens long, n_tokens long, score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
