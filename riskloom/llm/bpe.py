"""Byte-level BPE ids by the tokenizers library: each distinct word of a slice of texts is encoded once."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLICE_BYTES, MOST_PIECES = 1 << 22, 500_000
#: Marks that the vocabulary's pattern splits off a word, as one pre-token if they stand together.
MARKS = ".,;:!?|%&$#*()-\"/"
#: Letters from here on (none of Latin, Greek or Cyrillic) are left to the library's own tables of what is a letter.
LAST_LETTER = "\u0530"


def _byte_characters() -> dict[int, int]:
    """Byte-level BPE spells each byte as one character: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def _runs(flat: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of ids as binary values, which Arrow gathers faster than numpy; run k ends before flat[ends[k + 1]]."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(flat)])


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()


def _taken(runs: pa.LargeBinaryArray, at: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of runs[at], one run after another, and the runs' ends, 0 before them."""
    out = runs.take(at)
    ends = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1] // 4
    return np.frombuffer(out.buffers()[2] or b"", np.uint32)[: ends[-1]], ends


class Encoder:
    """ids(texts): ids equal to those of Tokenizer.encode(text, add_special_tokens=False).

    A pre-token of the vocabulary begins wherever one space or line end stands between two non-spaces, so texts are cut
    there into units: what follows a space, and what begins a line, with the line end before it (a text's first unit is
    given one, and its id is dropped in the end). Each distinct unit of a slice is looked up once: letters and the marks
    after them are encoded by the library's model, all else by its whole path, and both are kept (MOST_PIECES and a
    slice's at most); the ids of the texts are gathered from theirs. Texts with other white space next to a space or line
    end (empty texts too), and those that spell a special token, take the library's whole path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spelled = _byte_characters()
        self.space = chr(self.spelled[32])
        end = self._whole("\n")
        if len(end) != 1:
            raise ValueError("a line end must be one id")
        self.line_end = int(end[0])
        self._clear()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _clear(self) -> None:
        self.flat, self.ends = array("I"), array("q", [0, 0])  # the ids of the pieces; the first piece has none
        self.stems: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.again: list[np.ndarray] = []  # pieces that a later slice asked for

    def _forget(self) -> None:
        """Keeps the pieces that were asked for again since the last time, none if they are more than half of the most."""
        asked = np.zeros(len(self.ends) - 1, bool)
        asked[np.concatenate([np.zeros(1, np.int64), *self.again])] = True
        kept = np.flatnonzero(asked)
        if len(kept) > MOST_PIECES // 2:
            return self._clear()
        flat, ends = _taken(_runs(np.array(self.flat, np.uint32), np.array(self.ends)), pa.array(kept))
        number = np.zeros(len(self.ends) - 1, np.int64)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        self.stems, self.whole, self.marks = ({k: number[v] for k, v in known.items() if number[v]} for known in (self.stems, self.whole, self.marks))
        self.flat, self.ends, self.again = array("I", flat.tobytes()), array("q", ends.tobytes()), []

    def _pieces(self, ids: list[list[int]]) -> range:
        """Numbers of the new pieces."""
        first, at = len(self.ends) - 1, len(self.flat)
        for x in ids:
            at += len(x)
            self.ends.append(at)
        self.flat.extend(chain.from_iterable(ids))
        return range(first, first + len(ids))

    def _stems(self, stems: list[str]) -> list[list[int]]:
        """The ids of letters, with the line end or space before them; none for other stems."""
        tokenize, spelled, space, out = self.tokenizer.model.tokenize, self.spelled, self.space, []
        for stem in stems:
            if stem.isascii() and stem.isalpha():
                out.append([t.id for t in tokenize(space + stem)])
                continue
            line = stem.startswith("\n")
            word = stem[line:]
            if not word.isalpha() or not (word.isascii() or max(word) < LAST_LETTER):
                out.append([])
                continue
            spelling = word.encode().decode("latin-1").translate(spelled)
            out.append([self.line_end, *(t.id for t in tokenize(spelling))] if line else [t.id for t in tokenize(space + spelling)])
        return out

    def _others(self, units: list[str]) -> list[list[int]]:
        """The ids of units that are more than letters and marks."""
        encode = self.tokenizer.encode
        return [[self.line_end, *encode(x[1:], add_special_tokens=False).ids] if x[0] == "\n" else encode(" " + x, add_special_tokens=False).ids for x in units]

    def _marks(self, marks: list[str]) -> list[list[int]]:
        return [[t.id for t in self.tokenizer.model.tokenize(x)] for x in marks]

    def _known(self, known: dict[str, int], texts: list[str], new: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """The piece of each text; -1 where new() has no ids for it."""
        found = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
        self.again.append(found[found > 0])
        missing = np.flatnonzero(found < 0).tolist()
        names = list(dict.fromkeys(texts[k] for k in missing))
        ids = new(names)
        named = [x for x, i in zip(names, ids, strict=True) if i]
        known.update(zip(named, self._pieces([i for i in ids if i]), strict=True))
        found[missing] = [known.get(texts[k], -1) for k in missing]
        return found

    def _units(self, units: pa.Array, good: np.ndarray) -> np.ndarray:
        """Two pieces for each of the units: letters, and the marks after them; none for those that are not good."""
        cut = pc.ascii_rtrim(units, characters=MARKS)
        marked = pc.binary_length(cut).to_numpy() < pc.binary_length(units).to_numpy()
        coded = cut.dictionary_encode()
        stems, code = _strings(coded.dictionary), coded.indices.to_numpy()
        out = np.zeros((len(units), 2), np.int64)
        out[:, 0] = np.where(good, self._known(self.stems, stems, self._stems)[code], 0)
        at = np.flatnonzero(out[:, 0] < 0)
        out[at, 0] = self._known(self.whole, _strings(units.take(pa.array(at))), self._others)
        marked[at] = False
        at = np.flatnonzero(marked & good)
        marks = [x[len(stems[k]) :] for x, k in zip(_strings(units.take(pa.array(at))), code[at].tolist(), strict=True)]
        out[at, 1] = self._known(self.marks, marks, self._marks)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one text after another, and the number of each text's ids."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.ends) > MOST_PIECES:
            self._forget()
        words = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        first = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        units = coded.dictionary
        trimmed = pc.binary_length(pc.utf8_trim_whitespace(units)).to_numpy()
        line = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
        good = (trimmed > 0) & (trimmed == pc.binary_length(units).to_numpy() - line)
        irregular = np.zeros(n, bool)
        if not good.all():
            irregular |= np.logical_or.reduceat(~good[coded.indices.to_numpy()], first[:-1])
        for s in self.special:
            irregular |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        pieces = self._units(units, good)
        # the ids of each unit as one run, then those of the texts
        flat, ends = _taken(_runs(np.array(self.flat, np.uint32), np.array(self.ends)), pa.array(pieces.ravel()))
        out, ends = _taken(_runs(flat, ends[::2]), coded.indices)
        total = np.diff(ends[first])
        out = np.delete(out, ends[first[:-1]][~irregular])
        if not irregular.any():
            return out, total - 1
        total -= ~irregular
        parts = np.split(out, np.cumsum(total)[:-1])
        for k in np.flatnonzero(irregular).tolist():
            parts[k] = self._whole(texts[k].as_py())
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n)


def text_slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of a batch of about `most` (SLICE_BYTES) text bytes, one row at least, and their texts (null: empty)."""
    texts = batch.column("text").fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + (most or SLICE_BYTES), "right")))
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process: Spark reuses its Python workers, and so the vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Drops this process's encoder: where memory is worth more than the time to load it again."""
    _encoders.pop(path, None)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
