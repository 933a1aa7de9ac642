"""Encoding whole texts through a cache of white-space-delimited pieces.

A pre-tokeniser of the GPT-2 kind never joins a non-space character with a space that follows it, so a text in which
no two white-space characters touch, and which neither begins nor ends with one, may be cut before each of them: the
pieces' ids in a row are the text's ids. All other texts are encoded in one call, and so are those that hold the string
of an added token, which the library finds wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Bounds of a worker's cache, in pieces and in characters, for each of two generations: where an operator is one of
#: several that the workers keep caches for, and where it stands alone.
CACHE_PIECES, CACHE_ALONE = 180_000, 400_000
CACHE_CHARS = 10_000_000
#: New pieces that are encoded as one text, and a character that parts them where the ids alone don't.
TOGETHER, MARK = 100, "\x01"


#: White space but for the space and the line end.
_OTHERS = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def cut_at_spaces(text: str) -> list[str] | None:
    """The text's pieces, of which all but the first follow a space or begin with a line end.

    None where white space stands at an end of the text or touches other white space.
    """
    if any(c in text for c in _OTHERS):
        parts = text.split()
        if not parts or len(text) != sum(map(len, parts)) + len(parts) - 1:
            return None
    parts = text.replace("\n", " \n").split(" ")
    return None if "" in parts or "\n" in parts else parts


class _Index(dict):
    """Numbers pieces in the order of their first appearance."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """Ids of texts, by ``encode(list of strings) -> list of id lists`` on distinct pieces.

    ``words``: the tokenizer drops white space and never joins over it, so that pieces are plain words; otherwise each
    piece keeps the one white-space character before it. ``added``: the strings of the tokenizer's added tokens.
    """

    def __init__(self, encode: Callable[[list[str]], list], words: bool = False, added: Iterable[str] = (), first: np.ndarray | None = None, cache: int = CACHE_PIECES) -> None:
        self.encode, self.words, self.added, self.first, self.cache = encode, words, tuple(added), first, cache
        self.mark = self.encode([MARK])[0]
        self.elder: tuple[dict, np.ndarray, np.ndarray, np.ndarray] = ({}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self._reset()

    def _reset(self) -> None:
        self.index, self.chars, self.used = _Index(), 0, 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def _cut(self, text: str) -> list[str] | None:
        if any(x in text for x in self.added):
            return None
        if self.words:
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        parts = cut_at_spaces(text)
        if parts:
            parts[0] = "\0" + parts[0]  # no space stands before the first piece
        return parts

    def _spelled(self, piece: str) -> str:
        if self.words or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else " " + piece

    def _learn(self) -> None:
        new = self.index.new
        if not new:
            return
        index, starts, lengths, pool = self.elder
        known = np.fromiter((index.get(p, -1) for p in new), np.int64, len(new))
        unknown = known < 0
        of_new = np.empty(len(new), np.int64)
        of_new[~unknown] = lengths[known[~unknown]]
        of_new[unknown], flat = self._encoded([p for p, u in zip(new, unknown.tolist(), strict=True) if u])
        ids = np.empty(int(of_new.sum()), np.uint32)
        held = np.repeat(unknown, of_new)
        ids[held], ids[~held] = flat, pool[_ranges(starts[known[~unknown]], of_new[~unknown])]
        first, total = len(self.index) - len(new), len(ids)
        self.starts, self.lengths = (_grown(a, first + len(new)) for a in (self.starts, self.lengths))
        self.pool = _grown(self.pool, self.used + total)
        self.lengths[first : first + len(new)] = of_new
        self.starts[first : first + len(new)] = self.used + np.cumsum(of_new) - of_new
        self.pool[self.used : self.used + total] = ids
        self.used += total
        self.chars += sum(map(len, new))
        self.index.new = []

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' counts of ids, and their ids one after another."""
        counts: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        for k in range(0, len(pieces), TOGETHER):
            group = pieces[k : k + TOGETHER]
            found = self._together(group)
            if found is None:
                each = self.encode([self._spelled(p) for p in group])
                found = np.fromiter(map(len, each), np.int64, len(each)), np.array([i for ids in each for i in ids], np.uint32)
            counts.append(found[0])
            flat.append(found[1])
        return (np.concatenate(counts), np.concatenate(flat)) if counts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _together(self, group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The group encoded as one text; None where its pieces' ids can't be told apart."""
        if self.words:
            if len(self.mark) != 1:
                return None
            ids = np.array(self.encode([f" {MARK} ".join(group)])[0], np.uint32)
            marks = ids == self.mark[0]
            ends = np.append(np.flatnonzero(marks), len(ids))
            if len(ends) != len(group):
                return None
            return np.diff(ends, prepend=-1) - 1, ids[~marks]
        if self.first is None or any(p[:1] == "\0" for p in group[1:]):
            return None
        ids = np.array(self.encode(["".join(map(self._spelled, group))])[0], np.uint32)
        begins = self.first[ids]
        begins[:1] = True
        starts = np.flatnonzero(begins)
        return (np.diff(starts, append=len(ids)), ids) if len(starts) == len(group) else None

    def __call__(self, texts: Iterable[str]) -> list[np.ndarray]:
        """One uint32 array for each text."""
        numbers: list[np.ndarray | None] = []
        whole: list[str] = []
        number = self.index.__getitem__
        for text in texts:
            parts = self._cut(text)
            # a text's own NUL would look like the mark of a first piece
            if parts is None or (not self.words and "\0" in text):
                whole.append(text)
                numbers.append(None)
            else:
                numbers.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        others = iter(self.encode(whole) if whole else [])
        out = [np.array(next(others), np.uint32) if n is None else self._gather(n) for n in numbers]
        if len(self.index) > self.cache or self.chars > CACHE_CHARS:
            self.elder = (self.index, self.starts, self.lengths, self.pool)
            self._reset()
        return out

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        return self.pool[_ranges(self.starts[numbers], self.lengths[numbers])]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _grown(array: np.ndarray, need: int) -> np.ndarray:
    if need <= len(array):
        return array
    out = np.zeros(max(need, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


_ENCODERS: dict[tuple[str, bool, int], PieceEncoder] = {}


def tokenizer_encoder(path: str, words: bool = False, cache: int = CACHE_PIECES) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if (path, words, cache) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # tokens that begin with a space or a line end, in the byte-level spelling: a piece begins there
        spelled = tokenizer.get_vocab()
        first = np.zeros(max(spelled.values()) + 1, bool)
        first[[i for token, i in spelled.items() if token[:1] in ("\u0120", "\u010a")]] = True

        def encode(texts: list[str]) -> list:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        _ENCODERS[path, words, cache] = PieceEncoder(encode, words, added, first, cache)
    return _ENCODERS[path, words, cache]


def text_groups(batches, id_index: int = 0, text_index: int = 1, chars: int = 4_000_000):
    """(ids, texts) in groups of bounded size from Arrow record batches; null text counts as empty."""
    for batch in batches:
        ids, texts = batch.column(id_index), batch.column(text_index)
        at = 0
        sizes = texts.nbytes / max(1, batch.num_rows)
        step = int(max(1, min(2048, chars // max(1, sizes))))
        while at < batch.num_rows:
            yield ids.slice(at, step).to_pylist(), [t or "" for t in texts.slice(at, step).to_pylist()]
            at += step
