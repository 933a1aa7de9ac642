"""Byte-level BPE with a queue of merge ranks under a hierarchical bitmap.

The bytes of many pre-tokens form one linked list, cut at their ends. Each adjacent pair that has a merge rank stands in
that rank's bucket; two levels of bitmaps tell which buckets hold something, so that the lowest rank is found with two
find-first-set steps, whatever the pre-tokens' lengths. A bucket's positions are merged together, from left to right:
an entry whose pair has changed since it was queued is stale and skipped, and of overlapping pairs the left one wins.
Where a merge makes a pair of a lower rank than its own, the bucket's other positions in that pre-token would have had
to wait; such a pre-token is merged again by itself, position by position, with the same queue. The time is O(n log n)
for n bytes, and memory is bounded by the longest pre-token or ``GROUP`` bytes.

Cases: a null or empty text has no ids, and both hashes are those of the empty string; a text of any length is encoded
whole; repeated rows are encoded each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pieces import cut_at_spaces, text_groups
from .work import columns

#: Bytes of new pre-tokens that are merged together (a longer pre-token is merged whole).
GROUP = 1_000_000
#: Pieces and pre-tokens that a worker remembers in each of two generations.
CACHE_PIECES, CACHE_TOKENS = 350_000, 250_000
#: Characters of the longest pre-token and of the longest piece that are remembered.
LONGEST, LONGEST_PIECE = 64, 256
#: Unicode's White_Space property, for the body of a character class.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Buckets of entries by merge rank under two bitmap levels of 256 bits."""

    __slots__ = ("buckets", "top", "words")

    def __init__(self) -> None:
        self.top, self.words, self.buckets = 0, {}, {}

    def bucket(self, rank: int) -> list:
        """The rank's bucket, marked in the bitmaps if it is new."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            high = rank >> 8
            self.words[high] = self.words.get(high, 0) | 1 << (rank & 255)
            self.top |= 1 << high
        return found

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queues positions, an array for each distinct rank, in their order."""
        if len(ranks):
            order = ranks.argsort(kind="stable")
            ranks, positions = ranks[order], positions[order]
            starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
            for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                self.bucket(rank).append(positions[a:b])

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank, by two find-first-set steps, and its bucket, which leaves the queue."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        low = self.words[high] & -self.words[high]
        self.words[high] ^= low
        if not self.words[high]:
            self.top ^= 1 << high
        rank = (high << 8) + low.bit_length() - 1
        return rank, self.buckets.pop(rank)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token, merged position by position."""
    n = len(piece)
    after = list(range(1, n + 1))  # of a token that begins here: where it ends
    before = list(range(-1, n - 1))  # where the token on its left begins
    paired = [-1] * n  # rank of the pair that begins here, -1 when none
    queue = RankQueue()

    def pair(i: int) -> None:
        paired[i] = ranks.get(piece[i : after[after[i]]], -1) if after[i] < n else -1
        if paired[i] >= 0:
            heappush(queue.bucket(paired[i]), i)

    for i in range(n):
        pair(i)
    while (found := queue.pop()) is not None:
        rank, bucket = found
        heapify(bucket)
        while bucket:
            i = heappop(bucket)
            if paired[i] != rank:
                continue  # stale
            middle = after[i]
            after[i] = after[middle]
            paired[middle] = -1
            if after[i] < n:
                before[after[i]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
            if queue.top and bucket and (lowest := (queue.top & -queue.top).bit_length() - 1) <= rank >> 8:
                if (lowest << 8) + (queue.words[lowest] & -queue.words[lowest]).bit_length() - 1 < rank:
                    # a lower rank comes first; what is left of this bucket goes back
                    queue.bucket(rank).extend(bucket)
                    break
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Merges:
    """Merges many pre-tokens together, by the ranks of token pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for t, rank in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.found = np.array([r for _, r in pairs] + [-1], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where it has none (an id of -1 has no pairs)."""
        key = (left.astype(np.int64) << 32) | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.found[at], np.int32(-1))

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token (none of them empty)."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.r_[0, ends[:-1]]
        ids = np.append(self.of_byte[data], np.int32(-1))  # of the token that begins here; place n is outside
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[starts] = n
        paired = np.append(self.rank(ids[:n], ids[after[:n]]), np.int32(-1))
        queue = RankQueue()
        at = np.flatnonzero(paired >= 0)
        queue.push_all(paired[at], at)
        early: list[np.ndarray] = []  # places where a pair of a lower rank came up
        while (found := queue.pop()) is not None:
            rank, arrays = found
            p = arrays[0] if len(arrays) == 1 else np.sort(np.concatenate(arrays))
            p = p[paired[p] == rank]  # others are stale
            if not len(p):
                continue
            overlaps = after[p[:-1]] == p[1:]
            if overlaps.any():
                k = np.arange(len(p))
                p = p[(k - np.maximum.accumulate(np.where(np.r_[True, ~overlaps], k, 0))) % 2 == 0]
            middle = after[p]
            end = after[middle]
            touching = end[:-1] == p[1:]
            several = touching.any()
            if several:  # the left one's new pair, as it is before the right one is merged
                left = p[:-1][touching]
                new = self.rank(np.full(len(left), rank, np.int32), ids[end[:-1][touching]])
                early.append(left[(new >= 0) & (new < rank)])
            ids[p], ids[middle], paired[middle] = rank, -1, -1
            after[p] = end
            before[end] = p
            left = before[p]
            both = np.concatenate([p, left[left < n]])
            if several:
                both = np.unique(both)
            new = paired[both] = self.rank(ids[both], ids[after[both]])
            both, new = both[new >= 0], new[new >= 0]
            early.append(both[new < rank])
            queue.push_all(new, both)
        alive = ids[:n] >= 0
        flat, out, a = ids[:n][alive].tolist(), [], 0
        for b in np.cumsum(np.add.reduceat(alive, starts)).tolist():
            out.append(flat[a:b])
            a = b
        for k in np.unique(np.searchsorted(ends, np.concatenate(early), side="right")).tolist() if early else ():
            out[k] = merge(pieces[k], self.ranks)
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class _Entries(dict):
    """An entry (a list: decimal ids, decoded bytes) for each string; ``new`` ones are to be filled.

    Holds two generations: when the younger one is full it becomes the elder, whose entries come back when used.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.elder, self.new = most, {}, []

    def __missing__(self, key: str) -> list:
        entry = self.elder.get(key)
        if entry is None:
            entry = []
            self.new.append((key, entry))
        self[key] = entry
        return entry

    def taken(self) -> list[tuple[str, list]]:
        out, self.new = self.new, []
        return out

    def age(self) -> None:
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()


class ByteBpe:
    """Encodes and decodes with the ranks of a file and a pre-token pattern (its ``\\s`` is Unicode white space)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.merges = Merges(ranks)
        size = max(ranks.values()) + 1
        self.tokens, self.decimal = [b""] * size, [str(i).encode() for i in range(size)]
        for token, i in ranks.items():
            self.tokens[i] = token
        pattern = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.find = regex.compile(pattern, regex.V1).findall
        self.known = _Entries(CACHE_TOKENS)  # pre-tokens
        self.pieces = _Entries(CACHE_PIECES)  # a white-space character and what follows it up to the next

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self.entries([text])[0] for i in e[0].split(b",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _cut(self, text: str) -> list[list]:
        """The entries of the text's pieces or, where it can't be cut at white space, of its pre-tokens."""
        parts = None if "\0" in text else cut_at_spaces(text)
        if parts:
            # without two white-space characters in a row, and none at an end, a pre-token begins at each of them
            parts[0] = "\0" + parts[0]
            if max(map(len, parts)) <= LONGEST_PIECE:
                of = self.pieces.__getitem__
                return [of(p) for p in parts]
        return self._pre_tokens(text)

    def _pre_tokens(self, text: str) -> list[list]:
        return [self.known[x] if len(x) <= LONGEST else self._once(x) for x in self.find(text)]

    def _once(self, pre_token: str) -> list:
        entry: list = []
        self.known.new.append((pre_token, entry))
        return entry

    def _fill(self) -> None:
        spelled = []
        for piece, entry in self.pieces.taken():
            first = piece[:1]
            spelled.append((entry, self._pre_tokens(piece if first == "\n" else piece[1:] if first == "\0" else " " + piece)))
        held: list[tuple[list, bytes]] = []
        size = 0
        for pre_token, entry in self.known.taken():
            data = pre_token.encode()
            if held and size + len(data) > GROUP:
                self._merge(held)
                held, size = [], 0
            held.append((entry, data))
            size += len(data)
        self._merge(held)
        for entry, parts in spelled:
            entry += (b",".join([x[0] for x in parts]), b"".join([x[1] for x in parts])) if len(parts) != 1 else parts[0]

    def _merge(self, held: list[tuple[list, bytes]]) -> None:
        tokens, decimal = self.tokens, self.decimal
        for (entry, _), ids in zip(held, self.merges([data for _, data in held]) if held else (), strict=True):
            entry += (b",".join([decimal[i] for i in ids]), b"".join([tokens[i] for i in ids]))

    def entries(self, texts: list[str]) -> list[list[list]]:
        """Of each text: (decimal ids, decoded bytes) by piece."""
        out = [self._cut(t) for t in texts]
        self._fill()
        self.known.age()
        self.pieces.age()
        return out


def digests(bpe: ByteBpe, texts: list[str]) -> list[tuple[int, str, str]]:
    """Of each text: count of ids, sha256 of the ids and of what they decode to."""
    out = []
    for found in bpe.entries(texts):
        joined, decoded = b",".join([x[0] for x in found]), b"".join([x[1] for x in found])
        out.append((joined.count(b",") + 1 if joined else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return out


_BPE: dict[tuple[str, str], ByteBpe] = {}


def encode_table(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to; no shuffle, a few texts in memory."""

    def run(batches):
        key = (ranks_path, pattern)
        gc.disable()  # entries are many and in no cycles, and looking for cycles took half the time
        try:
            for ids, texts in text_groups(batches):
                if key not in _BPE:
                    _BPE[key] = ByteBpe(load_ranks(ranks_path), pattern)
                counts, a, b = zip(*digests(_BPE[key], texts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return columns(docs, "doc_id", "text").mapInArrow(run, RESULT)


def op7_rank_queue_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_table(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        pattern or public_tokenizers.PATTERN,
    )
