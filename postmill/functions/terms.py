"""Terms of texts as 64-bit hashes: words (even) and pairs of neighbouring words (odd), counted, found and weighed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Words after which what was counted is handed on: bounds a worker's memory, whatever the partition's size.
FLUSH = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def of_rows(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a column of lists of word hashes, and the row of each; rows ascend among words and among pairs."""
    h = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(words.offsets.to_numpy()))
    same = row[1:] == row[:-1]
    pairs = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
    return np.concatenate([h & ~np.uint64(1), pairs | np.uint64(1)]).view(np.int64), np.concatenate([row, row[1:][same]])


def _counted(batches: list[pa.RecordBatch], folds: int) -> pa.RecordBatch:
    term, row = of_rows(pa.concat_arrays([b.column("_words") for b in batches]))
    order = np.argsort(term, kind="stable")
    term, row = term[order], row[order]
    first = np.ones(len(term), bool)
    first[1:] = term[1:] != term[:-1]
    once = first.copy()
    once[1:] |= row[1:] != row[:-1]
    starts = np.flatnonzero(first)
    fold = pa.concat_arrays([b.column("_fold") for b in batches]).to_numpy()[row]
    out = {"term": term[starts]}
    for k in range(folds):
        mine = fold == k
        out |= {f"n{k}": np.add.reduceat(mine, starts, dtype=np.int64), f"rows{k}": np.add.reduceat(mine & once, starts, dtype=np.int64)} if len(starts) else {f"n{k}": starts, f"rows{k}": starts}
    return pa.RecordBatch.from_pydict(out)


def counter(folds: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``_words`` and ``_fold``: by term, occurrences and rows in each fold; a term may come more than once."""

    def counts(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("_words").flatten())
            if n >= FLUSH:
                yield _counted(held, folds)
                held, n = [], 0
        if held:
            yield _counted(held, folds)

    return counts


class Lookup:
    """The places of terms in a list, by open addressing with linear probes; the table is made where it is first used."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.places = terms, None
        bits = max(4, int(4 * len(terms)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1

    def __reduce__(self):
        return Lookup, (self.terms,)

    def _fill(self) -> None:
        places = np.full(self.last + 1, -1, np.int32)
        left = np.arange(len(self.terms), dtype=np.int32)
        slot = self._home(self.terms)
        while len(left):
            free = np.flatnonzero(places[slot] < 0)
            places[slot[free]] = left[free]  # of those that want one slot, the last gets it
            wait = places[slot] != left
            left, slot = left[wait], (slot[wait] + 1) & self.last
        self.keys, self.places = np.where(places >= 0, self.terms[places], 0), places

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (_mixed(h.view(np.uint64)) >> self.shift).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Of each term its place, or -1."""
        if self.places is None:
            self._fill()
        slot = self._home(h)
        out = self.places[slot]
        on = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        out[on] = -1
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & self.last
            place = self.places[slot]
            hit = (place >= 0) & (self.keys[slot] == h[on])
            out[on[hit]] = place[hit]
            more = (place >= 0) & ~hit
            on, slot = on[more], slot[more]
        return out


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _binaries(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


#: A larger count is dealt over several entries of its place; these stand side by side.
MOST = 255


def finder(lookup) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces ``_words`` by the places of known terms, ascending, as 32-bit integers in binaries, and by their counts, as bytes.

    Rows of one fold stand together. lookup: a broadcast of a Lookup.
    """

    def find(batches):
        size = len(lookup.value.terms)
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("_fold").to_numpy(), kind="stable")))
            term, row = of_rows(batch.column("_words"))
            place = lookup.value(term)
            known = place >= 0
            code, count = np.unique(row[known].astype(np.int64) * size + place[known], return_counts=True)
            if len(count) and count.max() > MOST:
                entries = -(-count // MOST)
                last = np.cumsum(entries) - 1
                code, rest = np.repeat(code, entries), count - (entries - 1) * MOST
                count = np.full(len(code), MOST)
                count[last] = rest
            row = code // size
            kept = [batch.column(c) for c in ("_fold", "_label", "_weight")]
            columns = [*kept, _binaries((code - row * size).astype(np.int32), row, batch.num_rows), _binaries(count.astype(np.uint8), row, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["_fold", "_label", "_weight", "_places", "_counts"])

    return find


def _flat(batch: pa.RecordBatch, joined: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and counts of a batch, and where each row's begin. joined: large counts whole; sums don't need that."""
    n, found = batch.num_rows, []
    for c, kind in (("_places", np.int32), ("_counts", np.uint8)):
        column = batch.column(c)
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int32)[column.offset : column.offset + n + 1] // np.dtype(kind).itemsize
        found.append(np.frombuffer(data, kind, at[-1])[at[0] :] if data is not None and at[-1] else np.zeros(0, kind))
    place, count, at = found[0].astype(np.intp), found[1].astype(float), at - at[0]
    if joined and len(count) and count.max() == MOST:  # entries of one place and row together again
        row = np.repeat(np.arange(n), np.diff(at))
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
        place, count, at = place[first], np.add.reduceat(count, first), np.searchsorted(row[first], np.arange(n + 1))
    return place, count, at


def _runs(wanted: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], wanted, [False]])))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the stretches of x, which has a 0 more at its end, between the places of at; some may be empty."""
    return np.where(at[1:] > at[:-1], np.add.reduceat(x, at[:-1]), 0.0)


#: Spark's vectors as they stand in rows.
VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def vectors(scales, fold: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sparse vectors of a fold's features. scales: a broadcast of the factors of each place and fold, 0 where it is no feature."""

    def scaled(batches):
        scale = np.ascontiguousarray(scales.value[:, fold])
        for batch in batches:
            place, count, at = _flat(batch, joined=True)
            n = batch.num_rows
            row, factor = np.repeat(np.arange(n), np.diff(at)), scale[place]
            kept = factor > 0
            place, value, row = place[kept].astype(np.int32), count[kept] * factor[kept], row[kept]
            column = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(scale), np.int32)), _lists(place, row, n), _lists(value, row, n)], fields=list(VECTOR))
            yield pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("_weight"), column], names=["_label", "_weight", "_features"])

    return scaled


#: Sums over rows, by model and piece of the features.
SUMS = "model int, piece int, loss double, slope double, features binary"
PIECES = 8


def _handed(sums: np.ndarray, loss: np.ndarray, slope: np.ndarray) -> pa.RecordBatch:
    rows = [(k, j, loss[k] * (j == 0), slope[k] * (j == 0), part.tobytes()) for k, one in enumerate(sums) for j, part in enumerate(np.array_split(one, PIECES))]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["model", "piece", "loss", "slope", "features"])


def moments(size: int, folds: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of weighted counts (model k) and of their squares (model folds + k) of the rows of each fold k, in ``loss`` and ``slope`` those of weights and of their squares."""

    def of(batches):
        sums, weights, squares = np.zeros((2 * folds, size)), np.zeros(2 * folds), np.zeros(2 * folds)
        for batch in batches:
            place, count, at = _flat(batch, joined=True)
            weight, fold = batch.column("_weight").to_numpy(), batch.column("_fold").to_numpy()
            for k in range(folds):
                for a, b in _runs(fold == k):
                    p, c = place[at[a] : at[b]], count[at[a] : at[b]]
                    x = np.repeat(weight[a:b], np.diff(at[a : b + 1])) * c
                    sums[k] += np.bincount(p, x, size)
                    sums[folds + k] += np.bincount(p, x * c, size)
                    weights[k] += weight[a:b].sum()
                    squares[k] += (weight[a:b] ** 2).sum()
        yield _handed(sums, weights, squares)

    return of


def gradients(points) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of logistic losses and of their gradients over the rows outside each model's fold.

    points: a broadcast of folds, one row of weights of counts for each, and intercepts.
    """

    def of(batches):
        folds, weights, intercepts = points.value
        size = weights.shape[1]
        sums, loss, slope = np.zeros(weights.shape), np.zeros(len(folds)), np.zeros(len(folds))
        for batch in batches:
            place, count, at = _flat(batch)
            fold, label, weight = (batch.column(c).to_numpy() for c in ("_fold", "_label", "_weight"))
            for m, k in enumerate(folds):
                for a, b in _runs(fold != k):
                    p, c = place[at[a] : at[b]], count[at[a] : at[b]]
                    x = np.zeros(len(p) + 1)
                    weights[m].take(p, out=x[:-1], mode="clip")
                    x[:-1] *= c
                    margin = np.where(label[a:b] > 0, 1.0, -1.0) * (_sums(x, at[a : b + 1] - at[a]) + intercepts[m])
                    loss[m] += weight[a:b] @ np.logaddexp(0, -margin)
                    rest = np.where(label[a:b] > 0, -1.0, 1.0) * weight[a:b] * np.exp(-np.logaddexp(0, margin))
                    slope[m] += rest.sum()
                    x = np.repeat(rest, np.diff(at[a : b + 1]))
                    x *= c
                    more = np.bincount(p, x)
                    sums[m, : len(more)] += more
        yield _handed(sums, loss, slope)

    return of


def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each model and piece."""
    out: dict[tuple[int, int], list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            part = np.frombuffer(r["features"])
            loss, slope, sums = out.get((r["model"], r["piece"]), (0.0, 0.0, 0.0))
            out[r["model"], r["piece"]] = [loss + r["loss"], slope + r["slope"], sums + part]
    if out:
        columns = [[k for k, _ in out], [j for _, j in out], *([x[i] for x in out.values()] for i in (0, 1)), [x[2].tobytes() for x in out.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()], strict=True)], names=["model", "piece", "loss", "slope", "features"])


def margins(weights, intercepts: list[float]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's margin by the model of its fold. weights: a broadcast, by place and fold."""

    def margin(batches):
        for batch in batches:
            place, count, at = _flat(batch)
            fold = batch.column("_fold").to_numpy()
            sums = _sums(np.append(count * weights.value[place, np.repeat(fold, np.diff(at))], 0.0), at)
            yield pa.RecordBatch.from_arrays([batch.column("_fold"), batch.column("_label"), pa.array(sums + np.array(intercepts)[fold])], names=["_fold", "_label", "_margin"])

    return margin


def probabilities(words: pa.ListArray, lookup: Lookup, weights: np.ndarray, intercepts: list[float], lines: list[list[float]]) -> pa.Array:
    """The mean of the folds' calibrated probabilities, of each row of word hashes."""
    term, row = of_rows(words)
    place = lookup(term)
    known = place >= 0
    place, row = place[known], row[known]
    out = np.zeros(len(words))
    for k, (slope, intercept) in enumerate(lines):
        margin = np.bincount(row, weights[place, k], len(words)) + intercepts[k]
        out += 1 / (1 + np.exp(-np.clip(margin * slope + intercept, -700, 700)))
    return pa.array(out / max(1, len(lines)))
