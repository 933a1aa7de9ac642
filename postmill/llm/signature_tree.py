"""N-gram Jaccard join: which documents share at least 80 % of their five-word shingles, and their components.

Texts with the same shingles are one class. Classes meet where they share a key: by the prefix theorem two sets with
Jaccard similarity t or more share an element within the first ``n - ceil(t n) + 1`` of each, in any one order. The
order puts shingles last that a counting sketch of the whole corpus calls frequent, and goes by hash otherwise.

The classes of a key form a signature tree: leaves with the bitmap of their shingles (some bits for each), nodes with
the OR of their bitmaps and the range of their sizes. Trees alone name the candidates, by dual traversal: a pair of nodes
is dropped where their sizes, or the greatest overlap that their bitmaps allow, rule a link out.

1. Forests, for keys of more than ``SMALL`` classes: each class goes to one of its keys' trees, another one in each round,
   and a traversal names just as many candidates as would join the tree's components if all were links. So large groups of
   near copies become few components at a cost linear in their classes.
2. All pairs: of every key that still holds several components, the traversal names all pairs of different components that
   no bound rules out. A key of more than ``BLOCK`` classes is dealt in blocks; blocks of its largest component meet those
   of its other classes, and these each other, in a task for each two blocks.

Every candidate is compared exactly, by the sorted 64-bit hashes of its shingles. No pair of classes with a similarity of
t or more is lost: a pair is dropped only where it is joined already or can't reach t. (Shingles count as equal when their
64-bit hashes are.)

Cases: a null or empty text, or one without words, has no shingles and is linked with nothing, not even with its like; with
fewer than five words the whole sequence is the one shingle; repeated rows are in one component; rows without a doc_id
get their class's component, without lending it an id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .golomb import TABLE
from .pieces import text_groups
from .work import LISTED, columns, delete, rows_left, work_dir, written

WIDTH, SLOTS, SLICE = 5, 1 << 20, 1 << 12
BLOCK, LEAF, FANOUT = 8192, 8, 4
#: Keys of more classes get forests first; at most so many rounds of them.
SMALL, ROUNDS = 4, 3
#: Bits of the widest signature.
WIDEST = 1 << 16
#: Least keys that a class remembers, so that most pairs are asked for once.
LISTED_KEYS = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    if not k:
        return hashes
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + hashes[j : j + n]
    return np.unique(_mixed(out))


def class_of(found: np.ndarray) -> int:
    """The class's signed 64-bit number."""
    value = xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))
    return value - (1 << 64) if value >> 63 else value


def signature(found: np.ndarray) -> bytes:
    """A bitmap of four to eight bits for each shingle, 64 at least: wide enough to tell 0.7 from 0.8, up to ``WIDEST``."""
    bits = min(WIDEST, max(64, 4 << int(len(found)).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(found >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bitmap: int, bits: int, to: int) -> int:
    """The bitmap that fewer bits would have made."""
    while bits > to:
        bits //= 2
        bitmap = (bitmap >> bits) | (bitmap & ((1 << bits) - 1))
    return bitmap


def reaches(overlap: int, a: int, b: int, percent: int = 80) -> bool:
    """Whether sets of a and b elements with so many in common are similar enough."""
    return 100 * overlap >= percent * (a + b - overlap)


class Leaf:
    __slots__ = ("bits", "bitmap", "comp", "fid", "keys", "n", "slack")

    def __init__(self, fid: int, n: int, comp: int, sig: bytes, keys: list[int] | None = None) -> None:
        self.fid, self.n, self.comp, self.keys = fid, n, comp, frozenset(keys or ())
        self.bitmap, self.bits = int.from_bytes(sig, "little"), 8 * len(sig)
        self.slack = n - self.bitmap.bit_count()


def possible(a: Leaf, b: Leaf) -> int:
    """The greatest overlap that two bitmaps allow."""
    m = min(a.bits, b.bits)
    x, y = folded(a.bitmap, a.bits, m), folded(b.bitmap, b.bits, m)
    return min(a.n - (x & ~y).bit_count(), b.n - (y & ~x).bit_count())


class Node:
    """Some leaves: the OR of their bitmaps, and the ranges of their sizes and components."""

    __slots__ = ("bits", "bitmap", "children", "comp", "high", "leaves", "low", "slack", "whole")

    def __init__(self, leaves: list[Leaf], children: list[Node]) -> None:
        self.leaves, self.children = leaves, children
        below = leaves or children
        self.bits = min(x.bits for x in below)
        self.bitmap = 0
        for x in below:
            self.bitmap |= folded(x.bitmap, x.bits, self.bits)
        self.low = min(x.n if leaves else x.low for x in below)
        self.high = max(x.n if leaves else x.high for x in below)
        comps = {x.comp for x in below}
        self.comp = comps.pop() if len(comps) == 1 else None
        self.whole = False  # whether a forest has joined all its leaves
        # a leaf's elements that its bitmap, at this node's width, doesn't count one by one
        self.slack = max(x.n - folded(x.bitmap, x.bits, self.bits).bit_count() for x in self.below())

    def below(self) -> list[Leaf]:
        return self.leaves or [x for k in self.children for x in k.below()]


def build(leaves: list[Leaf], round_: int | None = None) -> Node | None:
    """A tree over leaves in the order of component and size, so that nodes hold what is alike.

    For a round of forests they stand in the order of size at first, and then in a new order each time, so that other pairs
    than those that weren't links are tried first.
    """
    if not leaves:
        return None
    if round_ is None:
        leaves = sorted(leaves, key=lambda x: (x.comp, x.n, x.fid))
    elif round_ == 0:
        leaves = sorted(leaves, key=lambda x: (x.n, x.fid))
    else:
        leaves = sorted(leaves, key=lambda x: (xxhash.xxh3_64_intdigest(x.fid.to_bytes(8, "little", signed=True), seed=round_), x.fid))
    level = [Node(leaves[k : k + LEAF], []) for k in range(0, len(leaves), LEAF)]
    while len(level) > 1:
        level = [Node([], level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)]
    return level[0]


def apart(x: Node, y: Node, percent: int) -> bool:
    """Whether sizes or bitmaps rule out that leaves of two nodes are similar enough."""
    if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
        return True
    if x is y or x.bits != y.bits:
        return False
    # of each leaf, what lies outside the other node's bits can't be common
    return not reaches(min((x.bitmap & y.bitmap).bit_count() + min(x.slack, y.slack), x.high, y.high), x.low, y.low, percent)


def open_pair(u: Leaf, v: Leaf, percent: int) -> bool:
    """Whether no bound rules out that two leaves are similar enough."""
    return 100 * min(u.n, v.n) >= percent * max(u.n, v.n) and reaches(possible(u, v), u.n, v.n, percent)


def _ordered(u: Leaf, v: Leaf) -> tuple[int, int]:
    return (u.fid, v.fid) if u.fid < v.fid else (v.fid, u.fid)


def dual(a: Node, b: Node, percent: int):
    """Pairs of leaves of two nodes (or of one node with itself), of different components, that no bound rules out."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if (x.comp is not None and x.comp == y.comp) or apart(x, y, percent):
            continue
        if x.leaves and y.leaves:
            for i, u in enumerate(x.leaves):
                for v in x.leaves[i + 1 :] if x is y else y.leaves:
                    if u.comp != v.comp and open_pair(u, v, percent):
                        yield _ordered(u, v)
        elif x is y:
            kids = x.children
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif y.leaves or (x.children and x.high - x.low >= y.high - y.low):
            stack += [(k, y) for k in x.children]
        else:
            stack += [(x, k) for k in y.children]


def forest(tree: Node, percent: int):
    """Pairs of a tree's leaves that no bound rules out, as many as join its components if all of them are links.

    Nodes are joined from below; a pair of nodes whose leaves are joined already isn't walked.
    """
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    def whole(x: Node) -> bool:
        if not x.whole:
            below = x.leaves or x.children
            x.whole = all(x.leaves or k.whole for k in below) and len({find(some(k)) for k in below}) == 1
        return x.whole

    def some(x: Leaf | Node) -> int:
        while not isinstance(x, Leaf):
            x = (x.leaves or x.children)[0]
        return x.comp

    def met(x: Node, y: Node):
        if x is not y and ((x.whole and y.whole and find(some(x)) == find(some(y))) or apart(x, y, percent)):
            return
        if x.leaves and y.leaves:
            for i, u in enumerate(x.leaves):
                for v in x.leaves[i + 1 :] if x is y else y.leaves:
                    p, q = find(u.comp), find(v.comp)
                    if p != q and open_pair(u, v, percent):
                        parent[p] = q
                        yield _ordered(u, v)
            whole(x), whole(y)
        elif x is y:
            kids = x.children
            for k in kids:
                yield from met(k, k)
            for i, k in enumerate(kids):
                for other in kids[i + 1 :]:
                    yield from met(k, other)
            whole(x)
        elif y.leaves or (x.children and x.high - x.low >= y.high - y.low):
            for k in x.children:
                yield from met(k, y)
            whole(x)
        else:
            for k in y.children:
                yield from met(x, k)
            whole(y)

    yield from met(tree, tree)


def _batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, pa.int64()) for a in arrays], names=names)


def classes(docs: DataFrame, home: str) -> DataFrame:
    """(doc_id, text_key, fid, n, sig) of each row, and this partition's counts by slice of the sketch (slice, counts).

    ``text_key`` is a hash of the text as it stands, to tell rows apart that share a doc_id.
    """

    def run(batches):
        counts, seen = np.zeros(SLOTS, np.uint32), set()
        names = ["doc_id", "text_key", "fid", "n", "sig", "slice", "counts"]

        def pairs():
            for batch in batches:
                ids = pa.StructArray.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2)], ["i", "k"])
                yield pa.RecordBatch.from_arrays([ids, batch.column(1)], names=["ids", "text"])

        for ids, texts in text_groups(pairs()):
            rows: list[list] = [[], [], []]
            for text in texts:
                found = shingles(text)
                fid = class_of(found)
                if fid not in seen and len(found):  # a class counts once for a partition
                    if len(seen) < 500_000:
                        seen.add(fid)
                    slots = (found & np.uint64(SLOTS - 1)).astype(np.int64)
                    if len(found) > 50_000:
                        counts += np.bincount(slots, minlength=SLOTS).astype(np.uint32)
                    else:
                        np.add.at(counts, slots, 1)
                rows[0].append(fid)
                rows[1].append(len(found))
                rows[2].append(signature(found) if len(found) else None)
            none = pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())
            yield _batch(names, [[x["i"] for x in ids], [x["k"] for x in ids], rows[0], rows[1], pa.array(rows[2], pa.binary()), *none])
        kept = [s for s in range(SLOTS // SLICE) if counts[s * SLICE : (s + 1) * SLICE].any()]
        if kept:
            none = pa.nulls(len(kept), pa.int64())
            data = [counts[s * SLICE : (s + 1) * SLICE].tobytes() for s in kept]
            yield _batch(names, [none, none, none, none, pa.nulls(len(kept), pa.binary()), kept, pa.array(data, pa.binary())])

    schema = "doc_id long, text_key long, fid long, n long, sig binary, slice long, counts binary"
    rows = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("text_key"))
    return written(rows.mapInArrow(run, schema), f"{home}/classes")


def frequent_slots(counted: DataFrame) -> bytes:
    """A bitmap of the slots whose count stands out from what chance puts in a slot; its size is fixed."""

    def add(batches):
        now, total = None, None
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now:
                    if now is not None:
                        yield _batch(["slice", "counts"], [[now], pa.array([total.tobytes()], pa.binary())])
                    now, total = s, np.zeros(SLICE, np.int64)
                total += np.frombuffer(data, np.uint32)
        if now is not None:
            yield _batch(["slice", "counts"], [[now], pa.array([total.tobytes()], pa.binary())])

    rows = counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice long, counts binary").collect()
    total = np.zeros(SLOTS, np.int64)
    for r in rows:
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    mean = total.mean()
    return np.packbits(total > mean + 6 * mean**0.5 + 20).tobytes()


def members(docs: DataFrame, frequent: bytes, home: str, percent: int) -> DataFrame:
    """(key, n_classes, fid, n) of the keys that several classes have; of keys with the same classes only the least.

    Keys of two classes whose sizes rule a link out are left out.
    """

    def emit(batches):
        hot, seen = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool), set()
        names = ["key", "fid", "n"]
        for _, texts in text_groups(batches):
            keys, fids, sizes = [], [], []
            for text in texts:
                found = shingles(text)
                fid = class_of(found)
                if not len(found) or fid in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(fid)
                last = hot[(found & np.uint64(SLOTS - 1)).astype(np.int64)]
                length = len(found) + percent * len(found) // -100 + 1
                chosen = np.concatenate([found[~last], found[last]])[:length]
                keys.append(chosen.view(np.int64))
                fids.append(np.full(length, fid, np.int64))
                sizes.append(np.full(length, len(found), np.int64))
                if len(keys) == 1000:
                    yield _batch(names, list(map(np.concatenate, (keys, fids, sizes))))
                    keys, fids, sizes = [], [], []
            if keys:
                yield _batch(names, list(map(np.concatenate, (keys, fids, sizes))))

    def several(batches):
        """Rows come sorted by key and class; holds one batch, and the last key's first row while it is alone."""
        alone = last = None
        names = ["key", "fid", "n"]
        for batch in batches:
            key, fid, n = (batch.column(k).to_numpy() for k in range(3))
            if not len(key):
                continue
            new = np.r_[(last is None) or (key[0], fid[0]) != last, (key[1:] != key[:-1]) | (fid[1:] != fid[:-1])]
            key, fid, n = key[new], fid[new], n[new]
            if not len(key):
                continue
            first = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
            out = ~first | np.r_[key[1:] == key[:-1], False]
            if alone and not first[0]:
                yield _batch(names, [[x] for x in alone])
            if out.any():
                yield _batch(names, [key[out], fid[out], n[out]])
            last = (int(key[-1]), int(fid[-1]))
            alone = None if out[-1] else (*last, int(n[-1]))  # a key at the batch's end waits for its second class

    schema = "key long, fid long, n long"
    keyed = columns(docs, "doc_id", "text").mapInArrow(emit, schema)
    shared = written(keyed.repartition("key").sortWithinPartitions("key", "fid").mapInArrow(several, schema), f"{home}/shared")
    marks = [F.bit_xor(F.xxhash64(F.col("fid"), F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    sets = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("least"), F.max("n").alias("most"), *marks)
    sets = sets.filter((F.col("n_classes") > 2) | (100 * F.col("least") >= percent * F.col("most")))
    asked = sets.groupBy("n_classes", "mark1", "mark2").agg(F.min("key").alias("key")).select("key", "n_classes")
    out = written(shared.join(asked, "key").select("key", "n_classes", "fid", "n"), f"{home}/members")
    delete(docs.sparkSession, f"{home}/shared")
    return out


def verified(docs: DataFrame, pairs: DataFrame, signs: DataFrame, home: str, percent: int) -> DataFrame:
    """Of written pairs (a, b) those whose sets are similar enough, compared whole."""
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.col("a").alias("fid")).unionByName(pairs.select(F.col("b").alias("fid"))).distinct()
    asked = written(asked.join(signs, "fid").select("fid", F.col("doc_id").alias("of_doc")), f"{home}/asked")
    listed = F.broadcast(asked) if asked.count() <= LISTED else asked
    texts = columns(docs, "doc_id", "text")
    texts = texts.join(listed, texts["doc_id"].eqNullSafe(listed["of_doc"])).select("fid", "text")

    def sets(batches):
        for fids, texts in text_groups(batches):
            found = [(f, shingles(t)) for f, t in zip(fids, texts, strict=True)]
            found = [(f, s.tobytes()) for f, s in found if class_of(s) == f]  # a repeated doc_id may have other texts
            if found:
                yield _batch(["fid", "elements"], [[f for f, _ in found], pa.array([s for _, s in found], pa.binary())])

    table = texts.mapInArrow(sets, "fid long, elements binary").dropDuplicates(["fid"])
    table = written(table, f"{home}/sets")
    wide = pairs.join(table.select(F.col("fid").alias("a"), F.col("elements").alias("set_a")), "a").join(table.select(F.col("fid").alias("b"), F.col("elements").alias("set_b")), "b")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(reaches(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    links = written(wide.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), f"{home}/links")
    for done in ("asked", "sets"):
        delete(docs.sparkSession, f"{home}/{done}")
    return links


def components(links: DataFrame, home: str) -> DataFrame:
    """(fid, comp): the least class of each linked class's component, by least neighbours and pointer jumps."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{home}/both")
    labels = written(both.groupBy(F.col("a").alias("fid")).agg(F.least(F.min("b"), F.col("fid")).alias("comp")), f"{home}/labels-0")
    step = 0
    while True:
        step += 1
        of = labels.select(F.col("fid").alias("b"), F.col("comp").alias("other"))
        near = both.join(of, "b").groupBy(F.col("a").alias("fid")).agg(F.min("other").alias("near"))
        lower = labels.join(near, "fid").select("fid", F.least("comp", "near").alias("target"), F.col("comp").alias("was"))
        jump = lower.select(F.col("fid").alias("target"), F.col("target").alias("jumped"))
        moved = lower.join(jump, "target", "left").select("fid", F.least("target", F.coalesce("jumped", "target")).alias("comp"), "was")
        moved = written(moved, f"{home}/labels-{step}")
        changed = not moved.filter("comp <> was").isEmpty()
        labels = moved.select("fid", "comp")
        if not changed:
            return labels


def joined(labels: DataFrame | None, links: DataFrame, home: str) -> DataFrame:
    """(fid, comp) after more links; these join components, of which there are fewer than classes."""
    if labels is None:
        return components(links, home)
    of_a, of_b = (labels.select(F.col("fid").alias(c), F.col("comp").alias(f"of_{c}")) for c in "ab")
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(ends.filter("a <> b").distinct(), home).select(F.col("fid").alias("comp"), F.col("comp").alias("into"))
    old = labels.join(moved, "comp", "left").select("fid", F.coalesce("into", "comp").alias("comp"))
    # a component of one class had no label until now
    alone = moved.join(labels.select(F.col("fid").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("fid"), F.col("into").alias("comp"))
    return written(old.unionByName(alone), f"{home}/joined")


def _named(known: DataFrame, labels: DataFrame | None, home: str) -> DataFrame:
    """Members with their component, of keys that hold several components."""
    named = known.withColumn("comp", F.col("fid")) if labels is None else known.join(labels, "fid", "left").withColumn("comp", F.coalesce("comp", "fid")).select(*known.columns, "comp")
    if labels is None:
        return named
    named = written(named, f"{home}/named")
    several = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    return named.join(several.select("key"), "key")


def forest_pairs(known: DataFrame, labels: DataFrame | None, signs: DataFrame, home: str, percent: int, round_: int) -> DataFrame:
    """Candidates (a, b) of this round's forests: each class stands in one tree, that of its largest key at first."""
    named = _named(known.filter(F.col("n_classes") > SMALL), labels, home)
    liked = F.col("n_classes") if round_ == 0 else F.lit(0)
    chosen = named.groupBy("fid").agg(F.max(F.struct(liked.alias("liked"), F.xxhash64(F.col("key"), F.lit(round_)).alias("h"), "key", "n_classes", "comp", "n")).alias("x")).select("fid", "x.key", "x.n_classes", "x.comp", "x.n")
    rows = chosen.join(signs.select("fid", "sig"), "fid")
    # blocks of a large key are dealt anew in each round
    block = F.pmod(F.xxhash64(F.col("fid"), F.lit(round_)), F.ceil(F.col("n_classes") / BLOCK)).cast("int")
    rows = rows.select("key", block.alias("i"), "fid", "n", "comp", "sig")

    def traverse(batches):
        for _, held in _groups(batches, 2):
            tree = build([Leaf(fid, n, comp, sig) for _, _, fid, n, comp, sig in held], round_)
            yield from _pair_batches(forest(tree, percent))

    return rows.repartition("key", "i").sortWithinPartitions("key", "i").mapInArrow(traverse, "a long, b long")


def all_pairs(known: DataFrame, labels: DataFrame | None, signs: DataFrame, home: str, percent: int) -> DataFrame:
    """All candidates (a, b) of different components that share a key, by the key's tree."""
    named = _named(known, labels, home)
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_of"))
    groups = sizes.groupBy("key").agg(F.sum("n_of").alias("total"), F.max(F.struct("n_of", "comp")).alias("main"))
    groups = groups.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("main.n_of") / BLOCK).cast("int").alias("inside"), F.ceil((F.col("total") - F.col("main.n_of")) / BLOCK).cast("int").alias("outside"))
    listed = named.groupBy("fid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LISTED_KEYS).alias("keys"))
    rows = named.select("key", "fid", "n", "comp").join(groups, "key").join(signs.select("fid", "sig"), "fid").join(listed, "fid")
    is_main = F.col("comp") == F.col("main")
    spread = F.xxhash64("fid")
    one = (F.col("inside") == 1) & (F.col("outside") == 1)  # both fit into one tree
    own = F.when(one, F.lit(0)).when(is_main, F.pmod(spread, F.col("inside"))).otherwise(F.col("inside") + F.pmod(spread, F.col("outside"))).cast("int")
    last = F.col("inside") + F.col("outside") - 1
    met = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.when(is_main, F.col("inside")).otherwise(F.lit(0)), last))
    rows = rows.withColumn("own", own).withColumn("met", F.explode(met))
    rows = rows.select("key", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "fid", "n", "comp", "sig", "keys")

    def traverse(batches):
        for (key, i, j), held in _groups(batches, 3):
            leaves = [(own, Leaf(fid, n, comp, sig, keys)) for _, _, _, own, fid, n, comp, sig, keys in held]
            if i == j:
                tree = build([x for _, x in leaves])
                found = dual(tree, tree, percent)
            else:
                left, right = (build([x for o, x in leaves if o == side]) for side in (i, j))
                found = dual(left, right, percent) if left and right else ()
            keys = {x.fid: x.keys for _, x in leaves}
            # of several keys that both list, a pair is asked for at the least only
            yield from _pair_batches((a, b) for a, b in found if min(keys[a] & keys[b], default=key) >= key)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(traverse, "a long, b long")


def _groups(batches, width: int):
    """(first ``width`` values, rows) of sorted rows, one group at a time."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if held:
                    yield now, held
                now, held = row[:width], []
            held.append(row)
    if held:
        yield now, held


def _pair_batches(pairs, size: int = 65536):
    held: list[tuple[int, int]] = []
    for pair in pairs:
        held.append(pair)
        if len(held) == size:
            yield _batch(["a", "b"], list(zip(*held, strict=True)))
            held = []
    if held:
        yield _batch(["a", "b"], list(zip(*held, strict=True)))


def linked_classes(docs: DataFrame, home: str, percent: int, stages: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fid, n), and of each class its component's least doc_id and first row (fid, component_id, first).

    ``stages`` gets (stage, candidates, links) for each stage.
    """
    found = classes(docs, home)
    frequent = frequent_slots(found.filter("slice is not null").select("slice", "counts"))
    rows = found.filter("slice is null").select("doc_id", "text_key", "fid", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    signs = found.filter("slice is null and n > 0").groupBy("fid").agg(F.min("doc_id").alias("doc_id"), first, F.first("n").alias("n"), F.first("sig").alias("sig"))
    signs = written(signs, f"{home}/signs")
    known = members(docs, frequent, home, percent)

    labels, tried = None, None
    for stage in [*range(ROUNDS), None]:  # forests, then all pairs
        place = f"{home}/stage-{ROUNDS if stage is None else stage}"
        if stage is not None and tried is not None and new.isEmpty():
            continue  # the last forest found nothing more
        pairs = (all_pairs(known, labels, signs, place, percent) if stage is None else forest_pairs(known, labels, signs, place, percent, stage)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, f"{place}/pairs")
        new = verified(docs, pairs, signs, place, percent)
        if stages is not None:
            stages.append(("all pairs" if stage is None else f"forest {stage}", pairs.count(), new.count()))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not new.isEmpty():
            labels = joined(labels, new, place)
    least = signs.select("fid", "doc_id", "first") if labels is None else signs.join(labels, "fid", "left").select("fid", "doc_id", "first", "comp")
    least = least.withColumn("comp", F.col("fid") if labels is None else F.coalesce("comp", "fid"))
    of_comp = least.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"))
    named = written(least.select("fid", "comp").join(of_comp, "comp").select("fid", "component_id", "first"), f"{home}/components")
    for done in ("signs", "members", *[f"stage-{k}" for k in range(ROUNDS + 1)]):
        delete(docs.sparkSession, f"{home}/{done}")
    return rows, named


def similar_documents(docs: DataFrame, percent: int = 80, stages: list | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, named = linked_classes(docs, work_dir(docs.sparkSession, "signatures"), percent, stages)
    linked = rows.join(named, "fid", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a row before them, by doc_id and a hash of the text.

    Of repeated rows (same doc_id and text) one stays; rows without a doc_id come last; rows without words all stay.
    """
    home = work_dir(docs.sparkSession, "signatures")
    rows, named = linked_classes(docs, home, percent)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    out = rows_left(docs, rows.join(named, "fid").select("doc_id", "text_key", kept.alias("kept")), f"{home}/left")
    for done in ("classes", "components"):
        delete(docs.sparkSession, f"{home}/{done}")
    return out


def op4_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
