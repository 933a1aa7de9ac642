"""Packing by cutting-stock column generation.

Documents become pieces: whole sequences of ``capacity`` ids, and one remainder each. Remainders are counted by size, in
units of ``unit`` ids (rounded up). A linear program over patterns (how many pieces of each size a sequence holds) asks
for the fewest sequences; its columns are generated by a knapsack dynamic program priced with the duals, until the
bound of Farley shows that little is left to gain. Pattern counts are rounded down; what remains over is a few hundred
sequences at most, filled from the largest piece down, with the last piece cut to fit. Patterns are laid over
documents ranked within their size. Only the histogram (``capacity / unit`` numbers) and the plan reach the driver.

Cases: a null text counts as empty and holds the end id alone; an empty table gives no pieces; repeated rows are
packed each for itself (rows of one doc_id and one text can't be told apart, and share their pieces); rows without a
doc_id are packed too; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import CACHE_ALONE, CACHE_PIECES, text_groups, tokenizer_encoder
from .work import columns, work_dir, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces that are ranked together, on average.
RANKED = 2_000


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of highest price; ``prices[s]`` for size s + 1, in units."""
    n = len(prices)
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        found = value[c - m : c][::-1] + prices[:m]
        k = int(found.argmax())
        if found[k] > value[c - 1] + 1e-12:
            value[c], last[c] = found[k], k + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(n, np.int64), capacity
    while c:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(value[capacity]), pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: patterns filled from the largest size down, each used until one of its sizes is exhausted.

    Column j is the pattern that exhausts size j, so the columns form a triangular matrix in the order of exhaustion.
    """
    m = len(sizes)
    left, patterns, x = demand.copy(), np.zeros((m, m)), np.zeros(m)
    alive = list(range(m))
    while alive:
        column, room = np.zeros(m), capacity
        for j in reversed(alive):
            if sizes[j] <= room:
                column[j] = room // sizes[j]
                room -= int(column[j]) * sizes[j]
        held = np.flatnonzero(column)
        j = int(held[np.argmin(left[held] / column[held])])
        n = left[j] / column[j]
        left[held] = np.maximum(left[held] - n * column[held], 0)
        patterns[:, j], x[j] = column, n
        alive.remove(j)
    return patterns, x


def solve_patterns(demand: np.ndarray, capacity: int, gap: float = 0.0005, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """The linear program's patterns and how often each is used; ``demand[s]`` pieces of s + 1 units.

    Revised simplex on the equality form; ``rounds`` bounds the pivots (any basis on the way is a whole solution).
    """
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    if not m:
        return []
    d = demand[sizes].astype(float)
    patterns, x = first_basis(sizes + 1, d, capacity)
    inverse = np.linalg.inv(patterns)
    prices = np.zeros(int(sizes[-1]) + 1)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices[:] = 0
        prices[sizes] = np.maximum(duals, 0)
        value, column = best_pattern(prices, capacity)
        bound = (np.maximum(duals, 0) @ d) / max(value, 1.0)
        if value <= 1 + 1e-9 or x.sum() - bound <= gap * x.sum():
            break
        entering = column[sizes].astype(float)
        step = inverse @ entering
        ratios = np.full(m, np.inf)
        np.divide(x, step, out=ratios, where=step > 1e-9)
        leave = int(ratios.argmin())
        theta = ratios[leave]
        x -= theta * step
        x[leave] = theta
        np.maximum(x, 0, out=x)
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        patterns[:, leave] = entering
    full = []
    for j in range(m):
        if x[j] > 1e-6:
            whole = np.zeros(len(demand), np.int64)
            whole[sizes] = patterns[:, j].astype(np.int64)
            full.append((whole, float(x[j])))
    return full


def plan_sequences(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Rows (size, first rank, end rank, first sequence, pieces of this size a sequence, place, from unit, to unit).

    ``demand[s]`` pieces of s + 1 units; every piece of every size is laid down exactly once, whole or in parts.
    """
    rows, used, sequence = [], np.zeros(len(demand), np.int64), 0
    remaining = demand.astype(np.int64).copy()

    def take(size: int, count: int, each: int, place: int) -> None:
        rows.append((size, int(used[size - 1]), int(used[size - 1]) + count, sequence, each, place, 0, size))
        used[size - 1] += count
        remaining[size - 1] -= count

    for pattern, x in solve_patterns(demand, capacity):
        held = np.flatnonzero(pattern)
        n = min(int(x + 1e-6), *(int(remaining[s] // pattern[s]) for s in held))
        if n > 0:
            for place, s in enumerate(held[::-1]):
                take(int(s) + 1, n * int(pattern[s]), int(pattern[s]), place)
            sequence += n
    # what rounding left: the largest that fits, and the last one cut
    part: tuple[int, int, int] | None = None  # size, rank and first unit of a piece that was cut
    while part or remaining.any():
        room, place = capacity, 0
        if part:
            size, rank, at = part
            end = min(size, at + room)
            rows.append((size, rank, rank + 1, sequence, 1, place, at, end))
            room, place = room - (end - at), 1
            part = (size, rank, end) if end < size else None
        while room and remaining.any():
            fits = np.flatnonzero(remaining[:room])
            if len(fits):
                s = int(fits[-1])
                n = min(int(remaining[s]), room // (s + 1))
                take(s + 1, n, n, place)
                room, place = room - n * (s + 1), place + 1
            else:
                s = int(np.flatnonzero(remaining)[0])
                rank = int(used[s])
                used[s] += 1
                remaining[s] -= 1
                rows.append((s + 1, rank, rank + 1, sequence, 1, place, 0, room))
                part, room = (s + 1, rank, room), 0
        sequence += 1
    return rows


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _encoded(batches, tokenizer: str, end_id: int, text_index: int = 1, cache: int = CACHE_PIECES):
    encode, end = tokenizer_encoder(tokenizer, True, cache), np.array([end_id], np.uint32)
    for doc_ids, texts in text_groups(batches, 0, text_index):
        yield doc_ids, [np.concatenate([ids, end]) for ids in encode(texts)]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cache: int = CACHE_PIECES) -> DataFrame:
    """Each document's whole sequences and its remainder, with the checksum of their ids."""

    def run(batches):
        for doc_ids, found in _encoded(batches, tokenizer, end_id, cache=cache):
            rows = [(i, k, min(capacity, len(ids) - k), _crc(ids[k : k + capacity]), len(ids)) for i, ids in zip(doc_ids, found, strict=True) for k in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return columns(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, unit: int = 4, cache: int = CACHE_PIECES) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    home = work_dir(spark, "packing")
    units = capacity // unit
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id, cache).withColumn("size", F.ceil(F.col("length") / unit).cast("int")), f"{home}/pieces")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([counts.get(s + 1, 0) for s in range(units)], np.int64)
    plan = plan_sequences(demand, units)
    if not plan:
        return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = ["size", "rank_from", "rank_to", "first_sequence", "each", "place", "unit_from", "unit_to"]
    # at most a few rows for each pattern and each sequence left by rounding: bounded by capacity / unit
    columns_ = zip(names, zip(*plan, strict=True), strict=True)
    rules = spark.createDataFrame(pa.table({n: pa.array(c, pa.int32() if n == "size" else pa.int64()) for n, c in columns_}))

    blocks = int(max(1, demand.sum() // RANKED))
    key = ["doc_id", "start", "ids_crc32"]
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)))
    in_block = blocked.withColumn("in_block", F.row_number().over(Window.partitionBy("size", "block").orderBy(*key)) - 1)
    starts = blocked.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("size", "block", (F.sum("n").over(Window.partitionBy("size").orderBy("block")) - F.col("n")).alias("before"))
    ranked = in_block.join(starts, ["size", "block"]).withColumn("rank", F.col("before") + F.col("in_block"))

    laid = ranked.join(F.broadcast(rules), (ranked["size"] == rules["size"]) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1))
    laid = laid.select(
        "doc_id",
        (F.col("start") + F.col("unit_from") * unit).alias("start"),
        (F.least(F.col("length"), F.col("unit_to") * unit) - F.col("unit_from") * unit).alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - rank_from) div each")).alias("sequence_id"),
        "place",
        F.col("start").alias("whole_start"),
        F.col("length").alias("whole_length"),
    )
    laid = written(laid, f"{home}/laid")
    whole = laid.filter("length = whole_length")
    cut = laid.filter("length < whole_length")
    together = whole.select(*[c for c in whole.columns if not c.startswith("whole_")]).unionByName(_checked(docs, cut, tokenizer, end_id))
    offset = Window.partitionBy("sequence_id").orderBy("place", "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return together.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(offset), F.lit(0)).cast("long").alias("offset"))


def _checked(docs: DataFrame, cut: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The few pieces that were cut, with checksums of their own; their documents are encoded again."""
    asked = cut.select("doc_id", "whole_start", "whole_length", "ids_crc32", "start", "length").distinct()
    # no more than the sequences that rounding left, which capacity / unit bounds
    listed = asked.groupBy("doc_id").agg(F.collect_list(F.struct("whole_start", "whole_length", "ids_crc32", "start", "length")).alias("asked"))
    texts = columns(docs, "doc_id", "text")
    found = texts.join(F.broadcast(listed), texts["doc_id"].eqNullSafe(listed["doc_id"])).select(texts["doc_id"], "asked", "text")

    def run(batches):
        for batch in batches:
            asked = batch.column(1).to_pylist()
            got = [x for group in _encoded([batch], tokenizer, end_id, 2) for x in zip(*group, strict=True)]
            rows = [
                (doc_id, a["whole_start"], a["whole_length"], a["ids_crc32"], a["start"], a["length"], _crc(ids[a["start"] : a["start"] + a["length"]]))
                for (doc_id, ids), wants in zip(got, asked, strict=True)
                for a in wants
                if _crc(ids[a["whole_start"] : a["whole_start"] + a["whole_length"]]) == a["ids_crc32"]
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=CHECKED)

    sums = found.mapInArrow(run, ", ".join(f"{c} long" for c in CHECKED)).distinct().withColumnRenamed("doc_id", "of_doc")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc"))
    for c in ("whole_start", "whole_length", "ids_crc32", "start", "length"):
        sums = sums.withColumnRenamed(c, f"of_{c}")
        same = same & (F.col(c) == F.col(f"of_{c}"))
    joined = cut.join(F.broadcast(sums), same)
    return joined.select("doc_id", "start", "length", F.col("own_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "place")


CHECKED = ["doc_id", "whole_start", "whole_length", "ids_crc32", "start", "length", "own_crc"]


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids (array), padded to ``capacity``."""

    def run(batches):
        for doc_ids, found in _encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    ids = columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<bigint>")
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part"))
    rows = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.lit(capacity) - F.size("ids"))
    return rows.select("sequence_id", F.concat("ids", pad).alias("ids"))


def op2_cutting_stock(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, cache=CACHE_ALONE)
