"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition sorts the distinct fingerprints of its texts, codes the gaps with a Golomb code, one message for each
   owner of a range of fingerprints, and sends them; a text's many copies in a partition are one fingerprint with a flag.
2. An owner decodes its messages and answers each with a bitmap: which of its fingerprints stand more than once.
3. The partition reads its texts again. Those whose bit is clear are unique. Only suspects are shuffled, grouped by the
   whole text itself (with partial groups before the shuffle, so that a hot text travels once from each partition).

A fingerprint has the bits of the row count's logarithm and twelve more: a false suspect is one in thousands, and only
costs its shuffle. A text whose fingerprint isn't in its partition's messages (a partition that was dealt otherwise on
the second reading) counts as a suspect, so the result does not hang on how rows are dealt.

Cases: null counts as the empty text; of repeated rows with one doc_id one stays; rows without a doc_id stay only when
their group has none with one; an empty table gives no rows; further columns are ignored, or
stay with the rows that ``once_each`` returns.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import text_groups
from .work import delete, filesystem, rows_left, work_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Fingerprints that one message round of a partition covers, and that one owner handles on average.
ROUND, OWNED = 500_000, 400_000
MESSAGE = "src long, owner long, n long, k int, payload binary, repeated binary"
ANSWER = MESSAGE + ", found binary"


def golomb_encode(gaps: np.ndarray, k: int) -> bytes:
    """Golomb code with parameter 2**k: quotient in unary, then k bits."""
    gaps = gaps.astype(np.uint64)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - (quotients + 1 + k)
    ones = np.repeat(starts - np.cumsum(quotients) + quotients, quotients) + np.arange(int(quotients.sum()))
    bits[ones] = 1
    for j in range(k):
        bits[ends - k + j] = ((gaps >> np.uint64(k - 1 - j)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).tobytes()


def golomb_decode(data: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.flatnonzero(bits == 0)
    stops = np.empty(n, np.int64)
    quotients = np.empty(n, np.uint64)
    at = z = 0
    for i in range(n):
        while zeros[z] < at:
            z += 1
        stop = int(zeros[z])
        quotients[i], stops[i] = stop - at, stop
        at = stop + 1 + k
    out = quotients << np.uint64(k)
    for j in range(k):
        out |= bits[stops + 1 + j].astype(np.uint64) << np.uint64(k - 1 - j)
    return out


def code_parameter(span: int, n: int) -> int:
    """The parameter's logarithm for n values spread over a span."""
    return max(0, int(math.log2(max(1.0, span / max(1, n) * math.log(2)))))


def owned(owner: int, owners: int, bits: int) -> tuple[int, int]:
    """The range of fingerprints of an owner."""
    return -(-(owner << bits) // owners), -(-((owner + 1) << bits) // owners)


def messages(values: np.ndarray, src: int, owners: int, bits: int):
    """A row for each owner that gets fingerprints; ``repeated`` has a bit for those that stand here more than once."""
    values, counts = np.unique(values, return_counts=True)
    bounds = np.searchsorted(values, np.array([owned(o, owners, bits)[0] for o in range(owners + 1)], np.uint64))
    for o in range(owners):
        a, b = bounds[o], bounds[o + 1]
        if a < b:
            low, high = owned(o, owners, bits)
            k = code_parameter(high - low, b - a)
            gaps = np.diff(values[a:b], prepend=np.uint64(low))
            yield src, o, int(b - a), k, golomb_encode(gaps, k), np.packbits(counts[a:b] > 1).tobytes()


def opened(owner: int, n: int, k: int, payload: bytes, owners: int, bits: int) -> np.ndarray:
    return np.cumsum(golomb_decode(payload, n, k)) + np.uint64(owned(owner, owners, bits)[0])


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


def fingerprint(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - bits)


def _source(partition: int, round_: int) -> int:
    return (partition << 20) | round_


def exact_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, work_dir(docs.sparkSession, "golomb"), owners).drop("text_key")


def once_each(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """The rows of ``docs``, whole, that stay; of repeated rows (same doc_id and text) any one."""
    home = work_dir(docs.sparkSession, "golomb")
    several = _decided(docs, home, owners).filter("group_size > 1").select("doc_id", "text_key", "kept")
    out = rows_left(docs, several, f"{home}/left")
    for done in ("rows", "groups"):
        delete(docs.sparkSession, f"{home}/{done}")
    return out


def _decided(docs: DataFrame, home: str, owners: int | None) -> DataFrame:
    """The fate of each row, with a hash of its text as it stands (text_key)."""
    spark = docs.sparkSession
    n_rows = docs.count()
    bits = min(62, max(20, n_rows.bit_length() + 12))
    owners = owners or max(16, -(-n_rows // OWNED))
    read = docs.select(docs["doc_id"], docs["text"])

    def send(batches):
        from pyspark import TaskContext

        me, rounds, held, n = TaskContext.get().partitionId(), 0, [], 0
        for _, texts in text_groups(batches):
            found = [fingerprint(hashlib.sha256(normalised(t)).digest(), bits) for t in texts]
            held.append(np.array(found, np.uint64))
            n += len(found)
            if n >= ROUND:
                yield from _rows(messages(np.concatenate(held), _source(me, rounds), owners, bits), MESSAGE)
                rounds, held, n = rounds + 1, [], 0
        if n:
            yield from _rows(messages(np.concatenate(held), _source(me, rounds), owners, bits), MESSAGE)

    def answer(batches):
        """Partitions are sorted by owner; holds one owner's messages."""
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["owner"] != now:
                    yield from _answered(held, owners, bits)
                    now, held = row["owner"], []
                held.append(row)
        yield from _answered(held, owners, bits)

    sent = read.mapInArrow(send, MESSAGE)
    shelves = 256
    answers = sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(answer, ANSWER)
    shelf = F.pmod(F.shiftright("src", 20), F.lit(shelves)).cast("int")
    answers.withColumn("shelf", shelf).repartition("shelf").sortWithinPartitions("shelf", "src").write.partitionBy("shelf").parquet(f"{home}/answers")

    marked = "rid long, doc_id long, text_key long, text_sha256 string, suspect boolean, text string"
    names = [x.split()[0] for x in marked.split(", ")]

    def mark(batches):
        from pyspark import TaskContext

        me, n, repeated = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if repeated is None:
                repeated = _known(f"{home}/answers/shelf={me % shelves}", me, owners, bits)
            ids = pa.array(range((me << 40) | n, ((me << 40) | n) + batch.num_rows), pa.int64())
            n += batch.num_rows
            hashes, suspects, texts = [], [], []
            for _, group in text_groups([batch]):
                for t in group:
                    digest = hashlib.sha256(normalised(t))
                    hashes.append(digest.hexdigest())
                    suspects.append(repeated.get(fingerprint(digest.digest(), bits), True))
                    texts.append(t if suspects[-1] else None)  # a unique text's bytes aren't needed any more
            yield pa.RecordBatch.from_arrays([ids, batch.column(0).cast(pa.int64()), batch.column(2), pa.array(hashes, pa.string()), pa.array(suspects, pa.bool_()), pa.array(texts, pa.string())], names=names)

    keyed = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("text_key"))
    rows = written(keyed.mapInArrow(mark, marked), f"{home}/rows")
    delete(spark, f"{home}/answers")
    unique = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "text_key")
    suspects = rows.filter("suspect")
    groups = suspects.groupBy(F.translate("text", UPPER, LOWER).alias("whole_text")).agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("sha"))
    groups = written(groups.select("sha", F.col("keep.doc_id").alias("keep_id"), F.col("keep.rid").alias("keep_rid"), "group_size"), f"{home}/groups")
    joined = suspects.drop("text").join(groups, F.col("text_sha256") == F.col("sha"))
    joined = joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "text_key")
    return unique.unionByName(joined)


def _rows(rows, schema: str):
    """Arrow batches of at most 256 rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _answered(held: list[dict], owners: int, bits: int):
    if not held:
        return
    values = [opened(r["owner"], r["n"], r["k"], r["payload"], owners, bits) for r in held]
    flags = [np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool) for r in held]
    every = np.sort(np.concatenate(values))
    several = np.unique(every[1:][every[1:] == every[:-1]])

    def rows():
        for r, v, f in zip(held, values, flags, strict=True):
            yield r["src"], r["owner"], r["n"], r["k"], r["payload"], r["repeated"], np.packbits(f | np.isin(v, several)).tobytes()

    yield from _rows(rows(), ANSWER)


def _known(uri: str, partition: int, owners: int, bits: int) -> dict[int, bool]:
    """Of the partition's own fingerprints: whether they stand more than once in the corpus."""
    import pyarrow.fs as pafs

    fs, folder = filesystem(uri)
    out: dict[int, bool] = {}
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if not info.path.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as source:
            low, high = _source(partition, 0), _source(partition + 1, 0)
            for row in pq.read_table(source, filters=[("src", ">=", low), ("src", "<", high)]).to_pylist():
                values = opened(row["owner"], row["n"], row["k"], row["payload"], owners, bits)
                found = np.unpackbits(np.frombuffer(row["found"], np.uint8), count=row["n"]).astype(bool)
                for v, f in zip(values.tolist(), found.tolist(), strict=True):
                    out[v] = out.get(v, False) or f
    return out


def op9_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole_text
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY whole_text) AS keep_id, count(*) OVER (PARTITION BY whole_text) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY whole_text) AS kept, sha256(whole_text) AS text_sha256
FROM t
"""
