"""Token-id files: fixed-size id blocks as zstandard-compressed byte or bit planes, with a chunk index.

A file is: magic, the compressed planes of each chunk one after another, the document index, the chunk index, and a
footer with the places of both. A chunk holds ``block`` ids (the last may hold fewer); plane k of a byte-plane chunk is
byte k of every id, plane k of a bit-plane chunk is bit k of every id, eight to a byte.

Cases: a null text counts as empty and holds the end id alone; an empty table makes no file; repeated rows are written
each for itself; documents with one doc_id stand in the order of their text's hash and then their text; rows without a
doc_id come first; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import CACHE_ALONE, text_groups, tokenizer_encoder
from .work import columns, filesystem, work_dir, written

MAGIC = b"PMPLANE1"
FOOTER = struct.Struct("<QQQQ8s")  # document index: offset, bytes; chunk index: offset, bytes; magic
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; trailing planes of zeros are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    if kind == "byte":
        planes = [np.ascontiguousarray(ids.view(np.uint8)[k::4]) for k in range(4)]
    else:
        planes = [np.packbits(((ids >> k) & 1).astype(np.uint8)) for k in range(32)]
    while planes and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, "<u4")
    if kind == "byte":
        view = out.view(np.uint8)
        for k, p in enumerate(planes):
            view[k::4] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class PlaneWriter:
    """Writes one file as a stream; holds one block of ids and 16 bytes for each document."""

    def __init__(self, sink, block: int = 65536, kind: str = "byte", level: int = 3) -> None:
        self.sink, self.block, self.kind = sink, block, kind
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.chunks: list[tuple] = []
        self.docs: list[tuple[int, int]] = []
        self.at = sink.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0, ~len(ids)) if doc_id is None else (doc_id, len(ids)))  # a count below zero: no doc_id
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._chunk(flat[k : k + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        offset = self.at
        sizes = [self._put(self.packer.compress(p)) for p in to_planes(ids, self.kind)]
        self.chunks.append((offset, self.n_ids, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), sizes))
        self.n_ids += len(ids)

    def close(self) -> int:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        docs = self.packer.compress(np.array(self.docs, "<i8").tobytes())
        index = bytearray(struct.pack("<4sIQQ", self.kind.encode(), self.block, len(self.docs), len(self.chunks)))
        for offset, first, n, crc, sizes in self.chunks:
            index += struct.pack("<QQIIB", offset, first, n, crc, len(sizes)) + struct.pack(f"<{len(sizes)}I", *sizes)
        place = (self.at, self._put(docs), self.at, self._put(bytes(index)))
        # the tuple is built from left to right: each offset is taken before what it points to is written
        self._put(FOOTER.pack(*place, MAGIC))
        return self.at


class PlaneReader:
    """Random access by chunk to a file of ``PlaneWriter``."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        *place, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file")
        self.unpacker = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpacker.decompress(self._get(place[0], place[1])), "<i8").reshape(-1, 2)
        index = self._get(place[2], place[3])
        kind, self.block, n_docs, n_chunks = struct.unpack_from("<4sIQQ", index)
        self.kind, at, self.chunks = kind.rstrip(b"\0").decode(), 24, []
        for _ in range(n_chunks):
            *head, n_planes = struct.unpack_from("<QQIIB", index, at)
            sizes = struct.unpack_from(f"<{n_planes}I", index, at + 25)
            self.chunks.append((*head, sizes))
            at += 25 + 4 * n_planes
        if n_docs != len(self.docs):
            raise ValueError("the document index is damaged")

    def _get(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        offset, _, n, crc, sizes = self.chunks[k]
        data, planes, at = self._get(offset, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.unpacker.decompress(data[at : at + size]))
            at += size
        ids = from_planes(planes, n, self.kind)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, first id's place in the file, its ids in parts), one chunk in memory at a time and the parts."""
        held, chunk, start = np.zeros(0, "<u4"), 0, 0
        for doc_id, n in self.docs.tolist():
            if n < 0:
                doc_id, n = None, ~n
            parts, need = [], n
            while need:
                if not len(held):
                    held, chunk = self.chunk(chunk), chunk + 1
                parts.append(held[:need])
                held, need = held[need:], need - len(parts[-1])
            yield doc_id, start, parts
            start += n


def write_planes(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, block: int = 65536, kind: str = "byte") -> DataFrame:
    """Encodes (doc_id, text) and writes a file for each range of doc_ids; returns the written manifest.

    Files are written under another name and then renamed, so that a task that is run again replaces its own file.
    """

    def shard(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encode, fs_path = tokenizer_encoder(tokenizer, cache=CACHE_ALONE), None
        end = np.array([end_id], np.uint32)
        for ids, texts in text_groups(batches):
            if fs_path is None:
                fs, folder = filesystem(out)
                fs.create_dir(folder, recursive=True)
                fs_path = f"{folder}/shard-{number:08d}.planes"
                hidden = f"{folder}/_{uuid.uuid4().hex}"
                sink = fs.open_output_stream(hidden)
                writer = PlaneWriter(sink, block, kind)
            for doc_id, found in zip(ids, encode(texts), strict=True):
                writer.add(doc_id, np.concatenate([found, end]))
        if fs_path is not None:
            n_bytes = writer.close()
            sink.close()
            fs.move(hidden, fs_path)
            row = {"shard": [number], "path": [fs_path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_ids], "n_bytes": [n_bytes]}
            yield pa.RecordBatch.from_pydict(row)

    tie = F.xxhash64("text")
    ordered = columns(docs, "doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return written(ordered.mapInArrow(shard, MANIFEST), out + "-manifest")


def read_planes(manifest: DataFrame, out: str) -> DataFrame:
    """Reads the files back: for each document its place among all ids, its count and the crc32 of its ids."""

    def read(batches):
        fs, _ = filesystem(out)
        for batch in batches:
            for shard, path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as source:
                    rows: list[list] = [[], [], [], [], []]
                    for doc_id, start, parts in PlaneReader(source).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(np.ascontiguousarray(part, "<u4"), crc)
                        for column, x in zip(rows, (doc_id, before + start, sum(map(len, parts)), crc, shard), strict=True):
                            column.append(x)
                        if len(rows[0]) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=NAMES)
                            rows = [[], [], [], [], []]
                    if rows[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=NAMES)

    # a row for each file, however many documents it holds; each task gets one file and the count of ids before it
    before = (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before")
    return manifest.select("shard", "path", before).repartition(max(1, manifest.count())).mapInArrow(read, READ)


NAMES = [x.split()[0] for x in READ.split(", ")]


def op1_bit_planes(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = work_dir(spark, "planes")
    manifest = write_planes(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, out)
    return read_planes(manifest, out)
