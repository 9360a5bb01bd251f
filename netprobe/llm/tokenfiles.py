"""Token ids in files of fixed-width bit packing.

A file holds ids in as many bits as the vocabulary needs. Layout: 16 bytes of head (magic, version,
bits, ids in a block); blocks of ``BLOCK`` ids, each packed from its lowest bit on and ending on a
byte; the offsets of the blocks (u64); doc ids (i64) and whether they are null (u8); each document's
first id (u64, one more than documents); 24 bytes of tail (number of ids, blocks, documents). A reader
unpacks any run of blocks with numpy, so any document is read alone.

Files are dealt out by ranges of doc_id, each sorted, so their order is that of the documents.

Defined results: null or empty texts are the end id alone; rows without a doc_id come first; rows of
one doc_id follow one another in the order of their texts; an empty table gives no file; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.llm.common import materialize, new_path, slices
from netprobe.llm.tokens import encoder, vocabulary_path

BLOCK, END_ID = 4096, 2
_HEAD, _TAIL = struct.Struct("<4sHHII"), struct.Struct("<QQQ")
_MAGIC, _VERSION = b"NPTK", 1
_SOME_IDS = 1 << 20


def bits_for(size: int) -> int:
    """The least number of bits that hold ids below ``size``."""
    return max(1, int(size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class Writer:
    """Writes one file; ids may come in runs of any length."""

    def __init__(self, stream: pa.NativeFile, bits: int) -> None:
        self.stream, self.bits = stream, bits
        self.pending, self.n_pending, self.n_ids = [], 0, 0
        self.offsets: list[int] = []
        self.starts, self.docs, self.nulls = [np.zeros(1, np.uint64)], [], []
        stream.write(_HEAD.pack(_MAGIC, _VERSION, bits, BLOCK, 0))
        self.at = _HEAD.size

    def add(self, docs: pa.Array, ids: np.ndarray, begins: np.ndarray) -> None:
        """Documents' ids, one after another; ``begins`` has one more than documents."""
        self.docs.append(docs.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.starts.append((begins[1:] + self.n_ids).astype(np.uint64))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= BLOCK:
            self._flush(self.n_pending // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending)
        for i in range(0, n, BLOCK):
            data = pack_bits(ids[i : min(i + BLOCK, n)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.pending, self.n_pending = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_pending:
            self._flush(self.n_pending)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        nulls = np.concatenate(self.nulls) if self.nulls else np.zeros(0, np.uint8)
        for part in (np.array(self.offsets, "<u8"), docs.astype("<i8"), nulls, np.concatenate(self.starts).astype("<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(_TAIL.pack(self.n_ids, len(self.offsets), len(docs)))


class Reader:
    """The index of one file, and its ids from any place on."""

    def __init__(self, path: str) -> None:
        files, own = filesystem(path)
        self.file = files.open_input_file(own)
        size = self.file.size()
        magic, version, self.bits, self.block, _ = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if (magic, version) != (_MAGIC, _VERSION):
            raise ValueError(f"{path} is no file of token ids")
        self.n_ids, n_blocks, n_docs = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        widths = [8 * n_blocks, 8 * n_docs, n_docs, 8 * (n_docs + 1)]
        at = size - _TAIL.size - sum(widths)
        self.end = at
        parts = []
        for width in widths:
            parts.append(self.file.read_at(width, at))
            at += width
        self.offsets, self.docs = np.frombuffer(parts[0], "<u8").astype(np.int64), np.frombuffer(parts[1], "<i8")
        self.nulls, self.starts = np.frombuffer(parts[2], np.uint8).astype(bool), np.frombuffer(parts[3], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, as uint32."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        out = unpack_bits(self.file.read_at(end - begin, begin), n, self.bits)
        return out[start - first * self.block : stop - first * self.block]

    def document(self, row: int) -> np.ndarray:
        return self.ids(self.starts[row], self.starts[row + 1])


def write_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents under ``path``; returns the files: part, file, n_docs, n_ids.

    A task that runs again writes another file; only the files returned here count."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        files, base = filesystem(path)
        part = TaskContext.get().partitionId()
        name, writer, stream = f"part-{part:06d}-{uuid.uuid4().hex}.ids", None, None
        for batch in batches:
            for rows in slices(batch):
                if writer is None:
                    files.create_dir(base)
                    stream = files.open_output_stream(f"{base}/.{name}")
                    writer = Writer(stream, bits_for(encode.size))
                ids, begins = encode.encode(rows.column("text"))
                writer.add(rows.column("doc_id"), np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins)))
        if writer is None:
            return
        writer.close()
        stream.close()
        files.move(f"{base}/.{name}", f"{base}/{name}")
        n_docs = sum(map(len, writer.docs))
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{path}/{name}"], "n_docs": [n_docs], "n_ids": [writer.n_ids]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "id-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, row = Reader(file), 0
                while row < len(reader.docs):
                    first = int(reader.starts[row])
                    end = max(row + 1, int(np.searchsorted(reader.starts, first + _SOME_IDS, "right")) - 1)
                    ids = reader.ids(first, int(reader.starts[end])).astype("<u4")
                    at = reader.starts[row : end + 1] - first
                    sums = [zlib.crc32(ids[b:e]) for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    doc = pa.array(reader.docs[row:end], pa.int64(), mask=reader.nulls[row:end])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(reader.starts[row:end] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    row = end

    spread = placed.select("file", "base").repartition("file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame) -> DataFrame:
    return read_files(write_files(docs, new_path(docs.sparkSession, "ids")))
