"""Token ids in bit-plane files: fixed-size blocks, one zstandard frame per plane, a chunk index at the end.

File: MAGIC; the planes of each chunk, one after another; the index (JSON, zstandard) with block size,
plane kind, per chunk the number of ids, offset and length of each plane's frame, and per document its
id and number of ids; length of the index (8 bytes); MAGIC. A block's ids are transposed so that plane k
holds bit k (or byte k) of every id; bytes that are zero throughout a block have no planes.

Cases: a null text counts as empty and yields the end id alone; an empty table yields no file and no
rows; repeated ids and repeated rows are each kept, in order of a hash of the text, so that an id of very many
rows is split; other columns are ignored; a text of any length is cut into blocks while it is written, and a plane is read back one block at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import file_system, lean, shared_dir, slices, written
from tidegauge.llm.library_tokens import encoder, encoder_key

MAGIC = b"IDPLANE1"
BLOCK = 65_536


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of uint32 ids, least significant first; bytes that are zero in all ids have no planes."""
    width = -(-int(ids.max(initial=0)).bit_length() // 8)
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range(width)]
    planes = []
    for k in range(width):
        column = np.ascontiguousarray(rows[:, k])
        planes += [np.packbits(column & np.uint8(1 << b)).tobytes() for b in range(8)]
    return planes


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k in range(0, len(planes), 8):
            column = np.zeros(n, np.uint8)
            for b in range(8):
                column |= np.unpackbits(np.frombuffer(planes[k + b], np.uint8), count=n) << np.uint8(b)
            rows[:, k // 8] = column
    return rows.reshape(-1).view("<u4")


class PlaneWriter:
    """Appends documents' ids to an open binary stream."""

    def __init__(self, stream, kind: str = "bit", block: int = BLOCK, level: int = 3):
        self.stream, self.kind, self.block = stream, kind, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.pending, self.waiting, self.at = [], 0, len(MAGIC)
        self.chunks: list[list] = []
        self.docs: list[list] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids_le: bytes) -> None:
        self.docs.append([doc_id, len(ids_le) // 4])
        self.pending.append(ids_le)
        self.waiting += len(ids_le) // 4
        if self.waiting >= self.block:
            ids = np.frombuffer(b"".join(self.pending), "<u4")
            cut = len(ids) - len(ids) % self.block
            for i in range(0, cut, self.block):
                self._chunk(ids[i : i + self.block])
            self.pending, self.waiting = [ids[cut:].tobytes()], len(ids) - cut

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([len(ids), self.at, [len(f) for f in frames]])
        self.stream.write(b"".join(frames))
        self.at += sum(map(len, frames))

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.frombuffer(b"".join(self.pending), "<u4"))
        index = self.press.compress(json.dumps({"kind": self.kind, "block": self.block, "chunks": self.chunks, "docs": self.docs}).encode())
        self.stream.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.stream.close()


class PlaneReader:
    """Reads a file by its index; chunk(i) touches the bytes of that chunk alone."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("no id-plane file, or a truncated one")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        self.unpress = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unpress.decompress(source.read(n)))
        self.docs = self.index["docs"]

    def chunk(self, i: int) -> np.ndarray:
        n, at, lengths = self.index["chunks"][i]
        self.source.seek(at)
        data, planes, k = self.source.read(sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.unpress.decompress(data[k : k + length]))
            k += length
        return from_planes(planes, n, self.index["kind"])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and its ids as little-endian bytes; one block is in memory at a time."""
        have, at, k = memoryview(b""), 0, 0
        for doc_id, n in self.docs:
            parts, need = [], 4 * n
            while need > len(have) - at:
                parts.append(have[at:])
                need -= len(have) - at
                have, at, k = memoryview(self.chunk(k).tobytes()), 0, k + 1
            parts.append(have[at : at + need])
            at += need
            yield doc_id, b"".join(parts)


def write_id_files(docs: DataFrame, tokenizer: str, kind: str = "word", pattern: str = "", end_id: int = 2, planes: str = "bit", block: int = BLOCK, folder: str | None = None, file_ids: int = 1 << 26) -> DataFrame:
    """Encodes text of docs(doc_id, text) into files in ascending doc_id order, one or more per range of doc_id: the
    next one begins after about file_ids ids, which bounds the index that a task holds.

    Returns the manifest, itself a written table: part (order of the files), file (URI), n_docs, n_ids.
    A task that is run again writes another file; only files in the manifest count.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark) + "/ids"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, kind, pattern).encode, end_id.to_bytes(4, "little")
        part, out, n_ids = TaskContext.get().partitionId() << 32, None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{name}"], "n_docs": [len(out.docs)], "n_ids": [n_ids]})

        for batch in slices(batches, "text"):
            if out is None:
                files, path = file_system(folder)
                files.create_dir(path, recursive=True)
                name = f"{part:016x}-{uuid.uuid4().hex}.ids"
                out = PlaneWriter(files.open_output_stream(f"{path}/{name}"), planes, block)
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                out.add(doc_id, x + end)
                n_ids += len(x) // 4 + 1
            if n_ids >= file_ids:
                yield closed()
                part, out, n_ids = part + 1, None, 0
        if out is not None:
            yield closed()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return written(ordered.drop("h").mapInArrow(lean(write, encoder_key(tokenizer)), "part long, file string, n_docs long, n_ids long"), "manifest")


def read_id_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32) of every document."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per file, not per document
    files = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                files, path = file_system(name)
                rows, held = [], 0
                with files.open_input_file(path) as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 8_000_000 or len(rows) >= 5000:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return files.repartitionByRange(min(n, 4096), "part").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return read_id_files(write_id_files(docs, tokenizer, **options))


