"""Token files: fixed blocks of ids, transposed into planes, each compressed by zstandard.

A file is a mark, the planes of one block after the other, a footer and the footer's
length. A block is `block` ids (fewer at the end) as little-endian 32-bit integers; its
byte planes are their first bytes, second bytes and so on, its bit planes their single
bits; planes of zeros take no space. The footer is the chunk index (where each block's
planes begin and their sizes) and the documents in the file (id, whether it is null, ids).

Documents are dealt out to tasks by ranges of their ids and sorted, so files follow one
another in id order. A task streams its texts into files of about `file_ids` ids under
names of its own; only the names in the written manifest count, so files of lost or
repeated tasks are never read. Files are read back block by block.

Defined cases: a null or empty text is its end id alone; null ids come first; rows of equal
ids are written once each, in any order among themselves; a text longer than a block or a
file is written whole; an empty table gives no files and no rows. Ids that are no whole numbers,
and folders that Arrow doesn't reach, are refused before any work. Columns of the input other
than those named are not looked at.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted
from .storage import shared_folder, ship, written
from .texts import pieces
from .tokens import encoder

MARK = b"IDPLANE1"


@dataclass(frozen=True)
class FileFormat:
    """unit: 'bytes' or 'bits'."""

    block: int = 1 << 16
    unit: str = "bytes"
    level: int = 3
    file_ids: int = 1 << 22


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes from the lowest; trailing planes of zeros are left out."""
    if unit == "bytes":
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        out = [p.tobytes() if p.any() else b"" for p in planes]
    else:
        out = []
        for bit in range(int(ids.max()).bit_length() if len(ids) else 0):
            out.append(np.packbits((ids >> np.uint32(bit)).astype(np.uint8) & 1).tobytes())
    while out and not out[-1]:
        out.pop()
    return out


def from_planes(planes: list[bytes], count: int, unit: str) -> np.ndarray:
    if unit == "bytes":
        out = np.zeros((count, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                out[:, k] = np.frombuffer(plane, dtype=np.uint8)
        return out.view("<u4").ravel()
    out = np.zeros(count, dtype=np.uint32)
    for bit, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=count).astype(np.uint32) << np.uint32(bit)
    return out


class FileWriter:
    """Writes one file; ids may come in stretches of any size."""

    def __init__(self, stream, form: FileFormat):
        self._stream, self._form = stream, form
        self._zip = zstandard.ZstdCompressor(level=form.level)
        self._waiting: list[bytes] = []
        self._size = 0
        self._at = len(MARK)
        self._index: list[list[int]] = []
        self._docs: list[tuple[int | None, int]] = []
        self.ids = 0
        stream.write(MARK)

    @property
    def documents(self) -> int:
        return len(self._docs)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id, len(ids) // 4))
        self.ids += len(ids) // 4
        self._waiting.append(ids)
        self._size += len(ids) // 4
        if self._size >= self._form.block:
            joined = b"".join(self._waiting)
            step = 4 * self._form.block
            whole = len(joined) // step * step
            for begin in range(0, whole, step):
                self._block(joined[begin : begin + step])
            self._waiting, self._size = [joined[whole:]], (len(joined) - whole) // 4

    def _block(self, ids: bytes) -> None:
        planes = [self._zip.compress(p) if p else b"" for p in to_planes(np.frombuffer(ids, dtype="<u4"), self._form.unit)]
        self._stream.write(b"".join(planes))
        sizes = [len(p) for p in planes]
        self._index.append([self._at, len(ids) // 4, *sizes])
        self._at += sum(sizes)

    def close(self) -> None:
        if self._size:
            self._block(b"".join(self._waiting))
        keys = np.array([d or 0 for d, _ in self._docs], dtype="<i8")
        nulls = np.array([d is None for d, _ in self._docs], dtype=np.uint8)
        sizes = np.array([n for _, n in self._docs], dtype="<i8")
        head = json.dumps({"unit": self._form.unit, "documents": len(self._docs), "chunks": self._index}).encode()
        footer = self._zip.compress(struct.pack("<q", len(head)) + head + keys.tobytes() + nulls.tobytes() + sizes.tobytes())
        self._stream.write(footer + struct.pack("<q", len(footer)))
        self._stream.close()


class FileReader:
    """Reads one file through its index."""

    def __init__(self, stream):
        self._stream, self._zip = stream, zstandard.ZstdDecompressor()
        size = stream.size()
        if stream.read_at(len(MARK), 0) != MARK:
            raise ValueError("not a token file")
        (length,) = struct.unpack("<q", stream.read_at(8, size - 8))
        raw = self._zip.decompress(stream.read_at(length, size - 8 - length))
        (length,) = struct.unpack("<q", raw[:8])
        head = json.loads(raw[8 : 8 + length])
        self.unit, self.chunks, count = head["unit"], head["chunks"], head["documents"]
        at = 8 + length
        keys = np.frombuffer(raw, dtype="<i8", count=count, offset=at)
        nulls = np.frombuffer(raw, dtype=np.uint8, count=count, offset=at + 8 * count)
        self.keys = [None if null else key for key, null in zip(keys.tolist(), nulls.tolist())]
        self.sizes = np.frombuffer(raw, dtype="<i8", count=count, offset=at + 9 * count)

    def chunk(self, number: int) -> np.ndarray:
        at, count, *sizes = self.chunks[number]
        raw = self._stream.read_at(sum(sizes), at)
        planes, begin = [], 0
        for size in sizes:
            planes.append(self._zip.decompress(raw[begin : begin + size]) if size else b"")
            begin += size
        return from_planes(planes, count, self.unit)

    def documents(self):
        """doc_id, ids before it in the file, ids as bytes; one document in memory at a time."""
        number, held, start = 0, b"", 0
        for key, size in zip(self.keys, self.sizes.tolist()):
            parts, have = [held], len(held)
            while have < 4 * size:
                more = self.chunk(number).tobytes()
                number += 1
                parts.append(more)
                have += len(more)
            joined = b"".join(parts)
            yield key, start, joined[: 4 * size]
            held = joined[4 * size :]
            start += size


#: Names under which Hadoop knows stores that Arrow knows under others.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    scheme, rest = folder.split(":", 1)
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except pa.ArrowException as error:
        raise ValueError(f"files can't be kept under {folder}: Arrow reaches local folders, s3, gs, abfs and hdfs ({error})") from error


def write_files(documents: DataFrame, tokenizer: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text", form: FileFormat | None = None) -> DataFrame:
    """Write the files below `folder`; returns the manifest: part, number, path, ids, base."""
    form = form or FileFormat()
    _file_system(folder)  # fails here where it can't be reached
    if not isinstance(documents.schema[key].dataType, T.IntegralType):
        raise ValueError(f"ids in files are whole numbers, {key} is {documents.schema[key].dataType.simpleString()}")
    ship(documents.sparkSession)
    rows = documents.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text"))
    # The row number splits ids that many rows share over the ranges.
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("key", "row").sortWithinPartitions("key", "row")

    def run(batches):
        from pyspark import TaskContext

        part, number, writer, path = TaskContext.get().partitionId(), 0, None, ""
        system, root = _file_system(folder)
        own = encoder(tokenizer)

        def manifest():
            writer.close()
            columns = [[part], [number], [path], [writer.documents], [writer.ids]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "number", "path", "documents", "ids"])

        for batch in batches:
            keys = batch["key"].to_pylist()
            for piece in pieces(batch["text"]):
                ids, sizes = own.encode(piece, end_id)
                ends = np.cumsum(sizes).tolist()
                for doc_id, begin, end in zip(keys[piece.row :], [0, *ends], ends):
                    if writer is None:
                        path = f"{root}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.idp"
                        system.create_dir(root, recursive=True)
                        writer = FileWriter(system.open_output_stream(path), form)
                    writer.add(doc_id, ids[begin:end].tobytes())
                    if writer.ids >= form.file_ids:
                        yield manifest()
                        writer, number = None, number + 1
        if writer is not None:
            yield manifest()

    found = written(rows.select("key", "text").mapInArrow(run, "part int, number int, path string, documents long, ids long"))
    # One row per file of some million ids.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32."""
    files = max(1, manifest.count())
    spread = manifest.select("path", "base").repartition(min(files, 10_000))

    def run(batches):
        system, _ = _file_system(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                with system.open_input_file(path) as stream:
                    rows = [(key, base + start, len(ids) // 4, zlib.crc32(ids)) for key, start, ids in FileReader(stream).documents()]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(documents: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", form: FileFormat | None = None) -> DataFrame:
    """Write all documents and read the files back."""
    folder = shared_folder(documents.sparkSession)
    return read_files(write_files(documents, tokenizer, folder, end_id, key, text, form), folder)
