"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is a row of data frames, one frame with the index of its documents, and the seek table of the public seekable
zstandard format (fixed values below): compressed size, decompressed size and checksum of every frame, then the number
of frames. A document lies in one frame whole, so a reader fetches the table, the index and the frames it needs.
Documents are in ascending order of id within a file, and files by their first id.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import col, fs_of, scratch, slices, staged, table

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids after which a frame is closed.
FRAME_BYTES = 1 << 20
LEVEL = 1


class Writer:
    """Writes one file; ids come as little-endian 32-bit integers and are stored in `width` bytes."""

    def __init__(self, stream, width: int = 4):
        import zstandard

        self.out, self.width = stream, width
        self.z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.n_ids = 0
        self.ids: list = []
        self.where: list[tuple[int, int, int]] = []

    def add(self, doc_id, ids: bytes) -> None:
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        n = len(ids) // self.width
        self.ids.append(doc_id)
        self.where.append((len(self.table), self.held // self.width, n))
        self.parts.append(ids)
        self.held += len(ids)
        self.n_ids += n
        if self.held >= FRAME_BYTES:
            self._frame()

    def _put(self, data: bytes) -> None:
        import xxhash

        packed = self.z.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _frame(self) -> None:
        if self.parts:
            self._put(b"".join(self.parts))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self._frame()
        index = pa.table({"id": pa.array(self.ids), **{k: pa.array([w[i] for w in self.where], pa.int64()) for i, k in enumerate(("frame", "start", "n"))}}).replace_schema_metadata({"width": str(self.width)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        self._put(sink.getvalue().to_pybytes())
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE))


class Reader:
    """Reads single documents, or all in order; every frame is held against its checksum."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = fs_of(uri)
        self.f, self.z = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self.f.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUM:
            raise ValueError(f"{uri} has no seek table with checksums")
        rows = self.f.read_at(12 * n, size - 9 - 12 * n)
        self.table = [struct.unpack_from("<III", rows, 12 * i) for i in range(n)]
        self.at = np.concatenate([[0], np.cumsum([t[0] for t in self.table])]).tolist()
        index = pa.ipc.open_stream(self.frame(n - 1)).read_all()
        self.width = int(index.schema.metadata[b"width"])
        self.ids, self.where = index["id"].to_pylist(), list(zip(*(index[k].to_pylist() for k in ("frame", "start", "n"))))
        self.place: dict = {}
        for i, d in enumerate(self.ids):
            self.place.setdefault(d, []).append(i)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, n, check = self.table[k]
        data = self.z.decompress(self.f.read_at(packed, self.at[k]), max_output_size=n)
        if len(data) != n or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def at_place(self, i: int) -> np.ndarray:
        k, start, n = self.where[i]
        if self.last[0] != k:
            self.last = (k, self.frame(k))
        w = self.width
        return np.frombuffer(self.last[1], "<u2" if w == 2 else "<u4", n, start * w).astype("<u4")

    def doc(self, doc_id, which: int = 0) -> np.ndarray:
        """The ids of a document; of several with one id, those of the which-th in the file."""
        return self.at_place(self.place[doc_id][which])

    def docs(self):
        for i, d in enumerate(self.ids):
            yield d, self.at_place(i)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encodes whole texts, appends end_id to each and writes files under folder; returns the manifest, a row a file.

    path, first (id), n_docs, n_ids, start (ids in all files before). Null and empty texts hold only the end; null ids
    come first; rows of one id stay together, in the order of their texts. A file gets its name only when it is whole,
    and a task that runs twice leaves one more file that no manifest names.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        c, w, name, first = codec(path), None, "", None
        for b in slices(batches, "text"):
            for d, ids in zip(col(b, "id").to_pylist(), c.encode_batch(col(b, "text").to_pylist())):
                if w is None:
                    name, first = f"{folder}/{uuid.uuid4().hex}.tokens", d
                    fs, place = fs_of(name)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    w = Writer(fs.open_output_stream(place + ".tmp"), 2 if len(c.bytes_of) <= 1 << 16 and end_id < 1 << 16 else 4)
                w.add(d, ids + struct.pack("<I", end_id))
        if w is not None:
            w.close()
            w.out.close()
            fs.move(place + ".tmp", place)
            yield pa.RecordBatch.from_pylist([{"path": name, "first": first, "n_docs": len(w.ids), "n_ids": w.n_ids}], schema=pa.schema([("path", pa.string()), ("first", id_type), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(src.schema["id"].dataType)
    parts = src.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    files = staged(parts.mapInArrow(run, f"path string, first {kind}, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Reads every file of a manifest: doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids."""
    kind = manifest.schema["first"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(manifest.schema["first"].dataType)
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for name, at in zip(col(b, "path").to_pylist(), col(b, "start").to_pylist()):
                rows: list[list] = [[], [], [], []]
                for d, ids in Reader(name).docs():
                    for r, v in zip(rows, (d, at, len(ids), zlib.crc32(ids.tobytes()))):
                        r.append(v)
                    at += len(ids)
                    if len(rows[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)
                        rows = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

    spread = manifest.select("path", "start").repartition(max(1, min(10_000, manifest.count())))
    return spread.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return read(write(docs, scratch(spark, "token-files")))
