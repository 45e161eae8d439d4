"""Files of token ids: independent zstandard frames, a document index, a trailing seek table.

A file is a run of zstandard frames, each with the ids of whole documents, then two skippable
frames: the index of documents (id, count, frame) and the seek table of the published seekable
format (compressed and decompressed size and checksum of each frame, then the footer). A reader
needs the tail of a file to find the frames of the documents that it wants, and decompresses those.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import documents, mapped, shared_path, slices, table

# Fixed values of the zstandard frame format and its seekable variant.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
END = 2
#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
NO_ID = -(1 << 63)  # stands for a null doc_id in the index


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class Writer:
    """Writes documents in the given order; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, out, level: int = 3):
        import xxhash
        import zstandard

        self.out, self.compress, self.sum = out, zstandard.ZstdCompressor(level=level).compress, lambda b: xxhash.xxh64_intdigest(b) & 0xFFFFFFFF
        self.open, self.size, self.frames, self.docs = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > 4 * FRAME_IDS:
            self._close_frame()
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), self.sum(raw)))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        index = self.compress(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 8) + index + struct.pack("<II", len(index), zlib.crc32(index)))
        seek = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + 9) + seek + struct.pack("<IBI", len(self.frames), WITH_CHECKSUM, SEEKABLE_MAGIC))


class Reader:
    """Reads the documents of one file, all or some, decompressing only their frames."""

    def __init__(self, file):
        import xxhash
        import zstandard

        self.file, self.expand, self.sum = file, zstandard.ZstdDecompressor().decompress, lambda b: xxhash.xxh64_intdigest(b) & 0xFFFFFFFF
        size = file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUM:
            raise ValueError("not a token file")
        seek_at = size - 9 - 12 * frames
        table = np.frombuffer(self._at(seek_at, 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.sums = table[:, 1], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        tail = seek_at - 8
        length, check = struct.unpack("<II", self._at(tail - 8, 8))
        index = self._at(tail - 8 - length, length)
        if zlib.crc32(index) != check:
            raise ValueError("the index of documents is damaged")
        self.docs = np.frombuffer(self.expand(index), dtype="<i8").reshape(-1, 3)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(size))

    def frame(self, k: int) -> bytes:
        raw = self.expand(self._at(self.starts[k], self.starts[k + 1] - self.starts[k]), max_output_size=int(self.sizes[k]))
        if self.sum(raw) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, wanted: set | None = None):
        """(doc_id, ids as bytes) in the order of the file."""
        for k in range(len(self.sizes)):
            rows = self.docs[np.searchsorted(self.docs[:, 2], k) : np.searchsorted(self.docs[:, 2], k, "right")]
            if wanted is not None and not wanted.intersection(rows[:, 0].tolist()):
                continue
            raw, at = self.frame(k), 0
            for doc_id, n, _ in rows.tolist():
                if wanted is None or doc_id in wanted:
                    yield (None if doc_id == NO_ID else doc_id), raw[at : at + 4 * n]
                at += 4 * n


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Writes files in ascending doc_id order; returns the manifest: part, path, n_docs, n_ids.

    A file's name holds the attempt that wrote it and only the manifest names files, so attempts that
    failed leave nothing that is read. Null text: the end id alone. Null doc_ids come first; rows of one
    doc_id follow one another by the hash of their text, and each has a place of its own.
    """

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.tok.zst"
        last = np.array([end], dtype="<u4").tobytes()
        writer, n_docs, n_ids = None, 0, 0
        for batch in batches:
            for part in slices(batch, 4_000_000):
                if writer is None:
                    fs, where = file_system(path)
                    fs.create_dir(where.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(where, compression=None)
                    writer = Writer(out)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), Encoder.of(tokenizer, False).encode([t or "" for t in part.column("text").to_pylist()])):
                    writer.add(doc_id, ids + last)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "path": path, "n_docs": n_docs, "n_ids": n_ids}])

    # Rows of one doc_id are told apart by their text, so that many such rows spread over tasks too.
    order = ["doc_id", F.xxhash64("text")]
    manifest = mapped(documents(docs).repartitionByRange(*order).sortWithinPartitions(*order), put, "part long, path string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    # One row a file: the running sum is over files, not documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start")

    def get(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, where = file_system(path)
                with fs.open_input_file(where) as f:
                    rows = []
                    for doc_id, ids in Reader(f).read():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A task for each file; a number that is given is not merged into fewer.
    spread = files.repartitionByRange(max(1, manifest.count()), "start", "path")
    return mapped(spread, get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), word_tokenizer(), shared_path(spark, "tokens")))
