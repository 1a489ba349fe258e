"""Token ids in seekable zstandard files.

A file holds data frames of at most ``FRAME_IDS`` little-endian uint32 ids,
each an independent zstandard frame; then a skippable frame with the
document index (ids, lengths and null marks of the file's documents); then the seek
table of the public seekable format: one entry a frame (compressed size,
size, low 32 bits of the XXH64 of the content) and a footer. A reader fetches
the tail of the file, finds a document in the index and decompresses only the
frames that it touches; a plain zstandard reader skips both tables.

Null texts count as empty; a document without text is its end id alone.
Documents go out in ascending id, null ids first; rows of equal id stay, in the
order of a hash of their texts, so that they can be dealt to several files.
Very long texts go out frame by frame. Extra columns are ignored. An empty
table makes no file.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglake.llm import _bpe
from filinglake.llm._shared import fresh_path, staged

FRAME_IDS = 1 << 16
INDEX_MAGIC = 0x184D2A50  # first of the skippable-frame magics
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
MANIFEST = "file string, first_id long, first_hash long, n_docs long, n_ids long, n_bytes long"


def _fs(uri: str):
    """A pyarrow filesystem and the path in it; covers local, shared and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes one file; memory holds one frame and the index of the file's documents."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []
        self.n_bytes = 0

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.n_bytes += len(raw)

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.zip.compress(raw)
        self._put(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        raw = ids.astype("<u4", copy=False).tobytes()
        room = FRAME_IDS - self.held_ids
        while len(raw) >= 4 * room:
            self.held.append(raw[: 4 * room])
            self._frame(b"".join(self.held))
            self.held, self.held_ids, raw, room = [], 0, raw[4 * room :], FRAME_IDS
        if raw:
            self.held.append(raw)
            self.held_ids += len(raw) // 4

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
        index = self.zip.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + bytes(self.nulls))
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), 0x80, FOOTER_MAGIC))


class TokenFileReader:
    """Random access to one file: ``documents()`` streams, ``document(k)`` reads the k-th alone."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("not a seekable token file")
        at = size - 9 - 12 * n - 8
        self.entries = np.frombuffer(self._read(at + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.frame_ids = np.concatenate([[0], np.cumsum(self.entries[:, 1] // 4)])
        begin = int(self.starts[-1])
        raw = self.unzip.decompress(self._read(begin + 8, at - begin - 8))
        n = len(raw) // 17  # bytes of a document: id, length, null mark
        self.doc_ids = [None if null else i for i, null in zip(np.frombuffer(raw, "<i8", n).tolist(), raw[16 * n :])]
        self.lengths = np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, check = self.entries[k]
        raw = self.unzip.decompress(self._read(self.starts[k], packed), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def pieces(self, k: int, load=None) -> Iterator[bytes]:
        """Bytes of document k, frame by frame."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        f = int(np.searchsorted(self.frame_ids, a, "right")) - 1
        while a < b:
            lo, hi = int(self.frame_ids[f]), int(self.frame_ids[f + 1])
            yield (load or self.frame)(f)[4 * (a - lo) : 4 * (min(b, hi) - lo)]
            a, f = hi, f + 1

    def document(self, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(k)), "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, Iterable[bytes]]]:
        """(doc_id, ids before it in the file, pieces) in order; each frame is read once."""
        held = (-1, b"")

        def load(f: int) -> bytes:
            nonlocal held
            if held[0] != f:
                held = (f, self.frame(f))
            return held[1]

        for k, d in enumerate(self.doc_ids):
            yield d, int(self.offsets[k]), self.pieces(k, load)


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, eos_id: int = 2) -> DataFrame:
    """Encode every document, write files of ascending id ranges under ``path``, return the manifest.

    Each task writes to a name of its own, and only files named in the written
    manifest count, so a task that runs twice leaves at most an unread file.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    tokenizer = tokenizer or _bpe.default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(tokenizer)
        end = np.array([eos_id], "<u4")
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        name, sink, out, total = f"{uuid.uuid4().hex}.zst", None, None, 0
        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if out is None:
                    sink = fs.open_output_stream(posixpath.join(root, name), compression=None)
                    out, first, first_mark = TokenFileWriter(sink), doc_id, mark
                ids = np.concatenate([enc.encode(text.as_py() or ""), end])
                total += len(ids)
                out.add(doc_id, ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "first_id": pa.array([first], pa.int64()), "first_hash": pa.array([first_mark], pa.int64()), "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([total], pa.int64()), "n_bytes": pa.array([out.n_bytes], pa.int64())}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark"), F.col(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.col("_mark")]  # the hash deals rows without an id to many files
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text")
    files = staged(dealt.mapInArrow(encode, MANIFEST), "token-manifest")
    return files.withColumn("path", F.lit(path))


def read(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the running sum is
    over files, not documents.
    """
    spark = manifest.sparkSession
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = _fs(row["path"])
                out: tuple[list, list, list, list] = ([], [], [], [])
                with fs.open_input_file(posixpath.join(root, row["file"])) as source:
                    for doc_id, at, pieces in TokenFileReader(source, row["n_bytes"]).documents():
                        crc, n = 0, 0
                        for raw in pieces:
                            crc, n = zlib.crc32(raw, crc), n + len(raw) // 4
                        for column, v in zip(out, (doc_id, row["start"] + at, n, crc)):
                            column.append(v)
                        if len(out[0]) == 20_000:
                            yield _batch(out)
                            out = ([], [], [], [])
                if out[0]:
                    yield _batch(out)

    def _batch(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(width).mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")
