"""Token-id files made of independent zstandard frames with a trailing seek table.

A file holds consecutive documents in ascending doc_id order.  Its layout is the public
seekable zstandard format with one more skippable frame for the document index:

* data frames, each the ids of whole documents (little-endian, 2 bytes when the vocabulary
  fits, else 4), closed at ``frame_bytes`` of ids;
* a skippable frame with the compressed document index: doc_id, frame, offset and length;
* a skippable frame with the seek table: compressed size, size and the low 32 bits of the
  xxh64 of every data frame, then the number of frames and the format's magic.

Plain zstandard tools read the ids; a reader of some documents fetches the two indexes and
decompresses only their frames, checking each frame's sum.

A text is cut at blanks and new lines, which no token spans, and each distinct piece is
encoded once by the tokenizer; the result is the encoding of the whole text.  A null text
is empty and still gets the end id; null ids come first; ties are ordered by the text's
hash.  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import new_folder, stage, text_key, worker_store
from pitsignal.shipping import ship_by_value

FRAME_BYTES = 1 << 20
MEMO_WORDS = 300_000  # distinct pieces a worker remembers, and as many that it remembered before
# Letters that are composed and lower-case one to one.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Fixed values of the public formats.
SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC = 0x184D2A5A, 0x184D2A5E, 0x8F92EAB1
_FOOTER, _SKIP = "<IBI", "<II"
_FOOTER_SIZE, _SKIP_SIZE = 9, 8
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def _letters(piece: str) -> bool:
    return piece.isalpha() if piece.isascii() else LETTERS.fullmatch(piece) is not None


def _little_array(code: str, ids: list[int]) -> array:
    out = array(code, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


class PieceMemo(dict):
    """Ids of blank-free pieces as bytes, each encoded once."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        described = self.tokenizer.to_str()
        # Runs of letters are pieces of their own, written in byte-level symbols: printable
        # bytes stand for themselves, the others for the code points from 256 on, in order.
        self.runs = all(part in described for part in ('"Lowercase"', r"[\\p{L}]+", '"ByteLevel"'))
        self.model = self.tokenizer.model
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.symbols = {b: 256 + i for i, b in enumerate(hidden)}
        self.plain, self.older = {}, {}
        self.code, self.pack = "H" if self.kind == "<u2" else "I", _little_array

    def _packed(self, ids: list[int]) -> bytes:
        return self.pack(self.code, ids).tobytes()

    def _run(self, piece: str) -> bytes:
        """Ids of one run of Latin letters or of one mark of punctuation."""
        piece = piece.lower()
        ids = self.plain.get(piece)
        if ids is None:
            if len(self.plain) >= MEMO_WORDS:
                self.plain.clear()
            # ASCII letters and marks are printable and stand for themselves.
            symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            ids = self.plain[piece] = self._packed([t.id for t in self.model.tokenize(symbols)])
        return ids

    def _ids(self, piece: str) -> bytes:
        if self.runs and _letters(piece):
            return self._run(piece)
        if self.runs and piece[-1:] in (".", ",") and _letters(piece[:-1]):
            return self._run(piece[:-1]) + self._run(piece[-1])
        return self._packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 64:
            return self._packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        ids = self.older.get(piece)
        if ids is None:
            ids = self._ids(piece)
        if len(self) >= MEMO_WORDS:
            # Pieces that are met again come back from here.
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


class FrameWriter:
    """Writes one file; ``add`` takes documents in order, ``close`` the indexes."""

    def __init__(self, sink, frame_bytes: int, level: int = 3) -> None:
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.parts: list[bytes] = []
        self.size, self.frames, self.docs = 0, [], []

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), self.size // width, len(ids) // width))
        self.parts.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        import xxhash

        data = b"".join(self.parts)
        packed = self.pack(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.parts, self.size = [], 0

    def close(self) -> None:
        if self.parts:
            self.flush()
        index = self.pack(np.array(self.docs, _DOC).tobytes())
        self.sink.write(struct.pack(_SKIP, SKIP_INDEX, len(index)) + index)
        seek = np.array(self.frames, _ENTRY).tobytes() + struct.pack(_FOOTER, len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack(_SKIP, SKIP_SEEK, len(seek)) + seek)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source, size: int, width: int) -> None:
        import zstandard

        self.source, self.dtype = source, f"<u{width}"
        self.unpack = zstandard.ZstdDecompressor().decompress
        count, _, magic = struct.unpack(_FOOTER, self._read(size - _FOOTER_SIZE, _FOOTER_SIZE))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = size - _FOOTER_SIZE - count * _ENTRY.itemsize
        self.frames = np.frombuffer(self._read(table, count * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        kind, length = struct.unpack(_SKIP, self._read(int(self.starts[-1]), _SKIP_SIZE))
        if kind != SKIP_INDEX:
            raise ValueError("no document index after the data")
        self.docs = np.frombuffer(self.unpack(self._read(int(self.starts[-1]) + _SKIP_SIZE, length)), _DOC)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        size = int(self.frames["size"][k])
        packed = self._read(int(self.starts[k]), int(self.frames["packed"][k]))
        data = self.unpack(packed, max_output_size=size) if size else b""
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.frames["check"][k]):
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, self.dtype)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, position in the file's ids, ids); only the wanted documents' frames are read."""
        held, ids, before = -1, None, np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])
        for i, (doc_id, known, k, offset, n) in enumerate(self.docs.tolist()):
            if wanted is not None and not (known and doc_id in wanted):
                continue
            if k != held:
                held, ids = k, self.frame(k)
            yield (doc_id if known else None), int(before[i]), ids[offset:offset + n]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_file: str, *, end_id: int | None = None, frame_bytes: int = FRAME_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode all texts into files under ``folder``; returns one manifest row per file.

    A file is written under its attempt's name and moved when complete, and its content
    depends on its rows only, so a repeated task leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo = worker_store("pieces", lambda: PieceMemo(tokenizer_file), tokenizer_file)
        width = int(memo.kind[2])
        end = b"" if end_id is None else np.array([end_id], memo.kind).tobytes()
        task = TaskContext.get()
        writer = sink = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    store, root = _store(folder)
                    store.create_dir(root, recursive=True)
                    name = f"tokens-{task.partitionId():06d}.zst"
                    part = f"{root}/.{name}-{task.taskAttemptId()}"
                    sink = store.open_output_stream(part, compression=None)
                    writer, total, rows = FrameWriter(sink, frame_bytes), 0, 0
                text = text.as_py()
                ids = (memo.encode(text) if text else b"") + end
                writer.add(doc_id, ids, width)
                total, rows = total + len(ids) // width, rows + 1
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"shard": [task.partitionId()], "file": [f"{folder}/{name}"], "n_docs": [rows], "n_tokens": [total],
                 "n_bytes": [size], "width": [width]},
                schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()),
                                  ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col))[0])
    dealt = rows.repartitionByRange("doc_id", "t1").sortWithinPartitions("doc_id", "t1").select("doc_id", "text")
    manifest = dealt.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long, n_bytes long, width int")
    return stage(manifest, "manifest")


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 from the files.

    ``doc_ids`` asks for some documents only; other frames are not decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["file"])
                with store.open_input_file(path) as source:
                    rows = []
                    for doc_id, at, ids in FrameReader(source, row["n_bytes"], row["width"]).documents(wanted):
                        rows.append((doc_id, row["first"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    files = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return placed.repartitionByRange(files, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer_file: str, *, end_id: int | None = None) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, new_folder(spark, "tokens"), tokenizer_file, end_id=end_id))


ship_by_value(__name__)
