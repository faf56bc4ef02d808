"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, pick, stored, text_slices
from .words import library_encoder, tokenizer_path

MAGIC = b"DACFILE1"
#: Bits of a continuation bitmap per entry of its rank directory.
RANK_BITS = 512
#: A file is closed beyond this many tokens, which bounds a writer's memory.
FILE_TOKENS = 8_000_000
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits each, little end first."""
    v = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    v[: len(values)] = values
    v = v.reshape(-1, 8)
    out = np.zeros((len(v), width), np.uint8)
    for j in range(8):
        at, shift = divmod(j * width, 8)
        x = v[:, j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, at + k] |= (x >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def level_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths that take the least space for these ids: shortest path over the bit positions where a level may end."""
    top = max(1, int(ids.max(initial=1)).bit_length())
    more = [len(ids)] + [int((ids >> s).astype(bool).sum()) for s in range(1, top)]  # ids that need more than s bits
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * top
    for end in range(1, top + 1):
        for start in range(end):
            rank = 0 if end == top else 1 + 32 / RANK_BITS
            cost = best[start][0] + more[start] * (end - start + rank)
            if cost < best[end][0]:
                best[end] = cost, [*best[start][1], end - start]
    return best[top][1]


def write_codes(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The bytes of one file: header, documents, then for each level its chunks, continuation bitmap and rank directory."""
    widths = level_widths(ids)
    parts = [MAGIC, struct.pack("<IIQQ", 1, len(widths), len(ids), len(doc_ids)), bytes(widths).ljust(32, b"\0")]
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids),
              np.cumsum(lengths).astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for level, w in enumerate(widths):
        chunks = pack(rest & np.uint32((1 << w) - 1), w)
        bitmap = ranks = b""
        if level < len(widths) - 1:
            rest = rest >> np.uint32(w)
            goes_on = rest > 0
            bits = np.packbits(goes_on, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
            counts = _BITS[bits].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
            bitmap, ranks = bits.tobytes(), (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes()
            rest = rest[goes_on]
        parts += [struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)), chunks, bitmap, ranks]
    return b"".join(parts)


class CodeFile:
    """Reads a file by position: `token` touches a few bytes of each level, `tokens` decodes a stretch."""

    def __init__(self, source):
        """source: a seekable binary file (a local or remote one of pyarrow, or io.BytesIO)."""
        self.source = source
        head = self._read(0, 64)
        if head[:8] != MAGIC:
            raise ValueError("not a file of token codes")
        _, levels, self.n_tokens, self.n_docs = struct.unpack_from("<IIQQ", head, 8)
        self.widths = list(head[32 : 32 + levels])
        at = self._docs_at = 64
        at += 17 * self.n_docs
        self._levels = []
        for w in self.widths:
            a, b, c = struct.unpack("<QQQ", self._read(at, 24))
            self._levels.append((w, at + 24, at + 24 + a, at + 24 + a + b))
            at += 24 + a + b + c

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    @cached_property
    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and where each one's tokens end."""
        n, raw = self.n_docs, self._read(self._docs_at, 17 * self.n_docs)
        null = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        ids = np.frombuffer(raw, "<i8", n)
        return [None if z else int(x) for x, z in zip(ids, null, strict=True)], np.frombuffer(raw[9 * n :], "<u8").astype(np.int64)

    def _rank(self, bitmap_at: int, ranks_at: int, i: int) -> int:
        """Set bits before position i."""
        block, within = divmod(i, RANK_BITS)
        bits = np.frombuffer(self._read(bitmap_at + block * RANK_BITS // 8, within // 8 + 1), np.uint8).copy()
        if not len(bits):  # i is the end of a full bitmap
            block, within = block - 1, RANK_BITS
            bits = np.frombuffer(self._read(bitmap_at + block * RANK_BITS // 8, RANK_BITS // 8), np.uint8).copy()
        elif within // 8 < len(bits):
            bits[within // 8] &= (1 << within % 8) - 1
        base = struct.unpack("<I", self._read(ranks_at + 4 * block, 4))[0]
        return base + int(_BITS[bits].sum())

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, (w, chunks, bitmap, ranks) in enumerate(self._levels):
            at, off = divmod(i * w, 8)
            value |= ((int.from_bytes(self._read(chunks + at, (off + w + 7) // 8), "little") >> off) & ((1 << w) - 1)) << shift
            if level == len(self._levels) - 1 or not self._read(bitmap + i // 8, 1)[0] >> i % 8 & 1:
                break
            i, shift = self._rank(bitmap, ranks, i), shift + w
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi."""
        out = np.zeros(hi - lo, np.uint32)
        where, shift = np.arange(hi - lo), 0
        for level, (w, chunks, bitmap, ranks) in enumerate(self._levels):
            if lo >= hi:
                break
            first, last = lo * w // 8, (hi * w + 7) // 8
            data = np.frombuffer(self._read(chunks + first, last - first) + b"\0" * 8, np.uint8)
            bit = np.arange(lo, hi, dtype=np.int64) * w - 8 * first
            words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
            got = (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << w) - 1)
            out[where] |= got.astype(np.uint32) << np.uint32(shift)
            if level < len(self._levels) - 1:
                raw = np.frombuffer(self._read(bitmap + lo // 8, hi // 8 - lo // 8 + 1), np.uint8)
                on = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
                lo, hi = self._rank(bitmap, ranks, lo), 0
                where = where[on]
                hi, shift = lo + len(where), shift + w
        return out


def _open(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANIFEST = "part int, seq int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id",
                      text_col: str = "text", splits: int | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes whole texts and writes their ids, in ascending id order, to files under `directory`; returns the manifest.

    A file appears under its name once complete, and counts once its row of the manifest is committed: a task that runs again
    after an executor is lost writes a file of another name. `end_id` is put after each document. The manifest has one row
    per file: part, seq (their order is the order of the documents), path, n_docs, n_tokens, n_bytes.

    Null text counts as empty; rows of equal ids are all written, ordered by a hash of their texts; null ids come first. An
    empty table gives an empty manifest. `directory` is a URI that pyarrow opens on every executor.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), library_encoder(tokenizer), 0
        ids: list[int | None] = []
        codes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            fs, top = _open(directory)
            every = np.concatenate(codes)
            data = write_codes(every, ids, np.concatenate(lengths))
            name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            fs.create_dir(top, recursive=True)
            with fs.open_output_stream(f"{top}/.{name}") as f:
                f.write(data)
            fs.move(f"{top}/.{name}", f"{top}/{name}")
            row = [part, seq, f"{directory}/{name}", len(ids), len(every), len(data)]
            for x in (ids, codes, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        held = 0
        for of, texts in text_slices(batches):
            got, n = encoder.encode(texts)
            if end_id is not None:
                got, n = np.insert(got, np.cumsum(n), np.uint32(end_id)), n + 1
            ids += of
            codes.append(got)
            lengths.append(n)
            held += len(got)
            if held >= file_tokens:
                yield close()
                seq, held = seq + 1, 0
        if ids:
            yield close()

    spark = docs.sparkSession
    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("i", "t")
    ranged = rows.repartitionByRange(splits or partitions(spark), F.col("i"), F.xxhash64("t"))
    return stored(ranged.sortWithinPartitions(F.col("i"), F.xxhash64("t")).mapInArrow(write, _MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, and ids (array of int) unless told otherwise.

    `start` counts the tokens of all files and documents before it; the sum over files is a window over the manifest, which
    has one row per file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                        *[("ids", pa.list_(pa.int32()))] * with_ids])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    code = CodeFile(f)
                    ids, ends = code.documents
                    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    lo = 0
                    while lo < len(ids):  # about a million tokens at a time
                        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 1_000_000)))
                        got = code.tokens(int(starts[lo]), int(ends[hi - 1]))
                        raw, off = memoryview(got.astype("<u4").tobytes()), starts[lo]
                        crcs = [zlib.crc32(raw[4 * (s - off) : 4 * (e - off)]) for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                        lists = pa.ListArray.from_arrays(
                            np.append(starts[lo:hi] - off, ends[hi - 1] - off).astype(np.int32), pa.array(got.view(np.int32)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[lo:hi], pa.int64()), pa.array(base + starts[lo:hi]),
                             pa.array(ends[lo:hi] - starts[lo:hi]), pa.array(crcs, pa.int64()), *[lists] * with_ids], schema=schema)
                        lo = hi

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base")).repartition(partitions(manifest.sparkSession))
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, new_path(spark, "tokens"), tokenizer_path(), end_id=0)
    return read_token_files(manifest, with_ids=False)
