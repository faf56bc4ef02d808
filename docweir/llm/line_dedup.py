"""Line dedup with two Bloom filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.session import spread

from .common import partitions, pick, stored, text_slices

#: Bits of each of the two filters: so many for each line, between these bounds; blocks that they are cut into; bits set per hash.
LINE_BITS, LEAST_BITS, MOST_BITS, BLOCKS, SET = 8, 1 << 20, 1 << 30, 256, 2
#: Hashes that a task gathers before it sends them to their blocks.
GATHERED = 1 << 20
#: Keys to drop that every worker may get, as 16-byte digests; more are joined by a shuffle.
SENT = 200_000
#: Tasks that a common line is dealt to where lines are joined.
SALTS = 16
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """The line without white space (space, U+0009 to U+000D) at its ends, A-Z lower-cased."""
    line = line.strip(SPACE)
    return line.lower() if line.isascii() else line.encode().lower().decode()


def _hashes(keys: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


def _digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def places_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte and the mask of each of the SET bits of each hash in a filter."""
    bit = np.stack([(hashes >> np.uint64(24 * i)) & np.uint64(bits - 1) for i in range(SET)], 1)
    return (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7))).astype(np.uint8)


class TwoFilters:
    """Hashes seen once, and hashes seen (perhaps) twice: Bloom filters of `bits` bits, a power of two."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Hashes that differ; `again` tells which have been seen more than once."""
        byte, mask = places_of(hashes, self.bits)
        seen = ((self.once[byte] & mask) != 0).all(1) | again
        np.bitwise_or.at(self.twice, byte[seen], mask[seen])
        np.bitwise_or.at(self.once, byte, mask)


def block_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(56)).astype(np.int64)


def _keys_of(text: str | None, least: int) -> list[str]:
    """The different keys of a text that are long enough."""
    return [k for k in dict.fromkeys(map(line_key, (text or "").split("\n"))) if len(k) >= least]


def filter_bits_for(rows: DataFrame) -> int:
    """Bits of a filter over the lines of all rows (text)."""
    lines = rows.agg(F.sum(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (LINE_BITS * lines - 1).bit_length()))


def suspected_repeats(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The twice-seen filters of all blocks over the keys of all rows (text), each counted once per row.

    Tasks gather hashes, tell those met more than once, and send each with that mark to the task of its block, 8 bytes a hash; there it goes through that block's
    two filters. No repeat is missed. With more lines than the filters are made for, more keys become suspects, which costs shuffling, not exactness.
    """
    part = bits // BLOCKS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            cuts = np.searchsorted(block_of(hashes), np.arange(BLOCKS + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
                                              pa.array([np.packbits(n[cuts[i] : cuts[i + 1]] > 1).tobytes() for i in full], pa.binary())], ["block", "hashes", "again"])

        for (texts,) in text_slices(batches, 0):
            held.append(_hashes([k for t in texts for k in _keys_of(t, least)]))
            if sum(map(len, held)) > GATHERED:
                yield from flush()
        yield from flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filters = None, None
        for b in batches:
            for block, hashes, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    if filters is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([filters.twice.tobytes()], pa.binary())], ["block", "twice"])
                    now, filters = block, TwoFilters(part)
                found = np.frombuffer(hashes, np.uint64)
                filters.add(found, np.unpackbits(np.frombuffer(again, np.uint8), count=len(found)).astype(bool))
        if filters is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([filters.twice.tobytes()], pa.binary())], ["block", "twice"])

    sent = rows.select("text").mapInArrow(send, "block int, hashes binary, again binary")
    filled = sent.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block").mapInArrow(fill, "block int, twice binary")
    out = np.zeros((BLOCKS, part // 8), np.uint8)
    for r in filled.toLocalIterator():
        out[r.block] = np.frombuffer(r.twice, np.uint8)
    return out


def suspicious(filters: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter of its block has met each hash twice."""
    byte, mask = places_of(hashes, filters.shape[1] * 8)
    return ((filters[block_of(hashes)[:, None], byte] & mask) != 0).all(1)


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, id_col: str = "doc_id",
                   text_col: str = "text", keep: bool = False, sent: int = SENT, filter_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (the lines that stay, joined by line feeds).

    A line's key is the line without white space at its ends and with A-Z lower-cased. A key of at least `min_chars` code points in
    at least `min_docs` documents is repeated: all its lines go, or all but the first (smallest id, then first in the text) with
    `keep_first`. A first pass fills the two filters. A second sends only the suspected keys, once a document and summed up in the
    worker, to be counted exactly. A third rebuilds every text: repeated keys go along as digests up to `sent` of them, and
    otherwise documents' suspected lines are joined to them by a shuffle; both give the same rows.

    Null or empty text is one empty line. Rows are documents, so repeated ids count each and, with `keep_first`, share the first occurrence; null
    ids come last. An empty table gives no rows; other columns are ignored. `keep` returns all columns of the input, under names starting with
    an underscore, beside n_lines, n_dropped and text.
    """
    spark = docs.sparkSession
    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    # At most MOST_BITS / 8 bytes, 128 MB, whatever the input.
    filters = spark.sparkContext.broadcast(suspected_repeats(rows, min_chars, filter_bits or filter_bits_for(rows)))

    def suspects(texts: list[str | None]) -> list[list[str]]:
        keys = [_keys_of(t, min_chars) for t in texts]
        hit = suspicious(filters.value, _hashes([k for ks in keys for k in ks])).tolist() if any(keys) else []
        out, at = [], 0
        for ks in keys:
            out.append([k for k, h in zip(ks, hit[at : at + len(ks)], strict=True) if h])
            at += len(ks)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                              pa.array([v[1] for v in seen.values()], pa.int64())], ["key", "n", "first"])
            seen.clear()
            return out

        held = 0
        for ids, texts in text_slices(batches):
            for i, keys in zip(ids, suspects(texts), strict=True):
                for k in keys:
                    v = seen.get(k)
                    if v is None:
                        seen[k] = [1, i]
                        held += len(k) + 100
                    else:
                        v[0] += 1
                        if i is not None and (v[1] is None or i < v[1]):
                            v[1] = i
            if held > 64 << 20:
                yield flush()
                held = 0
        yield flush()

    found = rows.mapInArrow(count, "key string, n bigint, first bigint").groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    repeats = stored(found.where(F.col("n") >= min_docs).select("key", "first"), "repeats")

    def rebuild(text: str | None, doc: int | None, drop: dict) -> tuple[int, int, str]:
        """drop: key or digest -> id of the document that keeps its first line, or None."""
        lines = (text or "").split("\n")
        out, taken = [], set()
        for line in lines:
            key = line_key(line)
            first = drop(key)
            if first is not False:
                if not keep_first or first != doc or key in taken:
                    continue
                taken.add(key)
            out.append(line)
        return len(lines), len(lines) - len(out), "\n".join(out)

    frame = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns)))) if keep else rows.select(F.col("doc_id").alias("_c0"))
    given = frame.schema.fields
    if keep:
        at = [docs.columns.index(c) if c in docs.columns else None for c in (id_col, text_col)]
        full = frame.withColumns({n: (F.col(f"_c{i}") if i is not None else F.lit(None)).cast(t) for n, i, t in zip(("_id", "_text"), at, ("bigint", "string"), strict=True)})
    else:
        full = rows.select(F.col("doc_id").alias("_c0"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    result = StructType([*given, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType())])
    names = [f.name for f in result]

    def output(part: pa.RecordBatch, made: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns[: len(given)], *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names)

    if repeats.count() <= sent:
        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([_digest(k) for k in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["d", "first"])

        table = repeats.mapInArrow(digests, "d binary, first bigint").toArrow()
        dropped = spark.sparkContext.broadcast(dict(zip(table.column("d").to_pylist(), table.column("first").to_pylist(), strict=True)))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop = dropped.value
            for b in batches:
                done = 0
                for ids, texts in text_slices(iter([b.select([len(given), len(given) + 1])])):
                    doubt = suspects(texts)
                    made = []
                    for i, text, keys in zip(ids, texts, doubt, strict=True):
                        mine = {k: drop[d] for k in keys if (d := _digest(k)) in drop}
                        made.append(rebuild(text, i, lambda k, mine=mine: mine.get(k, False)))
                    yield output(b.slice(done, len(texts)), made)
                    done += len(texts)

        return full.mapInArrow(apply, result).toDF(*_outer(keep, names))

    # Too many repeated keys to send: each document's suspected keys meet them in a shuffle, and the hits meet the document in another.
    keyed = full.withColumn("_row", F.monotonically_increasing_id())
    keyed = stored(keyed, "keyed")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, texts in text_slices(batches):
            each = [(r, k) for r, keys in zip(of, suspects(texts), strict=True) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in each], pa.int64()), pa.array([k for _, k in each], pa.string())], ["_row", "key"])

    # A line that very many documents have meets its row in several tasks.
    salted = repeats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = keyed.select("_row", "_text").mapInArrow(pairs, "_row bigint, key string").withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int"))
    hits = met.join(salted, ["key", "_salt"]).groupBy("_row").agg(
        F.collect_list(F.struct("key", "first")).alias("_hits"))
    joined = keyed.join(hits, "_row", "left").select(*[f.name for f in given], "_id", "_text", "_hits")

    def apply_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, text, found in zip(*(b.column(n).to_pylist() for n in ("_id", "_text", "_hits")), strict=True):
                mine = {h["key"]: h["first"] for h in found or ()}
                made.append(rebuild(text, i, lambda k, mine=mine: mine.get(k, False)))
            yield output(b, made)

    return joined.mapInArrow(apply_hits, result).toDF(*_outer(keep, names))


def _outer(keep: bool, names: list[str]) -> list[str]:
    return names if keep else ["doc_id", *names[1:]]


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
