"""Best-fit packing by length patterns: non-negative least squares fits repeat counts of few-piece patterns to the histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweir.session import spread

from .common import pick, stored, text_slices
from .words import library_encoder, tokenizer_path


#: Pieces of a pattern at most; tokens that patterns may leave empty where none fills a sequence.
PIECES, SLACK = 64, 32


def length_patterns(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns that fill a sequence: up to three lengths each (rows, padded with 0), and how many pieces of each.

    All pairs and triples of the given lengths, and for short pieces two lengths repeated, up to PIECES in all, that fill `limit` exactly; or if there are
    none, that fill as much as any do, down to SLACK less.
    """
    for full in range(limit, max(1, limit - SLACK) - 1, -1):
        patterns, times = _filling(lengths[lengths < full], full)
        if len(patterns):
            break
    return patterns, times


def _filling(lengths: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
    there = np.zeros(full + 1, bool)
    there[lengths] = True
    a = lengths[lengths * 2 <= full]
    pairs = a[there[full - a]]
    i, j = np.meshgrid(lengths, lengths, indexing="ij")
    k = full - i - j
    good = (i <= j) & (j <= k) & there[np.clip(k, 0, full)]
    found = [np.stack([pairs, full - pairs, np.zeros_like(pairs)], 1), np.stack([i[good], j[good], k[good]], 1)]
    times = [np.ones_like(found[0]), np.ones_like(found[1])]
    for a in lengths[lengths * 3 < full].tolist():
        n = np.arange(1, min(PIECES, full // a) + 1)
        rest = full - n * a
        for m in range(1, PIECES):
            other = rest // m
            ok = (rest == other * m) & (other > a) & there[np.maximum(other, 0)] & (n + m > 3) & (n + m <= PIECES)
            if ok.any():
                found.append(np.stack([np.full(ok.sum(), a), other[ok], np.zeros(ok.sum(), int)], 1))
                times.append(np.stack([n[ok], np.full(ok.sum(), m), np.zeros(ok.sum(), int)], 1))
    return np.concatenate(found), np.concatenate(times)


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray, times: np.ndarray, gain: float = 3e-3, most: int = 5000) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 that bring the pieces used closest to the histogram.

    Accelerated projected gradient steps on the sparse pattern matrix, with lengths weighted so that long pieces, which are
    hardest to place, are met first; until 50 steps lower the residual by less than a share of `gain`, `most` steps at most.
    """
    if not len(patterns):
        return np.zeros(0)
    n = len(histogram)
    weight = np.sqrt(np.arange(n) / (n - 1))
    scale = max(1.0, histogram.max())
    target = weight * histogram / scale
    used = lambda x: weight * sum(np.bincount(patterns[:, c], x * times[:, c], n) for c in range(3))
    back = lambda r: sum((weight * r)[patterns[:, c]] * times[:, c] for c in range(3))
    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t, last = 1.0, np.inf
    for step in range(most):
        off = used(y) - target
        if step % 50 == 0:
            now = float(np.linalg.norm(off))
            if now > last * (1 - gain):
                break
            last = now
        new = np.maximum(0, y - back(off) / (norm * 1.05))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan_sequences(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with repeat counts, which use up the histogram exactly.

    The fitted counts are rounded down as far as pieces are left; what remains is packed by best fit on counts: the longest
    length left takes the largest that fits, again and again, and such a pattern is repeated as often as its lengths allow.
    Work and memory depend on the number of distinct lengths, not of pieces.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        plan.append(((limit,), int(left[limit])))
        left[limit] = 0
    lengths = np.nonzero(left)[0]
    patterns, times = length_patterns(lengths, limit)
    x = fit_repeats(left.astype(float), patterns, times)

    def take(p: tuple[int, ...], most: int | None = None) -> None:
        sizes, counts = np.unique([v for v in p if v], return_counts=True)
        n = int((left[sizes] // counts).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[sizes] -= n * counts
            plan.append((tuple(int(v) for v in p if v), n))

    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        take(tuple(np.repeat(patterns[i], times[i])), int(x[i]))
    while left.any():
        spare = left.copy()
        p: list[int] = []
        room = limit
        while room > 0:
            fits = np.nonzero(spare[: room + 1])[0]
            if not len(fits):
                break
            p.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            room -= p[-1]
        take(tuple(p))
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]], limit: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length its places: how many pieces of it go before, the first sequence of the pattern, the offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    seen = np.zeros(limit + 1, np.int64)
    sequence = 0
    for p, n in plan:
        offset = 0
        for v in p:
            out.setdefault(v, []).append((int(seen[v]), sequence, offset))
            seen[v] += n
            offset += v
        sequence += n
    return {v: tuple(np.array(c) for c in zip(*x, strict=True)) for v, x in out.items()}


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int | None = 2, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most `limit` tokens: one row per piece with doc_id, piece, start, length,
    ids_crc32, sequence_id and offset, and its ids on request.

    A document is its ids and `end_id`. Only one longer than `limit` is cut; its first piece takes what is over, all others are
    full. Pieces get a number among those of their length: the number within their partition, which the encoding stage counts,
    plus the counts of the partitions before. The plan says for each length and number the sequence and offset; it and the
    histogram have at most a few entries per distinct length, so both are bounded by `limit`. Texts and ids are not shuffled.

    Null text counts as empty (its only token is `end_id`; without one it has no piece); null and repeated ids are passed
    through; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64()),
                        *[("ids", pa.list_(pa.int32()))] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), library_encoder(tokenizer), np.zeros(limit + 1, np.int64)
        for of, texts in text_slices(batches):
            ids, n = encoder.encode(texts)
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
            pieces = -(-n // limit)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n[doc] - (pieces[doc] - 1) * limit
            start = np.where(piece == 0, 0, first + (piece - 1) * limit)
            length = np.where(piece == 0, first, limit)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            number = np.empty(len(doc), np.int64)
            number[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=limit + 1)
            at = np.concatenate([[0], np.cumsum(length)])
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            lists = [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.view(np.int32)))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(number), *lists], schema=schema)

    spark = docs.sparkSession
    rows = pick(docs, **{id_col: "bigint", text_col: "string"})
    pieces = stored(rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint"
                                    + ", ids array<int>" * with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts, "counts")
    histogram = np.zeros(limit + 1, np.int64)
    for v, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `limit` rows
        histogram[v] = n
    places = spark.sparkContext.broadcast(_slots(plan_sequences(histogram, limit), limit))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, number):
        import pandas as pd

        length, number = length.to_numpy(), number.to_numpy()
        out = np.zeros((len(length), 2), np.int64)
        order = np.argsort(length, kind="stable")
        values, at = np.unique(length[order], return_index=True)
        for v, rows in zip(values, np.split(order, at[1:]), strict=True):
            seen, sequence, offset = places.value[int(v)]
            k = np.searchsorted(seen, number[rows], side="right") - 1
            out[rows, 0] = sequence[k] + number[rows] - seen[k]
            out[rows, 1] = offset[k]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    out = pieces.join(based, ["part", "length"]).withColumn("_p", place("length", F.col("number") + F.col("base")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset", *["ids"] * with_ids)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), tokenizer_path())
