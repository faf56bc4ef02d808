"""Exact dedup by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, partitions, pick, stored

_SCHEMA = "doc_id bigint, text_sha256 binary, keep_id bigint, group_size bigint, part int, run bigint, edge_text string, first boolean"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_sha256", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()),
    ("part", pa.int32()), ("run", pa.int64()), ("edge_text", pa.string()), ("first", pa.bool_()),
])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares neighbours of one sorted partition in full; a run is a stretch of equal texts.

    Runs that share the splitter key of the partition's first or last row may go on in another partition: they keep no
    result of their own but name their text once, for `content_sort` to join. Memory: the ids of the runs under one key.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[list] = [[] for _ in _ARROW]
    first_key = key = text = None
    held: list[tuple[str, list]] = []  # runs under the current key
    number = 0

    def emit(edge: bool) -> None:
        nonlocal number
        for words, ids in held:
            known = [x for x in ids if x is not None]
            row = (hashlib.sha256(words.encode()).digest(), None if edge else min(known, default=None),
                   None if edge else len(ids))
            for i, x in enumerate(ids):
                for to, v in zip(out, (x, *row, part, number, words if edge and i == 0 else None, i == 0 or ids[i - 1] != x), strict=True):
                    to.append(v)
            number += 1
        held.clear()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
        for x in out:
            x.clear()
        return made

    for b in batches:
        ids, texts, heads, hashes = (c.to_pylist() for c in b.columns)
        for i, t, head, h in zip(ids, texts, heads, hashes, strict=True):
            if (head, h) != key:
                if key is not None:
                    emit(key == first_key)
                else:
                    first_key = (head, h)
                key, text = (head, h), None
            if held and t == text:
                held[-1][1].append(i)
            else:
                held.append((t, [i]))
                text = t
        if len(out[0]) > 20_000:
            yield flush()
    emit(True)
    yield flush()


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", splits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space (space, U+0009 to U+000D) has become one space. Sampled
    splitters deal the rows by (first 32 characters, 64-bit hash of the text, id) into ranges: the key is short, so the
    sample stays small on the driver, and as the id belongs to it a group of any size is cut into several ranges. Each range
    is sorted externally by the whole text and neighbours are compared in full. Runs at the ends of a range are joined by
    their texts; there are few per partition, so that table is bounded by the number of partitions (and by hash collisions).

    Null text counts as empty. Rows with equal ids are rows of their own; of a group the smallest non-null id stays, and of
    rows that repeat it one is kept; a group with null ids only has a null keep_id and keeps one row. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce("t", F.lit("")), SPACES, " ")
    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("i", "t").select("i", norm.alias("t"))
    rows = rows.select("i", "t", F.substring("t", 1, 32).alias("head"), F.xxhash64("t").alias("h"))
    ranged = rows.repartitionByRange(splits or partitions(spark), "head", "h", "i")
    runs = stored(ranged.sortWithinPartitions("head", "h", "t", "i").mapInArrow(_neighbours, _SCHEMA), "runs")

    # Edge runs: one row each with its text, its smallest id and its size.
    edges = runs.where("group_size is null").groupBy("part", "run").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("n"), F.max("edge_text").alias("edge_text"))
    whole = edges.groupBy("edge_text").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    joined = edges.select("part", "run", "edge_text").join(whole, "edge_text").select("part", "run", "low", "n")
    out = runs.join(joined, ["part", "run"], "left")
    keep, size = F.coalesce("keep_id", "low"), F.coalesce("group_size", "n")
    return out.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & F.col("first")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"))
