"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types.

    Names are matched exactly and by position, so extra columns whose names clash (by case, or as exact repeats) do not make
    the selection ambiguous; of exact repeats the first counts. A missing column is null.
    """
    names = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))
    return plain.select(*(
        (F.col(f"_c{names.index(n)}") if n in names else F.lit(None)).cast(t).alias(n) for n, t in columns.items()
    ))


_OWN: dict[str, str] = {}  # application -> its local folder, where the session names none


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a whole URI: `spark.checkpoint.dir`; a local one of its own only where that is unset and the executors are on this
    machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="docweir-")
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub("^file:/(?!/)", "file:///", uri)


_MADE: list[tuple[SparkSession, str, int]] = []  # folders of this driver, removed when it ends, and the threads that made them


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is kept until the driver ends: results that are still to be computed may read it."""
    top = f"{shared_dir(spark)}/docweir-{uuid.uuid4().hex}"
    _MADE.append((spark, top, threading.get_ident()))
    return f"{top}/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path, _ in _MADE:
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back: lineage is cut and nothing is lost with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the table behind a `stored` frame that is not needed any more."""
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, folder)


class Scratch:
    """The tables that this thread makes while it is open; `finish` stores a result and removes all others, which nothing needs then."""

    def __enter__(self) -> Scratch:
        self.seen = {path for _, path, _ in _MADE}
        return self

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        mine = [x for x in _MADE if x[1] not in self.seen and x[2] == threading.get_ident()]
        for made in mine[:-1]:  # the last one is the result
            _delete(made[0], made[1])
            _MADE.remove(made)
        return out

    def __exit__(self, *_) -> None:
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(of)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about `most`; an item over it stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in the edges (a, b), component being the smallest id reachable.

    Alternates large-star and small-star contractions on edge tables until nothing changes; each round is a table in the
    shared folder, so a lost executor costs one round at most. A hub costs no task its whole neighbourhood: minima are
    combined before the shuffle and the joins back are ordinary equi-joins whose skewed partitions Spark splits.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where((F.col("v") > F.col("u")) if large else (F.col("v") != F.col("m")))
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    spark = edges.sparkSession
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # An edge set is settled when every node points at one smaller node that points nowhere.
        before, now = now, stored(star(star(now, True), False), "edges")
        drop_table(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops)


#: Text handled at a time by the Python stages, in bytes; an Arrow batch is cut into slices of about this size.
SLICE = 4 << 20


def text_slices(batches: Iterator, text: int = 1, most: int = SLICE, each: int = 64) -> Iterator[list[list]]:
    """The columns of Arrow batches as lists, in slices of about `most` bytes by the string column at position `text`; a row
    counts as `each` bytes besides."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = [n + each for n in pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()]
        for lo, hi in slices(sizes, most):
            yield [c.slice(lo, hi - lo).to_pylist() for c in b.columns]
    release_memory()


def release_memory() -> None:
    """Gives back to the system what a Python worker, which goes on to other tasks, has freed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
