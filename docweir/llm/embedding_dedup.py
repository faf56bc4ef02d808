"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, partitions, pick, stored
from .simhash import _roots

#: Vectors that a task holds; cells are made for about so many, and one with more is cut into several tasks. Vectors on either side of a matrix of distances, axes
#: that it looks at first, pairs that are compared further at a time.
CELL, TILE, LEAD, PAIRS = 1 << 17, (256, 2048), 10, 100_000
_SLACK = 1e-5


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix; the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; summed in a fixed order, so a row's result does not depend on the rows beside it."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    out = np.zeros_like(unit)
    for k in range(x.shape[1]):
        out += unit[:, k, None] * turn[k]
    return out


class Space:
    """Blocks of the rotated space with their shares of the squared distance, and cells by the sides of planes through the middle."""

    def __init__(self, dims: int, blocks: int, distance2: float, middle: np.ndarray, splits: int):
        blocks = min(blocks, dims)
        self.turn = rotation(dims)
        cuts = [round(dims * i / blocks) for i in range(blocks + 1)]
        self.spans = [slice(a, b) for a, b in itertools.pairwise(cuts)]
        self.budgets = [distance2 * (s.stop - s.start) / dims + _SLACK for s in self.spans]
        self.middle = middle @ self.turn
        self.splits = [min(splits, s.stop - s.start) for s in self.spans]

    def cells(self, rotated: np.ndarray, block: int) -> np.ndarray:
        """Each row's own cell: a bit for the side of each of the first axes."""
        at = slice(self.spans[block].start, self.spans[block].start + self.splits[block])
        return ((rotated[:, at] > self.middle[at]) << np.arange(self.splits[block])).sum(1)

    def visits(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, other cell) for the cells that may hold vectors within the budget: those for which the squared distances to the planes between add up to no more.

        Of two cells that differ, one visits the other: that with the bit of the lowest axis that differs.
        """
        start = self.spans[block].start
        row, mask, spent, turn = np.arange(len(rotated)), np.zeros(len(rotated), np.int64), np.zeros(len(rotated)), np.zeros(len(rotated), bool)
        own = self.cells(rotated, block)
        for i in range(self.splits[block]):
            cost = spent + (rotated[row, start + i] - self.middle[start + i]) ** 2
            # The first axis that differs says who visits.
            go = (cost <= self.budgets[block]) & (turn | (own[row] >> i & 1 == 1))
            row, mask, spent, turn = (np.concatenate(x) for x in (
                (row, row[go]), (mask, mask[go] | 1 << i), (spent, cost[go]), (turn, np.ones(go.sum(), bool))))
        there = mask > 0
        return row[there], own[row[there]] ^ mask[there]

    def near(self, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of rotated rows count in this block: the first one within its budget."""
        good = np.ones(len(a), bool)
        for other in range(block + 1):
            d = a[:, self.spans[other]] - b[:, self.spans[other]]
            within = (d * d).sum(1) <= self.budgets[other]
            good &= within if other == block else ~within
        return good

    def links(self, block: int, a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, least: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of a, row of b) with a cosine of at least `least` that count in this block; with `same`, b is a and only i < j count.

        Squared distances over the first LEAD axes of the block, as products of matrices, leave out almost all pairs; what is left is compared over the
        whole blocks and by the exact cosine in double precision, PAIRS at a time.
        """
        s = self.spans[block]
        lead = slice(s.start, min(s.stop, s.start + LEAD))
        # Each squared distance is one product: of (-2 x, |x|^2, 1) and (y, 1, |y|^2).
        x, y = ra[:, lead], rb[:, lead]
        x, y = np.column_stack([-2 * x, (x * x).sum(1), np.ones(len(x))]).astype(np.float32), np.column_stack([y, np.ones(len(y)), (y * y).sum(1)]).astype(np.float32)
        norm = lambda v: np.sqrt((v * v).sum(1))
        for lo in range(0, len(x), TILE[0]):
            for to in range(lo // TILE[1] * TILE[1] if same else 0, len(y), TILE[1]):
                away = x[lo : lo + TILE[0]] @ y[to : to + TILE[1]].T
                i, j = np.divmod(np.flatnonzero(away <= self.budgets[block] + _SLACK), away.shape[1])
                i, j = i + lo, j + to
                if same:
                    i, j = i[i < j], j[i < j]
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for at in range(0, len(i), PAIRS):
                    p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                    good = self.near(block, ra[p], rb[q])
                    p, q = p[good], q[good]
                    u, v = a[p].astype(np.float64), b[q].astype(np.float64)
                    good = (u * v).sum(1) / (norm(u) * norm(v)) >= least
                    found.append((p[good], q[good]))
                if found:
                    yield tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def subspace_join(vectors: DataFrame, least: float = 0.9, blocks: int = 4, id_col: str = "vec_id", vector_col: str = "embedding",
                  cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least `least`), component_id, kept.

    Unit vectors within a squared distance of 2 - 2 * least are within a proportional share of it in one block of a rotation at
    least. For each block, planes through the mean of all vectors, across its first axes, make cells of about `cell` vectors; a vector goes to its own cell and
    to those to which the squared distances across the planes add up to no more than the share. A task compares the block distances of its cell,
    and checks candidates by the exact cosine in double precision.
    A pair counts in the first block that is within its share, so no pair is shuffled or counted twice: tasks return link counts
    per vector and a spanning link for each group. Equal vectors are one entry with a count. A cell of more than `cell` vectors is
    dealt to several tasks; each holds `cell` of them and the others stream past.

    Null or zero vectors and those with null or non-finite components link with nothing: n_links 0, their own component. Vectors of
    different lengths do not link. Repeated ids are rows of their own; a null id takes part, its component has the smallest non-null
    id of the group. An empty table gives no rows; other columns are ignored.
    """
    from pyspark.sql.types import ArrayType, FloatType

    spark = vectors.sparkSession
    given = vectors.schema.fields[vectors.columns.index(vector_col)].dataType if vector_col in vectors.columns else None
    narrow = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    number = "float" if narrow else "double"
    rows = pick(vectors, **{id_col: "bigint", vector_col: "array<double>"}).toDF("id", "v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # Scaled by a power of two near the largest component, so that squares neither overflow nor vanish and nothing is rounded; equal vectors stay equal.
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x))))))
    clean = F.when(good, F.transform("v", lambda x: x / top + F.lit(0.0))).cast(f"array<{number}>")
    each = stored(rows.select("id", clean.alias("v")), "vectors")
    distinct = each.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    distinct = stored(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct")
    entries = distinct.select("key", "n", "v")

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.nonzero(lengths == d)[0]))
                yield d, part, _matrix(part.column(2)).astype(np.float64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the unit vectors of each length; at the end their number."""
        sums: dict[int, np.ndarray] = {}
        for d, _, x in by_length(batches):
            sums[d] = sums.get(d, 0) + np.append((x / np.sqrt((x * x).sum(1))[:, None]).sum(0), len(x))
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(total)], ["dims", "place", "total"])

    spaces: dict[int, Space] = {}
    sums = entries.mapInArrow(add, "dims int, place int, total double").groupBy("dims", "place").agg(F.sum("total").alias("total")).toPandas()
    for d, part in sums.sort_values("place").groupby("dims"):
        total = part["total"].to_numpy()
        splits = max(0, int(np.ceil(np.log2(max(1.0, total[-1] / cell)))))
        spaces[int(d)] = Space(int(d), blocks, 2 - 2 * least, total[:-1] / total[-1], splits)

    def name(space: Space, dims: int, block: int, at: np.ndarray) -> np.ndarray:
        return (at << 24) + (dims % 65_536 << 8) + block

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, _, x in by_length(batches):
            r = _rotated(x, spaces[d].turn)
            for block in range(len(spaces[d].spans)):
                yield pa.RecordBatch.from_arrays([pa.array(name(spaces[d], d, block, spaces[d].cells(r, block)))], ["cell"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its own cell, and in those that it visits."""
        for d, part, x in by_length(batches):
            space = spaces[d]
            r = _rotated(x, space.turn)
            for block in range(len(space.spans)):
                row, other = space.visits(r, block)
                row = np.concatenate([np.arange(len(x)), row])
                cells = name(space, d, block, np.concatenate([space.cells(r, block), other]))
                for lo in range(0, len(row), 4096):
                    at = slice(lo, lo + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[at]), pa.array(np.arange(len(row))[at] >= len(x)), *part.take(pa.array(row[at])).columns],
                                                     ["cell", "visitor", "key", "n", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, home = None, [], None

        def report(ka, na, kb, nb, pairs) -> Iterator[pa.RecordBatch]:
            """Sums of the partners' counts for each vector, and links that join what is linked here."""
            for i, j in pairs:
                if len(i):
                    keys, at = np.unique(np.concatenate([ka[i], kb[j]]), return_inverse=True)
                    sums = np.bincount(at, np.concatenate([nb[j], na[i]]).astype(float), len(keys)).astype(np.int64)
                    root = _roots(len(keys), at[: len(i)], at[len(i) :])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums), pa.array(keys[root])], ["key", "sums", "to"])

        def settle() -> Iterator[pa.RecordBatch]:
            """The homes of the task are complete: pairs among them."""
            nonlocal home
            if home is None and held:
                k, n, x = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                space, block = spaces[x.shape[1]], int(now[1] & 255)
                home = k, n, x, _rotated(x.astype(np.float64), space.turn), block, space
                yield from report(k, n, k, n, space.links(block, x, home[3], x, home[3], least, same=True))

        for batch in batches:
            cell, piece, visitor, key, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            cuts = np.nonzero((cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1]) | (visitor[1:] != visitor[:-1]))[0] + 1
            for lo, hi in itertools.pairwise([0, *cuts, len(cell)]):
                if lo == hi:
                    continue
                if (piece[lo], cell[lo]) != now:
                    yield from settle()
                    now, home = (piece[lo], cell[lo]), None
                    held.clear()
                x = _matrix(batch.column(5).slice(lo, hi - lo))
                if not visitor[lo]:
                    held.append((key[lo:hi], n[lo:hi], x))
                    continue
                yield from settle()
                if home is not None:
                    k, m, y, ry, block, space = home
                    yield from report(k, m, key[lo:hi], n[lo:hi], space.links(block, y, ry, x, _rotated(x.astype(np.float64), space.turn), least))
        yield from settle()

    # Cells that hold more than a task may: few, and joined like any table.
    full = entries.mapInArrow(homes, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    full = full.select("cell", F.ceil(F.col("n") / cell).cast("int").alias("pieces"))
    dealt = entries.mapInArrow(deal, f"cell bigint, visitor boolean, key bigint, n bigint, v array<{number}>").join(full, "cell", "left")
    pieces = F.coalesce("pieces", F.lit(1))
    mine = F.pmod(F.xxhash64("key"), pieces).cast("int")
    # In a cell of several pieces, a vector is at home in one and visits those after it; visitors from other cells visit all.
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.when(F.col("visitor"), F.lit(0)).otherwise(mine), pieces - 1)))
    dealt = dealt.select("cell", "piece", (F.col("visitor") | (F.col("piece") > mine)).alias("visitor"), "key", "n", "v")
    dealt = dealt.repartition(partitions(spark), "cell", "piece").sortWithinPartitions("cell", "piece", "visitor")
    found = stored(dealt.mapInArrow(search, "key bigint, sums bigint, to bigint"), "links")
    sums = found.groupBy("key").agg(F.sum("sums").alias("others"))
    groups = connected_components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    lows = groups.join(distinct.select(F.col("key").alias("id"), "low"), "id").groupBy("component").agg(F.min("low").alias("top"))
    of = groups.join(lows, "component").select(F.col("id").alias("key"), "top")
    known = distinct.join(sums, "key", "left").join(of, "key", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("top", "low").alias("component_id"))
    linked = each.where("v is not null").join(known, "v").select("id", "n_links", "component_id")
    alone = each.where("v is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
