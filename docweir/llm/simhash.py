"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.session import spread

from .common import connected_components, partitions, pick, stored, text_slices

#: Fingerprints under a leaf of the index; a task's own index holds at most TASK fingerprints at a time.
LEAF, FAN, TASK = 16, 8, 200_000
#: Documents of one fingerprint from which on it is joined by broadcast; how many of these there can be at most.
HOT, SENT = 10_000, 100_000
#: Words of a sketch; its choices of bits, how many each takes, and in how many of these candidates may differ.
WORDS, LANES, LANE, LANE_BUDGET = 4, 20, 32, 2
#: Entries up to which a task compares all pairs at once; texts, and characters of texts, of one candidate group that are compared in a task.
FLAT, TEXTS, CHARS = 512, 2000, 16_000_000
#: Rounds of leaders in a task at most; tasks that meet the leader of a large group.
LEADERS, SALTS = 64, 64
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), [(np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)), (np.uint64(31), np.uint64(1))]
_COUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_TOP = 1 << 63


def differing(x: np.ndarray) -> np.ndarray:
    """Set bits of unsigned 64-bit integers."""
    if hasattr(np, "bitwise_count"):
        return np.bitwise_count(x)
    return _COUNT[np.ascontiguousarray(x)[..., None].view(np.uint16)].sum(-1, dtype=np.uint8)


def _shingles(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, repeats included, in stretches; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at space and U+0009 to U+000D only
    n = max(1, len(words) - shingle + 1) if words else 0
    for lo in range(0, n, 8192):
        part = words[lo : min(lo + 8192, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        yield np.fromiter((xxh64_intdigest(g, 42) for g in grams), "<u8")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_shingles(text, shingle)]))


def sketches(texts: list[str | None], shingle: int, words: int = 1) -> np.ndarray:
    """SimHash of the word shingles of each text, repeats included, in so many words of 64 bits; no shingle: 0. The first word is that of the hashes themselves, each
    other one of another mixture of their bits."""
    out = np.zeros((len(texts), words), np.uint64)
    for k, text in enumerate(texts):
        n, ones = 0, np.zeros((words, 64), np.int64)
        for h in _shingles(text, shingle):
            n += len(h)
            z = h + _STEP * np.arange(words, dtype=np.uint64)[:, None]
            for shift, times in _MIX:
                z[1:] = (z[1:] ^ (z[1:] >> shift)) * times
            bits = np.unpackbits(z.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little").view(np.uint64)
            for lo in range(0, len(h), 255):  # eight counters of a byte each are added at once
                ones += np.ascontiguousarray(bits[:, lo : lo + 255].sum(1)).view(np.uint8).reshape(words, 64)
        if n:
            out[k] = np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """64-bit SimHash of the word shingles of each text."""
    return sketches(texts, shingle)[:, 0]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a word in Gray order: the number whose Gray code it is."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under a tree of masked patterns.

    Neighbours in Gray order share most bits. A node states, in a mask and a pattern, the bits that all its fingerprints
    share beyond those its parents state, so a search adds up the differences on the way down and drops a whole group as soon as they
    exceed the budget; no bit is compared twice on a path.
    """

    def __init__(self, fingerprints: np.ndarray):
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.sorted = fingerprints[self.order]
        all_and = all_or = None
        levels = []
        width = LEAF
        n = len(fingerprints)
        starts = np.arange(0, n, width)
        while True:
            if all_and is None:
                all_and = np.bitwise_and.reduceat(self.sorted, starts)
                all_or = np.bitwise_or.reduceat(self.sorted, starts)
            else:
                groups = np.arange(0, len(all_and), FAN)
                all_and, all_or = np.bitwise_and.reduceat(all_and, groups), np.bitwise_or.reduceat(all_or, groups)
            levels.append((~(all_and ^ all_or), all_and))  # bits all share, and their values
            if len(all_and) == 1:
                break
        # From the root down; each mask without what the node above already states.
        self.levels = []
        above = None
        for mask, pattern in reversed(levels):
            own = mask if above is None else mask & ~above[np.arange(len(mask)) // FAN]
            self.levels.append((own, pattern & own))
            above = mask
        self.rest = ~above  # what is left to compare in a leaf

    def pairs(self, budget: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Positions i < j (in Gray order) of all pairs that differ in at most `budget` bits."""
        left, right = zip(*self.pair_chunks(budget, chunk), strict=True)
        return np.concatenate(left), np.concatenate(right)

    def pair_chunks(self, budget: int, chunk: int, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for `chunk` values of i at a time; or with `asked`, for these positions i and all j but i itself."""
        n = len(self.sorted)
        every = np.arange(n) if asked is None else asked
        for lo in range(0, len(every), chunk):
            q = every[lo : lo + chunk]
            node, spent = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:  # to the children that reach beyond the query itself
                    q, spent = np.repeat(q, FAN), np.repeat(spent, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                span = LEAF * FAN ** (len(self.levels) - 1 - depth)
                keep = (node < len(mask)) & ((node + 1) * span > q + 1 if asked is None else True)
                q, spent, node = q[keep], spent[keep], node[keep]
                spent = spent + differing((self.sorted[q] & mask[node]) ^ pattern[node])
                keep = spent <= budget
                q, spent, node = q[keep], spent[keep], node[keep]
            j = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            q, spent, rest = np.repeat(q, LEAF), np.repeat(spent, LEAF), np.repeat(self.rest[node], LEAF)
            keep = (j < n) & (j > q if asked is None else j != q)
            q, spent, rest, j = q[keep], spent[keep], rest[keep], j[keep]
            keep = spent + differing((self.sorted[q] ^ self.sorted[j]) & rest) <= budget
            yield q[keep], j[keep]


def _blocks(budget: int, wide: int = 64) -> list[tuple[int, int]]:
    """(shift, bits) of the budget + 1 blocks of a fingerprint; two within the budget agree in one block at least."""
    cuts = [round(wide * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _dealt(rows: DataFrame, *carried: str) -> DataFrame:
    """(key, the carried columns): rows by task, in order of key; all rows of one block and value (columns block and value) meet, two by two at least.

    A block value with more than TASK rows is cut into pieces of about TASK / 2, by hash of the carried columns, and each pair of pieces is a task of its own, so all
    pairs are covered whatever the size.
    """
    sizes = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > TASK)
    pieces = F.ceil(F.col("n") / (TASK // 2)).cast("int")
    mine = F.pmod(F.xxhash64(*carried), F.col("pieces")).cast("int")
    common = rows.join(sizes.select("block", "value", pieces.alias("pieces")), ["block", "value"], "left")
    common = common.withColumn("mine", F.coalesce(mine, F.lit(0)))
    pair = lambda x: F.struct(F.least(x, "mine").alias("a"), F.greatest(x, "mine").alias("b"))
    tasks = F.transform(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1), pair)
    key = F.xxhash64("block", "value", "task.a", "task.b").alias("key")
    dealt = common.withColumn("task", F.explode(tasks)).select(key, *carried)
    return dealt.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns but the first of the rows of each key, the first column, which they are sorted by."""
    key_now, held = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys = columns[0]
        cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if keys[lo] != key_now:
                if held:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                key_now, held = keys[lo], []
            held.append([c[lo:hi] for c in columns[1:]])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


class _Links:
    """Links (a, b) in batches of a fair size."""

    def __init__(self) -> None:
        self.made: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.made.append((a, b))
        self.n += len(a)
        if self.n >= 20_000:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(m[i].view(np.int64) for m in self.made)])) for i in (0, 1)], ["a", "b"])
        self.made.clear()
        self.n = 0
        return out


def near_links(prints: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all pairs within the budget, directly or in steps.

    Two fingerprints within the budget agree in one of budget + 1 blocks. Each fingerprint goes once for each block to the
    task of that block's value; the task sorts its fingerprints in Gray order, builds the index over them and searches it, so
    no fingerprint meets all others. Of each group that it links, it returns a link from each member to one of them only.
    """
    parts = [prints.select("fp", F.lit(k).alias("block"), F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1).alias("value"))
             for k, (shift, bits) in enumerate(_blocks(budget))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for (fps,) in _groups_of(batches):
            fps = np.unique(fps)
            if len(fps) < 2:
                continue
            index = GrayIndex(fps.view(np.uint64))
            a, b = index.pairs(budget)
            if len(a):
                root = _roots(len(fps), a, b)
                far = np.nonzero(root != np.arange(len(fps)))[0]
                yield from links.add(index.sorted[far], index.sorted[root[far]])
        yield links.flush()

    return _dealt(rows, "fp").mapInArrow(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, shingle: int = 5, budget: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   keys: bool = False) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable over links).

    Fingerprints link at `budget` or fewer differing bits. Equal fingerprints are brought together first, so the index only
    sees distinct ones and a group of copies of any size is one entry. A text without words has fingerprint zero and links like
    any other; one of fewer words than a shingle has its whole sequence as the only shingle. Null text counts as empty.
    Repeated ids are rows of their own; null ids take part, but a group's id is its smallest non-null one (null if there
    is none). An empty table gives no rows; other columns are ignored. With `keys`, two columns more: group (a fingerprint of the
    component, the same for all of it) and text_key (MD5 of the text).

    In the last join, fingerprints of HOT documents or more, and of more than one in SENT of all, are sent to all workers: SENT rows at most.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("fp", pa.int64())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, key in text_slices(batches):
            columns = [pa.array(ids, pa.int64()), pa.array(key, pa.string()), pa.array(fingerprints(texts, shingle).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    key = F.md5("text") if keys else F.lit(None).cast("string")
    each = stored(rows.select("doc_id", "text", key).mapInArrow(prints, "doc_id bigint, text_key string, fp bigint"), "prints")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    groups = connected_components(near_links(distinct.select("fp"), budget))
    ids = groups.join(distinct.withColumnRenamed("fp", "id"), "id").groupBy("component").agg(F.min("low").alias("component_low"))
    linked = groups.join(ids, "component").select(F.col("id").alias("fp"), "component", "component_low")
    # A component without any id has none; it must not fall back to the fingerprint's own.
    of = distinct.join(linked, "fp", "left").select(
        "fp", "n", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_low")).alias("component_id"),
        F.coalesce("component", "fp").alias("group"))
    of = stored(of, "components")
    # No more than SENT fingerprints can have that many documents, whatever the input: a broadcast of a proven size.
    total = of.agg(F.sum("n")).first()[0] or 0
    least = max(HOT, -(-total // SENT))
    hot = F.broadcast(of.where(F.col("n") >= least).drop("n"))
    rare = each.join(hot.select("fp"), "fp", "left_anti").join(of.where(F.col("n") < least).drop("n"), "fp")
    joined = rare.unionByName(each.join(hot, "fp"))
    out = joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "text_key")
    return out if keys else out.drop("group", "text_key")


def _lane_bits() -> np.ndarray:
    """Which bits of a sketch make each lane."""
    rng = np.random.default_rng(17)
    return np.stack([rng.choice(64 * WORDS, LANE, replace=False) for _ in range(LANES)])


def _away(similarity: float, n: int) -> int:
    """Bits in which n of a sketch may differ at this similarity, with three standard deviations to spare: shingles taken with or without the other set make an
    angle whose cosine is 2 s / (1 + s)."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(n * p + 3 * (n * p * (1 - p)) ** 0.5))


def _sketch_links(lanes: np.ndarray, sketch: np.ndarray, budget: int, away: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that join all pairs whose lanes differ in at most `budget` bits and whose sketches differ in at most `away`; with `asked` (flags), all such
    pairs of which one is asked for.

    Few are compared all at once, many through the Gray index. There, rows near a leader are joined to it first, round by round while that settles many: of
    rows that are joined no pair is needed, so only the others are searched for. Pairs are merged as they are found, so a dense group holds no memory for all of them.
    """
    n = len(lanes)
    root = np.arange(n)
    if n <= FLAT:
        order = np.arange(n)
        found = iter([np.nonzero(np.triu(differing(lanes[:, None] ^ lanes) <= budget, 1) & (True if asked is None else asked[:, None] | asked))])
    else:
        index = GrayIndex(lanes)
        order = index.order
        query = np.ones(n, bool) if asked is None else asked[order]
        for _ in range(LEADERS if asked is None else 0):
            left = np.flatnonzero(query)
            if not len(left):
                break
            near = np.flatnonzero((differing(index.sorted ^ index.sorted[left[0]]) <= budget) & (differing(sketch[order] ^ sketch[order[left[0]]]).astype(np.int64).sum(1) <= away))
            root = _roots(n, np.concatenate([np.arange(n), near]), np.concatenate([root, np.full(len(near), left[0])]))
            settled = query[near].sum()
            query[near] = False  # the leader's own pairs are all found as well
            if settled < n // 50:
                break
        found = index.pair_chunks(budget, min(4096, max(16, 2_000_000 // n)), np.flatnonzero(query))
    mine = sketch[order]
    for a, b in found:
        new = root[a] != root[b]
        a, b = a[new], b[new]
        if len(a):
            near = differing(mine[a] ^ mine[b]).astype(np.int64).sum(1) <= away
            a, b = a[near], b[near]
        if len(a):
            far = np.nonzero(root != np.arange(n))[0]
            root = _roots(n, np.concatenate([far, a]), np.concatenate([root[far], b]))
    far = np.nonzero(root != np.arange(n))[0]
    return order[far], order[root[far]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; of two empty ones 1."""
    every = len(np.union1d(a, b))
    return (len(a) + len(b) - every) / every if every else 1.0


def similar_sets(items: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], similarity: float, away: int, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between items that join all pairs whose sketches differ in at most `away` bits and whose sets have the Jaccard similarity or more; with `asked` (flags),
    all such pairs of which one is asked for. Pairs that are joined already are not compared again."""
    query = np.ones(len(items), bool) if asked is None else asked
    items, first, of = np.unique(items, return_index=True, return_inverse=True)
    query = np.bincount(of, query, len(items)) > 0
    sizes = np.array([len(sets[i]) for i in first], np.int64)
    by = np.argsort(sizes, kind="stable")
    items, sketch, sizes, query, sets = items[by], sketch[first][by], sizes[by], query[by], [sets[i] for i in first[by]]
    root, out = np.arange(len(items)), []
    for i in np.flatnonzero(query).tolist():
        low = int(np.searchsorted(sizes, similarity * sizes[i] - 1e-6))
        high = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-6, "right"))
        at = low + np.flatnonzero(root[low:high] != root[i])
        apart = differing(sketch[at] ^ sketch[i]).astype(np.int64).sum(1)
        good = apart <= away
        for j in at[good][np.argsort(apart[good], kind="stable")].tolist():  # the nearest first
            if root[j] != root[i] and (j > i or not query[j]) and jaccard(sets[i], sets[j]) >= similarity:
                out.append((int(items[i]), int(items[j])))
                root[root == root[j]] = root[i]
    return out


def _against(rows: DataFrame, group: list[str], settled: str, most: int) -> DataFrame:
    """Rows of large groups dealt so that each row that is not settled meets all rows of its group: (key, asked, the columns). Pieces of about `most` of the former
    meet pieces of about `most` of all rows; a group without any of the former is left out."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.count_if(~F.col(settled)).alias("_u")).where("_u > 0")
    counted = rows.join(counts, group).withColumns({"_parts": F.ceil(F.col("_n") / most).cast("int"), "_asks": F.ceil(F.col("_u") / most).cast("int")})
    lot = lambda n: F.pmod(F.xxhash64("item", F.lit(7)), F.col(n)).cast("int")
    one = counted.withColumns({"_p": lot("_parts"), "_a": F.explode(F.sequence(F.lit(0), F.col("_asks") - 1)), "asked": F.lit(False)})
    two = counted.where(~F.col(settled)).withColumns({"_p": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)), "_a": lot("_asks"), "asked": F.lit(True)})
    return one.unionByName(two).select(F.xxhash64(*group, F.lit("of"), "_p", "_a").alias("key"), "asked", *rows.columns)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per group of near-duplicates (columns doc_id, text): group, own (struct of none, doc_id, key: the row that stays, which is that of the smallest
    id and then of the smallest MD5 of its text), n (rows that repeat it).

    Texts link if the sets of their word shingles (64-bit hashes) have the Jaccard similarity or more; groups are what links join. Candidates come
    from SimHash: each different text has a sketch of WORDS * 64 bits, and LANES choices of LANE of its bits. Texts whose lanes differ in at most LANE_BUDGET
    bits, found in a Gray-order index as in `near_links`, are candidates if their whole sketches differ in no more bits than similar ones do. Of a pair at the
    limit of 0.8, nine of ten are found so, and nearly all of those that are more alike. What candidates join is brought together with the shingle sets, once each,
    and compared in full. Where very many texts meet (TASK of one value of a block; TEXTS texts or CHARS characters of one candidate group), all are first compared with one
    of them; those that are like it are joined by that, and only the others go on to be compared with all, piece by piece. So a group of copies with
    small changes, however large, costs time in proportion to its size if most are like the first; what is unlike it meets the whole group.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="bigint", text="string").withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    bits, away = _lane_bits(), _away(similarity, 64 * WORDS)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, key, chars in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key, pa.string()), pa.array(chars, pa.int64()),
                                              pa.array([x.tobytes() for x in sketches(texts, shingle, WORDS)], pa.binary())], ["doc_id", "key", "chars", "sketch"])

    each = rows.select("doc_id", "text", "key", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    each = each.mapInArrow(prints, "doc_id bigint, key string, chars bigint, sketch binary")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    each = each.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.min("sketch").alias("sketch"), F.min("chars").alias("chars"))
    texts = each.groupBy("key").agg(F.min_by(F.struct(own.alias("own"), "n"), own).alias("best"), F.min("sketch").alias("sketch"), F.min("chars").alias("chars"))
    texts = stored(texts.withColumn("item", F.monotonically_increasing_id()), "texts")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text once for each block of each lane."""
        blocks = _blocks(LANE_BUDGET, LANE)
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            every = np.unpackbits(raw, axis=1, bitorder="little")
            item, words = b.column(0), [pa.array(w) for w in raw.view("<i8").T]
            for k, chosen in enumerate(bits):
                lane = np.zeros((len(raw), 8), np.uint8)
                lane[:, : LANE // 8] = np.packbits(every[:, chosen], axis=1, bitorder="little")
                lane = lane.view("<i8")[:, 0]
                for j, (shift, wide) in enumerate(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), k * len(blocks) + j, np.int32)), pa.array(lane >> shift & ((1 << wide) - 1)),
                                                      pa.array(lane), item, *words], ["block", "value", "lane", "item", *(f"s{i}" for i in range(WORDS))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for asked, lane, item, *sketch in _groups_of(batches):
            if len(lane) > 1:
                some = asked.astype(bool)
                if some.any():  # a row may be there in both parts
                    item, first, of = np.unique(item, return_index=True, return_inverse=True)
                    some, lane, sketch = np.bincount(of, some, len(item)) > 0, lane[first], [x[first] for x in sketch]
                a, b = _sketch_links(lane.view(np.uint64), np.stack(sketch, 1).view(np.uint64), LANE_BUDGET, away, some if some.any() else None)
                if len(a):
                    yield from links.add(item[a], item[b])
        yield links.flush()

    kinds = "lane bigint, item bigint, " + ", ".join(f"s{i} bigint" for i in range(WORDS))
    words_of = [f"s{i}" for i in range(WORDS)]
    every = texts.select("item", "sketch").mapInArrow(entries, f"block int, value bigint, {kinds}")
    # Block values that very many texts have: few. Those near the first of them are linked to it at once, and only the others are searched for among all.
    first = F.min(F.struct("item", "lane", *words_of))
    large = stored(every.groupBy("block", "value").agg(F.count("*").alias("n"), first.alias("lead")).where(F.col("n") > TASK).drop("n"), "large")
    far = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    columns = ["lane", "item", *words_of]
    small = every.join(large, ["block", "value"], "left_anti").select(F.xxhash64("block", "value").alias("key"), F.lit(False).alias("asked"), *columns)
    links = []
    if large.count():
        led = every.join(large, ["block", "value"])
        near_lead = (far(F.col("lane"), F.col("lead.lane")) <= LANE_BUDGET) & (sum(far(F.col(w), F.col(f"lead.{w}")) for w in words_of) <= away)
        led = stored(led.select("block", "value", *columns, F.col("lead.item").alias("leader"), near_lead.alias("settled")), "led")
        links.append(led.where("settled and item <> leader").select(F.col("item").alias("a"), F.col("leader").alias("b")))
        small = small.unionByName(_against(led.drop("leader"), ["block", "value"], "settled", TASK // 2).select("key", "asked", *columns))
    in_order = lambda rows: rows.repartition(partitions(spark), "key").sortWithinPartitions("key")
    links.append(in_order(small).select("key", F.col("asked").cast("int").alias("asked"), *columns).mapInArrow(search, "a bigint, b bigint"))
    near = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("id", "item")
    members = texts.join(near, "item").select("item", "sketch", "chars", "key", F.col("best.own.doc_id").alias("low"), "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("item").alias("leader"))
    pieces = F.ceil(F.greatest(F.col("n") / TEXTS, F.col("chars") / CHARS, F.lit(1))).cast("int").alias("pieces")
    members = stored(members.drop("chars").join(sizes.select("component", "leader", pieces), "component"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, *rest in text_slices(batches, 0):
            columns = [pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())], ["item", "sketch", "component", "leader", "set"])

    def with_sets(some: DataFrame) -> DataFrame:
        full = rows.join(some.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("low")))
        return full.select("text", "item", "sketch", "component", "leader").mapInArrow(sets, "item bigint, sketch binary, component bigint, leader bigint, set binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for asked, items, sketch, found in _groups_of(batches):
            if len(items) > 1:
                some = asked.astype(bool)
                made = similar_sets(items, np.frombuffer(b"".join(sketch), np.uint64).reshape(-1, WORDS), [np.frombuffer(x, "<u8") for x in found], similarity, away,
                                    some if some.any() else None)
                if made:
                    yield from links.add(*(np.array(x, np.int64) for x in zip(*made, strict=True)))
        yield links.flush()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = (b.column(i).to_pylist() for i in (4, 5))
            near = [jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= similarity for x, y in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(near, pa.bool_())], ["item", "sketch", "component", "leader", "set", "settled"])

    columns = ["item", "sketch", "set"]
    alone = with_sets(members.where("pieces = 1")).select(F.xxhash64("component").alias("key"), F.lit(False).alias("asked"), *columns)
    links = []
    if members.where("pieces > 1").limit(1).count():
        # A large group in the same way: its texts against the first of them, and those that are not similar to it against all.
        group = stored(with_sets(members.where("pieces > 1")), "sets")
        leaders = group.where("item = leader").dropDuplicates(["component"]).select("component", F.col("set").alias("lead"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = group.withColumn("salt", F.pmod("item", F.lit(SALTS)).cast("int")).join(leaders, ["component", "salt"])
        met = met.select("item", "sketch", "component", "leader", "set", "lead").mapInArrow(lead, "item bigint, sketch binary, component bigint, leader bigint, set binary, settled boolean")
        met = stored(met, "met")
        links.append(met.where("settled and item <> leader").select(F.col("item").alias("a"), F.col("leader").alias("b")))
        alone = alone.unionByName(_against(met, ["component"], "settled", TEXTS).select("key", "asked", *columns))
    links.append(in_order(alone).select("key", F.col("asked").cast("int").alias("asked"), *columns).mapInArrow(compare, "a bigint, b bigint"))
    groups = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("id", "item")
    named = texts.join(groups, "item", "left").select(F.coalesce("component", "item").alias("group"), "best")
    return named.groupBy("group").agg(F.min_by("best", "best.own").alias("b")).select("group", F.col("b.own").alias("own"), F.col("b.n").alias("n"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents (doc_id, text and any other columns) without near-duplicates: of each group (see `similar_groups`) the one with the smallest id stays; of rows
    that repeat it, the one with the smallest MD5 of its text, once. Groups without any id keep one document as well; texts without a word are one group."""
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    at = lambda n: F.col(f"_c{docs.columns.index(n)}")
    best = similar_groups(docs, shingle, similarity).select(F.col("own.doc_id").alias("_id"), F.col("own.key").alias("_key"), F.col("n").alias("_n"))
    keyed = plain.withColumn("_own", F.md5(F.coalesce(at("text").cast("string"), F.lit(""))))
    kept = keyed.join(best, at("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    once = kept.where("_n = 1").unionByName(kept.where("_n > 1").dropDuplicates(["_id", "_key"]))
    return once.select(*plain.columns).toDF(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), shingle=3)
