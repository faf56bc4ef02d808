"""Quality classification by co-training of a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.session import spread

from .common import partitions, pick, slices, text_slices

#: Labelled rows (about so many, with the smallest hashes of their ids) that the classifiers are fitted on; hashed byte trigrams of the text view; one-hot places
#: for source and language in the metadata view.
LABELLED, GRAMS, SOURCES, LANGS = 3000, 2048, 64, 32
#: Sides of random planes that part the pseudo-labelled rows of a class into groups, 2 ** PLANES of them; fixed point of their sums of features.
PLANES, UNIT = 4, 1 << 20


#: Bytes of text worked on at a time.
PIECE = 1 << 20


def _counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the counts of its trigrams by bucket, two spaces after its end, and of line feeds, upper-case letters, digits, spaces and
    other ASCII that is no letter. Texts are cut into pieces that see two bytes on, so a long one takes no more memory."""
    grams, kinds = np.zeros((len(raw), GRAMS)), np.zeros((len(raw), 5), np.int64)
    pieces = [(i, at) for i, r in enumerate(raw) for at in range(0, len(r), PIECE)]
    sizes = [min(PIECE, len(raw[i]) - at) + 2 for i, at in pieces]
    for lo, hi in slices(sizes, PIECE):
        group = pieces[lo:hi]
        buf = np.frombuffer(b"".join((raw[i][at : at + PIECE + 2] + b"  ")[:n] for (i, at), n in zip(group, sizes[lo:hi], strict=True)), np.uint8)
        length = np.array(sizes[lo:hi])
        ends = np.cumsum(length)
        own = np.ones(len(buf), bool)
        own[ends - 1] = own[ends - 2] = False  # the bytes on are for trigrams only
        at = np.nonzero(own)[0]
        row = np.repeat(np.arange(len(group)), length - 2)
        wide = buf.astype(np.int64)
        code = ((wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2]) * 2_654_435_761 >> 12) % GRAMS
        first = group[0][0]
        doc = np.array([i - first for i, _ in group])
        n = int(doc[-1]) + 1
        grams[first : first + n] += np.bincount(doc[row] * GRAMS + code, minlength=n * GRAMS).reshape(n, GRAMS)
        byte = buf[at]
        feed, upper, lower = byte == 10, (byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122)
        digit, space = (byte >= 48) & (byte <= 57), (byte == 32) | (byte == 10)
        for k, mask in enumerate((feed, upper, digit, space, (byte < 128) & ~(upper | lower | digit | space))):
            kinds[first : first + n, k] += np.bincount(doc[row], mask, n).astype(np.int64)
    return grams, kinds


def views(texts: list[str | None], sources: list[str | None], langs: list[str | None], chars: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views, which share nothing: root frequencies of hashed byte trigrams, size and layout of the text; source, language and the size
    that the page's metadata state."""
    raw = [(t or "").encode() for t in texts]
    n, size = len(raw), np.array([len(r) for r in raw], np.int64)
    grams, kinds = _counts(raw)
    lines, share = kinds[:, 0] + 1, kinds[:, 1:] / np.maximum(size, 1)[:, None]
    layout = [np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, *(4 * share.T)]
    text = np.concatenate([np.sqrt(grams / np.maximum(size, 1)[:, None]), np.stack(layout, 1)], 1).astype(np.float32)
    meta = np.zeros((n, SOURCES + LANGS + 1), np.float32)
    for i, (s, lang) in enumerate(zip(sources, langs, strict=True)):
        meta[i, zlib.crc32((s or "").encode()) % SOURCES] = 1
        meta[i, SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    meta[:, -1] = np.log1p(np.array([c or 0 for c in chars], float).clip(0)) / 10
    return text, meta


def fit_logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, start: np.ndarray | None = None, steps: int = 400, ridge: float = 1e-6) -> np.ndarray:
    """Weights and intercept of a logistic regression on rows that count so often, by accelerated gradient steps; both classes weigh the same."""
    d = x.shape[1]
    weight = (0.5 * count / np.where(y > 0, max(1e-9, count[y > 0].sum()), max(1e-9, count[y <= 0].sum()))).astype(np.float32)
    w = v = np.zeros(d + 1, np.float32) if start is None else start
    rate = 4 / max(1e-6, float((weight * ((x * x).sum(1) + 1)).sum()))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30)))
        g = weight * (p - y)
        new = v - rate * np.append(x.T @ g + ridge * v[:-1], g.sum()).astype(np.float32)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def calibrate(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log-odds (Platt), from rows that were not trained on; the slope is not negative."""
    a, b = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target = np.where(y > 0, hi, lo)
    scale = max(1e-9, float(np.abs(scores).max(initial=0)))
    s = scores / scale
    for _ in range(100):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * s).sum() + 1e-3 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a / scale, b) if a > 0 else (0.0, float(np.log(hi / (1 - hi)) if y.all() else np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


@dataclass
class CoTrained:
    """Weights of both views, their calibrations and the log-odds of the labels; with the planes of both views, for groups."""

    weights: tuple[np.ndarray, np.ndarray]
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    planes: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

    def odds(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of each view and of both together."""
        each = [a * (v @ w[:-1] + w[-1]) + b for v, w, (a, b) in zip(x, self.weights, self.scales, strict=True)]
        return each[0], each[1], each[0] + each[1] - self.prior

    def pseudo(self, x: tuple[np.ndarray, np.ndarray], sure: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """What each view hands to the other: (receiving view, class and group as one number, the rows), for rows whose calibrated probability of a class
        is `sure` or more."""
        least = np.log(sure / (1 - sure))
        for to, odds in ((1, self.odds(x)[0]), (0, self.odds(x)[1])):
            direction, middle = self.planes[to]
            group = ((x[to] @ direction > middle) << np.arange(PLANES)).sum(1)
            bucket = np.where(odds >= least, group + (1 << PLANES), np.where(odds <= -least, group, -1))
            for b in np.unique(bucket[bucket >= 0]).tolist():
                yield to, b, np.nonzero(bucket == b)[0]


class Trainer:
    """Fits both views on labelled rows and on the sums of pseudo-labelled ones. A fifth of the labelled rows is for calibration."""

    def __init__(self, x: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        hold = np.arange(len(y)) % 5 == 4
        if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
            hold = np.zeros(len(y), bool)
        self.x, self.y, self.fit_on, self.check = x, y, ~hold, hold if hold.any() else ~hold
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        rng = np.random.default_rng(13)
        turns = [rng.standard_normal((v.shape[1], PLANES)).astype(np.float32) for v in x]
        self.planes = tuple((t, np.median(v @ t, axis=0)) for v, t in zip(x, turns, strict=True))
        self.weights: list = [None, None]

    def fit(self, handed: tuple[dict[int, tuple[int, np.ndarray]], ...] = ({}, {})) -> CoTrained:
        """`handed`, by view: class and group -> rows and mean of their features. The pseudo-labelled rows of a class weigh as much as its labelled ones,
        whatever their number."""
        scales = []
        for v in (0, 1):
            y = self.y[self.fit_on]
            x, given, count = [self.x[v][self.fit_on]], [y], [np.ones(len(y))]
            for label in (0, 1):
                mine = [handed[v][b] for b in sorted(handed[v]) if b >> PLANES == label]
                if mine:
                    n = np.array([n for n, _ in mine], float)
                    x.append(np.stack([m for _, m in mine]).astype(np.float32))
                    given.append(np.full(len(n), label))
                    count.append(n / n.sum() * max(1, (y == label).sum()))
            self.weights[v] = fit_logistic(np.concatenate(x), np.concatenate(given).astype(np.float32), np.concatenate(count), self.weights[v])
            scales.append(calibrate(self.x[v][self.check] @ self.weights[v][:-1] + self.weights[v][-1], self.y[self.check]))
        return CoTrained(tuple(self.weights), tuple(scales), self.prior, self.planes)


def co_trained_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: bool = False, rounds: int = 3, sure: float = 0.9,
                       labelled: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, score (probability of good quality), text_score, meta_score, kept (score >= threshold).

    Two logistic classifiers, over the text's trigrams and layout and over the metadata (source, language, stated size), are fitted on about
    `labelled` labelled rows, those with the smallest hashes of their ids: that bound is the only sample. In each of `rounds` rounds, a pass over all other rows
    scores both views, and each view gives the other pseudo-labels for every row whose calibrated probability of a class is `sure` or more. Workers
    add up the features of such rows by class and group (sides of random planes), in fixed point, so the sums do not depend on the order;
    the receiving view is fitted on the groups' means beside the labelled rows. Rounds end early when the pseudo-labels stay the same. Calibrated on labelled
    rows held back, the views' log-odds add up (less the prior once), and all whole texts are scored in one pass; the model is 9 KB.

    A null quality is no label; of several labels of an id the smallest counts, and of several rows of a labelled id the one with the smallest hash is learned
    from. Without labels of both classes, the score is the share of good labels, or 0.5 without any, so all rows stay. Null text counts as
    empty, null metadata as their own value; null and repeated ids are rows of their own. An empty table gives no rows; other columns are
    ignored. `keep` returns all columns of the input, under names starting with an underscore, beside the results.
    """
    spark = docs.sparkSession
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    rows = pick(docs, **kinds)
    known = pick(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min((F.col("quality") > 0).cast("int")).alias("y"))
    here = known.join(rows.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    # A filter by hash, not a sort, so no task sees more than its share.
    share = min(1.0, labelled / max(1, here.count()))
    chosen = here.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    y_of = {r.doc_id: r.y for r in sorted(chosen.collect())}
    wanted = spark.createDataFrame([(i,) for i in y_of] or [(None,)], "doc_id bigint")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, *columns in text_slices(batches, each=GRAMS * 4):
            text, meta = views(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([t.tobytes() for t in text]), pa.array([m.tobytes() for m in meta])],
                                             ["doc_id", "t", "m"])

    values = list(kinds)[1:]
    sample = rows.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64(*values).alias("h"), *values)).alias("one")).select("doc_id", *(f"one.{v}" for v in values))
    got = sorted((r.doc_id, r.t, r.m) for r in sample.mapInArrow(features, "doc_id bigint, t binary, m binary").collect())
    y = np.array([y_of[i] for i, *_ in got], np.int64)
    model, trainer = None, None
    if len(set(y.tolist())) == 2:
        trainer = Trainer(tuple(np.stack([np.frombuffer(r[k], np.float32) for r in got]) for k in (1, 2)), y)
        model = trainer.fit()
    learned = spark.sparkContext.broadcast(np.array([i for i, *_ in got], np.int64))

    def merged(parts: DataFrame, *by: str) -> DataFrame:
        """Rows of a view and bucket added up, in the tasks that `by` deals them to."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for to, bucket, raw in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    sums[to, bucket] = sums.get((to, bucket), 0) + np.frombuffer(raw, np.int64)
            yield handed_rows(sums)

        return parts.repartition(partitions(spark), *by).mapInArrow(add, "task int, view int, bucket int, sums binary")

    def handed_rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        from pyspark import TaskContext

        task = np.full(len(sums), TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(task), pa.array([v for v, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()),
                                           pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["task", "view", "bucket", "sums"])

    def hand_over(now) -> dict[tuple[int, int], np.ndarray]:
        """By view and bucket, the sums of features of the pseudo-labelled rows of all but the learned ids, and their number at the end. A task has at most
        2 views * 2 classes * groups of them, whatever its input; they are added up in many tasks first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, mine = now.value, learned.value
            sums: dict[tuple[int, int], np.ndarray] = {}
            for of, *columns in text_slices(batches, each=GRAMS * 4):
                free = np.array([i is None for i in of]) | ~np.isin(np.array([i or 0 for i in of], np.int64), mine)
                x = tuple(v[free] for v in views(*columns))
                for to, bucket, at in model.pseudo(x, sure):
                    total = np.rint(x[to][at].astype(np.float64) * UNIT).astype(np.int64).sum(0)
                    sums[to, bucket] = sums.get((to, bucket), 0) + np.append(total, len(at))
            yield handed_rows(sums)

        parts = merged(rows.mapInArrow(run, "task int, view int, bucket int, sums binary"), "task")
        return {(r.view, r.bucket): np.frombuffer(r.sums, np.int64) for r in sorted(merged(parts, "view", "bucket").collect())}

    before = None
    for _ in range(rounds if trainer else 0):
        handed: tuple[dict, dict] = ({}, {})
        for (view, bucket), sums in hand_over(spark.sparkContext.broadcast(model)).items():
            handed[view][bucket] = int(sums[-1]), sums[:-1] / (UNIT * sums[-1])
        model = trainer.fit(handed)
        now = [(v, b, n) for v in (0, 1) for b, (n, _) in handed[v].items()]
        if now == before:
            break
        before = now
    flat = float(y.mean()) if len(y) else 0.5
    sent = spark.sparkContext.broadcast(model)

    frame = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns)))) if keep else None
    if keep:
        frame = frame.withColumns({f"_v{i}": (F.col(f"_c{docs.columns.index(n)}") if n in docs.columns else F.lit(None)).cast(t) for i, (n, t) in enumerate(kinds.items())})
    else:
        frame = rows
    n_given = len(docs.columns) if keep else 1
    at = len(docs.columns) if keep else 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            done = 0
            for columns in text_slices(iter([b.select(list(range(at + 1, at + 5)))]), 0, each=GRAMS * 4):
                part = b.slice(done, len(columns[0]))
                done += len(columns[0])
                odds = model.odds(views(*columns)) if model else [np.full(part.num_rows, np.log((flat + 1e-9) / (1 - flat + 1e-9)))] * 3
                text, meta, p = (1 / (1 + np.exp(-np.clip(o.astype(float), -500, 500))) for o in odds)
                p = p if model else np.full(part.num_rows, flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_given], *(pa.array(v) for v in (p, text, meta, p >= threshold))], names)

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    given = frame.schema.fields[:n_given]
    extra = [StructField(n, t) for n, t in (("score", DoubleType()), ("text_score", DoubleType()), ("meta_score", DoubleType()), ("kept", BooleanType()))]
    names = [f.name for f in [*given, *extra]]
    return frame.mapInArrow(score, StructType([*given, *extra]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_trained_quality(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
