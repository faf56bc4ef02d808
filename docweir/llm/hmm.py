"""Language-model scoring with a hidden Markov model over words."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.session import spread

from .common import partitions, pick, remainder, slices, stored, text_slices

#: Hidden states; words with an emission of their own; classes of all other words, by their ending; words whose counts every worker has.
STATES, SYMBOLS, CLASSES, COUNTED = 8, 20_000, 512, 150_000
#: Passes of Baum-Welch over all training documents at most; the gain in the mean log-likelihood of a symbol that calls for another one.
PASSES, GAIN = 8, 0.005
#: Bytes of the longest words that every worker gets.
WORD_BYTES = 64
#: Symbols of a window, and of what is worked on at a time; axes on which documents are placed for the start of training.
WINDOW, BATCH, AXES = 1024, 600_000, 16
#: Numbers in a piece of a sum.
PIECE = 4096
_FLUSH = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between stretches of space and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Alphabet:
    """Symbols: frequent words, then the end, then the classes of other words; with the counts of the words that are sent along."""

    def __init__(self, counted: list[tuple[str, int]]):
        """counted: words by falling count."""
        words = [w.encode() for w, _ in counted]
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = np.array([c for _, c in counted], np.int64)
        self.n_own = min(SYMBOLS, len(counted))
        self.end, self.size = self.n_own, self.n_own + 1 + CLASSES
        self.classes = np.array([word_class(w) for w in words], np.int32)
        own = np.arange(len(words)) < self.n_own
        # The last place is for words that are not among these; their class is put in where they stand.
        self.symbol = np.append(np.where(own, np.arange(len(words)), self.n_own + 1 + self.classes), 0).astype(np.int32)

    def symbols(self, at: np.ndarray, sizes: np.ndarray, other: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts on end, each with an end, and where each text begins; `at` are the words' places, `classes` those of the `other` words."""
        out = np.full(len(at) + len(sizes), self.end, np.uint16)
        own = self.symbol[at]
        own[other] = self.n_own + 1 + classes
        out[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)] = own
        return out, np.concatenate([[0], np.cumsum(sizes + 1)])

    def read(self, texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
        """The words of each text, and the places of all on end among the counted words, -1 for others."""
        split, found, get, none = [], [np.zeros(0, np.int32)], self.index.get, repeat(-1)
        for t in texts:  # looked up text by text, while its words are still in the processor's cache
            words = words_of(t)
            split.append(words)
            found.append(np.fromiter(map(get, words, none), np.int32, len(words)))
        return split, np.concatenate(found)


class Hmm:
    """start (K), move (K x K) and emit (symbols x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))

    @classmethod
    def of_counts(cls, counts: np.ndarray, size: int, k: int) -> Hmm:
        """From expected counts, laid out as start, moves, emissions; a little is added to each."""
        start, move, emit = counts[:k] + 0.1, counts[k : k + k * k].reshape(k, k) + 0.1, counts[k + k * k :].reshape(size, k) + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, flat: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """log10 likelihood of each whole sequence, which stand on end: the scaled forward recursion, over all windows at once."""
        at, length, place = _windows(sizes, window)
        alpha, _, _ = self._entries(flat, at, length, place == 0)
        order = np.argsort(-length, kind="stable")
        alpha, begin = alpha[order], at[order]
        active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        emit, move, logs = self.emit.astype(np.float64), self.move.astype(np.float64), np.zeros(len(at))
        scale, ones = np.ones(len(at)), np.ones((len(self.start), 1))
        for t, m in enumerate(active):
            alpha = alpha[:m] if t == 0 else alpha[:m] @ move
            alpha = alpha * emit[flat[begin[:m] + t]]
            c = alpha @ ones
            alpha /= c
            scale[:m] *= c[:, 0]
            if t % 16 == 15:  # 16 factors of 1e-9 or so are far from the smallest double
                logs[:m] += np.log10(scale[:m])
                scale[:m] = 1
        out = np.empty(len(at))
        out[order] = logs + np.log10(scale)
        return np.add.reduceat(out, np.nonzero(place == 0)[0]) if len(sizes) else out

    def _entries(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows of whole sequences in turn: state probabilities before the first symbol, those after the last one (both normalised), and the backward
        values after the last (to scale). Windows are run at once, each from every state, and their K x K products chained along the sequence."""
        k, n = len(self.start), len(at)
        last = np.append(first[1:], True)
        enter, leave, back = np.tile(self.start, (n, 1)).astype(np.float64), np.zeros((n, k)), np.ones((n, k))
        several = np.nonzero(~(first & last))[0]  # a sequence of one window needs no chain
        if not len(several):
            return enter, leave, back
        order = several[np.argsort(-length[several], kind="stable")]
        active = np.searchsorted(-length[order], -np.arange(length[order[0]]), side="left")
        turn = np.zeros((n, k, k), np.float32)
        now, every = np.zeros((len(order), k, k), np.float32), np.ones((k * k, 1), np.float32)
        for t, m in enumerate(active):
            emit = self.emit[flat[at[order[:m]] + t]]
            if t == 0:
                now[:, np.arange(k), np.arange(k)] = emit
            else:
                np.multiply((now[:m].reshape(-1, k) @ self.move).reshape(m, k, k), emit[:, None, :], out=now[:m])
            if t % 3 == 2 or t == 0:  # products of a few factors stay far from the smallest float
                now[:m] /= np.maximum(now[:m].reshape(m, -1) @ every, 1e-30)[:, :, None]
        turn[order] = now / np.maximum(now.sum((1, 2), keepdims=True), 1e-30)
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        by_place = [np.nonzero(place == p)[0] for p in range(place.max() + 1)] if place.max() < 64 else np.split(
            np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
        move = self.move.astype(np.float64)
        for w in by_place:
            inner = w[~first[w]]
            enter[inner] = leave[inner - 1] @ move
            enter[inner] /= enter[inner].sum(1, keepdims=True)
            after = (enter[w][:, None, :] @ turn[w])[:, 0]
            leave[w] = after / np.maximum(after.sum(1, keepdims=True), 1e-300)
        for w in reversed(by_place):
            outer = w[~last[w]]
            before = (turn[outer + 1] @ back[outer + 1][:, :, None])[:, :, 0] @ move.T
            back[outer] = before / np.maximum(before.sum(1, keepdims=True), 1e-300)
        return enter, leave, back

    def expected(self, flat: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Expected counts of starts, moves and emissions over whole sequences, which stand on end, and their log-likelihood: one E step of Baum-Welch.

        Sequences are worked on in windows, all at once; forward and backward values are carried over the edges, so the counts are those of the whole sequences.
        """
        k = len(self.start)
        at, length, place = _windows(sizes, window)
        enter, leave, back = self._entries(flat, at, length, place == 0)
        order = np.argsort(-length, kind="stable")
        before = leave[order - 1].astype(np.float32)  # of the window before, in inner ones
        at, length, place, enter, back = at[order], length[order], place[order], enter[order].astype(np.float32), back[order].astype(np.float32)
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        # All steps on end: step t holds the t-th symbols of the windows that are so long, the longest first.
        ends = np.cumsum(active)
        symbols = flat[at[np.arange(ends[-1]) - np.repeat(ends - active, active)] + np.repeat(np.arange(len(active)), active)]
        emitted = self.emit[symbols]
        alpha, scale, ones = np.empty_like(emitted), np.empty((len(emitted), 1), np.float32), np.ones((k, 1), np.float32)
        for t, m in enumerate(active):
            now = slice(ends[t] - m, ends[t])
            a = alpha[now]
            if t:
                np.matmul(alpha[ends[t - 1] - active[t - 1] :][:m], self.move, out=a)
                a *= emitted[now]
            else:
                np.multiply(enter, emitted[now], out=a)
            np.maximum(a @ ones, 1e-30, out=scale[now])
            a /= scale[now]
        likelihood = np.log(scale, dtype=np.float64).sum()
        moves = np.zeros((k, k))
        emitted /= scale
        beta = np.zeros((0, k), np.float32)
        for t in range(len(active) - 1, -1, -1):
            m, done = active[t], len(beta)
            now = slice(ends[t] - m, ends[t])
            if m > done:  # windows that end here
                tail = back[done:m]
                beta = np.concatenate([beta, tail / np.maximum((alpha[now][done:] * tail).sum(1, keepdims=True), 1e-30)])
            step = emitted[now]
            step *= beta
            if t:
                moves += self.move * (alpha[ends[t - 1] - active[t - 1] :][:m].T @ step)
                beta, seen = step @ self.move.T, beta
            else:
                inner = place > 0
                moves += self.move * (before[inner].T @ step[inner])
                seen = beta
            alpha[now] *= seen  # what a step adds to the counts
        emits = np.stack([np.bincount(symbols, w, len(self.emit)) for w in np.ascontiguousarray(alpha.T)], 1)
        return np.concatenate([alpha[: active[0]][place == 0].sum(0), moves.ravel(), emits.ravel(), [likelihood]])


def _windows(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of sequences on end begin, their lengths, and their numbers within the sequence."""
    pieces = -(-sizes // window)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(np.cumsum(sizes) - sizes, pieces) + place * window, np.minimum(window, np.repeat(sizes, pieces) - place * window), place


def word_directions(size: int) -> np.ndarray:
    """A random direction for each symbol; the mean of a document's is its place among documents."""
    return np.random.default_rng(11).standard_normal((size, AXES)).astype(np.float32)


def places(flat: np.ndarray, sizes: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """For each symbol, the sum over its occurrences of the places of their documents, and their number."""
    ends = np.cumsum(sizes)
    mean = (np.add.reduceat(directions[flat], ends - sizes, axis=0) / sizes[:, None]).astype(np.float32)
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    doc = np.repeat(np.arange(len(sizes)), sizes)[order]
    out = np.zeros((len(directions), AXES + 1))
    out[flat[order[first]], :AXES] = np.add.reduceat(mean[doc], first, axis=0)
    out[:, AXES] = np.bincount(flat, minlength=len(directions))
    return out


def first_model(sums: np.ndarray, k: int, steps: int = 50) -> Hmm:
    """A start for training, from the `places` of all training documents: symbols are parted into k groups by the mean place of the documents they occur in
    (k-means, weighted by counts); each state prefers one group and tends to stay."""
    counts = sums[:, -1]
    known = np.nonzero(counts > 0)[0]
    group = np.zeros(len(sums), np.int64)
    if len(known) > k:
        weight = counts[known]
        x = sums[known, :-1] / weight[:, None]
        x = x - np.average(x, axis=0, weights=weight)
        x *= np.sqrt(np.minimum(weight, 100) / 100)[:, None]  # places of rare symbols are noise
        centres = x[[int(np.argmax(weight * (x * x).sum(1)))]]
        while len(centres) < k:  # the next one is where most is far from all others
            far = ((x[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.concatenate([centres, x[[int(np.argmax(weight * far))]]])
        for _ in range(steps):
            own = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
            total = np.bincount(own, weight, k)
            new = np.stack([np.bincount(own, weight * c, k) for c in x.T], 1) / np.maximum(total, 1e-9)[:, None]
            new = np.where(total[:, None] > 0, new, centres)
            if np.abs(new - centres).max() < 1e-6:
                break
            centres = new
        group[known] = own
    else:
        group[known] = np.arange(len(known)) % k
    emit = (counts + 0.05)[:, None] * np.where(group[:, None] == np.arange(k), 1.0, 0.2)
    emit = emit * np.random.default_rng(11).uniform(0.9, 1.1, emit.shape)  # states that came out alike can still part
    move = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(k, 1 / k), move, emit / emit.sum(0))


def _token_batches(column: Iterator[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols on end and sizes of sequences (binary, 16 bits a symbol), about BATCH symbols at a time."""
    for c in column:
        raw = c.to_pylist()
        sizes = list(map(len, raw))
        for lo, hi in slices(sizes, 2 * BATCH):
            yield np.frombuffer(b"".join(raw[lo:hi]), np.uint16).astype(np.int64), np.array(sizes[lo:hi]) // 2


def _sum_of(sequences: DataFrame, work, size: int) -> np.ndarray:
    """The sum over all sequences (column symbols) of the vectors that `work` makes of batches of them: each task sends its own in pieces, which are added up in
    many tasks first and then piece by piece."""
    spark, schema = sequences.sparkSession, "task int, piece int, sums binary"

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        from pyspark import TaskContext

        task = np.full(len(sums), TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(task), pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["task", "piece", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for flat, sizes in _token_batches(b.column(0) for b in batches):
            total += work(flat, sizes)
        yield rows({i: x for i, x in enumerate(np.split(total, range(PIECE, size, PIECE))) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(raw)
                sums[piece] = sums[piece] + x if piece in sums else x
        yield rows(sums)

    found = sequences.select("symbols").mapInArrow(run, schema)
    for by in ("task", "piece"):
        found = found.repartition(partitions(spark), by).mapInArrow(add, schema)
    out = np.zeros(size)
    for r in found.collect():  # as many as the vector has pieces
        x = np.frombuffer(r.sums)
        out[r.piece * PIECE : r.piece * PIECE + len(x)] = x
    return out


def baum_welch(sequences: DataFrame, size: int, states: int = STATES, passes: int = PASSES, gain: float = GAIN) -> tuple[Hmm, list[float]]:
    """A hidden Markov model of all sequences (column symbols: 16 bits each, below `size`), and the mean log-likelihood of a symbol before each pass.

    Each pass is an E step over all whole sequences. Training ends when a pass has raised the mean log-likelihood of a symbol (natural logarithm)
    by less than `gain`, after `passes` passes at most.
    """
    spark = sequences.sparkSession
    directions = word_directions(size)
    sums = _sum_of(sequences, lambda flat, sizes: places(flat, sizes, directions).ravel(), size * (AXES + 1)).reshape(size, AXES + 1)
    model, trace = first_model(sums, states), []
    symbols = sums[:, -1].sum()
    for _ in range(passes if symbols else 0):
        now = spark.sparkContext.broadcast(model)
        counts = _sum_of(sequences, lambda flat, sizes, now=now: now.value.expected(flat, sizes), states + states * states + size * states + 1)
        trace.append(counts[-1] / symbols)
        model = Hmm.of_counts(counts[:-1], size, states)
        if len(trace) > 1 and trace[-1] - trace[-2] < gain:
            break
    return model, trace


def hmm_scores(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Words and one end per document are tokens. Word counts come from all rows for which `train`, a condition on doc_id, holds. The base is their
    smoothed unigram. The model is a hidden Markov chain whose states emit frequent words, the end, or a class of other words
    (by the ending), which yields a word by its smoothed share in the class: a distribution over all known words and one unknown
    a class. Each text is turned into symbols once; Baum-Welch then runs over all whole training documents until the likelihood settles (see
    `baum_welch`), its start too comes from all of them, and expected counts are added up in the workers and then by Spark. Scoring
    runs the scaled forward recursion over each whole text.

    Counts of the COUNTED most frequent words of up to WORD_BYTES go to the workers by broadcast, a fixed bound; counts of all others are joined to the
    documents' words by a shuffle, as is their share of the scores.

    Null or empty text: only the end. Null ids train unless the condition is false for them, and with repeated ids are rows of
    their own. Without training rows, counts are 0 and the base score is 0. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    rows = rows.withColumn("trains", F.coalesce(train, F.lit(True)) if train is not None else F.lit(True))
    learn = rows.where("trains").select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n_docs = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for _, texts in text_slices(batches):
            seen.update(chain.from_iterable(map(words_of, texts)))
            n_docs += len(texts)
            if len(seen) > _FLUSH:
                yield flush()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n_docs], pa.int64())], ["word", "n"])

    counts = stored(learn.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct, ends = counts.agg(F.sum("c"), F.count("word"), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    n_all, ends_all = total or 0, ends or 0
    v_all = distinct + (ends_all > 0)
    known = counts.where("word is not null")
    # How common a word must be to be among the most frequent COUNTED: by a histogram of the counts' logarithms, a few thousand rows.
    bin_of = F.floor(F.log2("c") * 64).cast("int")
    short = F.octet_length("word") <= WORD_BYTES
    room_left, least = COUNTED, None
    for r in sorted(known.where(short).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.bin):
        room_left -= r.n
        if room_left < 0:
            break
        least = r.bin
    top = [] if least is None else sorted(((r.word, r.c) for r in known.where(short & (bin_of >= least)).collect()), key=lambda x: (-x[1], x[0].encode()))
    alphabet = Alphabet(top)

    # What the classes hold: all words without an emission of their own.
    last = top[SYMBOLS - 1] if len(top) >= SYMBOLS else None
    ending = F.expr("substring(cast(word as binary), greatest(octet_length(word) - 2, 1), 3)")
    own = F.lit(False)
    if last:
        own = short & ((F.col("c") > last[1]) | (F.col("c") == last[1]) & (F.col("word") <= last[0]))
    elif least is not None:
        own = short & (bin_of >= least)
    classed = known.where(~own).withColumn("class", (F.crc32(ending) % CLASSES).cast("int"))
    held = {r["class"]: (r.n, r.v) for r in classed.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    room = np.array([0.1 * (held.get(i, (0, 0))[1] + 1) + held.get(i, (0, 0))[0] for i in range(CLASSES)])
    shared = spark.sparkContext.broadcast(alphabet)
    below = n_all + 0.1 * (v_all + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as symbols, with the sums over its counted words, and its other words with their numbers."""
        from pyspark import TaskContext

        book, row = shared.value, TaskContext.get().partitionId() << 33
        logs = np.append(np.log10((book.counts + 0.1) / below), 0)
        shares = np.append(np.where(np.arange(len(book.counts)) < book.n_own, 0, np.log10((book.counts + 0.1) / room[book.classes])), 0)
        end = math.log10((ends_all + 0.1) / below)
        for ids, trains, texts in text_slices(batches, 2):
            split, at = book.read(texts)
            flat = list(chain.from_iterable(split))
            n, sizes = len(texts), np.array([len(w) for w in split], np.int64)
            doc = np.repeat(np.arange(n), sizes)
            sums = lambda x, doc=doc, n=n: np.bincount(doc, x, n)
            other = np.nonzero(at < 0)[0]
            rest = list(map(flat.__getitem__, other.tolist()))
            symbols, begin = book.symbols(at, sizes, other, np.fromiter(map(word_class, rest), np.int64, len(rest)))
            raw = memoryview(symbols.tobytes())
            cuts, words, times = np.searchsorted(doc[other], np.arange(n + 1)), [], []
            ends = [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    seen = Counter(rest[lo:hi])
                    words += seen
                    times += seen.values()
                ends.append(len(words))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(n)), pa.array(ids, pa.int64()), pa.array(trains), pa.array(sizes + 1),
                pa.array((sums((at >= 0).astype(float)) + (ends_all > 0)).astype(np.int64)), pa.array(end + sums(logs[at])), pa.array(sums(shares[at])),
                pa.array([raw[2 * a : 2 * b] for a, b in zip(begin, begin[1:])], pa.binary()), *lists],
                ["row", "doc_id", "trained", "n_tokens", "own", "base", "share", "symbols", "words", "times"])
            row += n

    parts = stored(rows.select("doc_id", "trains", "text").mapInArrow(
        encode, "row bigint, doc_id bigint, trained boolean, n_tokens bigint, own bigint, base double, share double, symbols binary, words array<string>, "
        "times array<int>"), "parts")
    model, _ = baum_welch(parts.where("trained"), alphabet.size, STATES, passes)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [np.zeros(0)] + [final.value.log10(flat, sizes) for flat, sizes in _token_batches(iter([b.column(6)]))]
            made = np.concatenate(logs) + b.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(made)], ["row", "doc_id", "trained", "n_tokens", "own", "base", "score"])

    scored = parts.select("row", "doc_id", "trained", "n_tokens", "own", "base", "symbols", "share").mapInArrow(
        score, "row bigint, doc_id bigint, trained boolean, n_tokens bigint, own bigint, base double, score double")
    c = F.coalesce(F.col("c"), F.lit(0))
    each = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("tf"))
    in_class = F.element_at(F.lit(room.tolist()), (F.crc32(ending) % CLASSES + 1).cast("int"))
    tail = each.join(known.hint("shuffle_hash"), "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.col("tf") * F.log10((c + 0.1) / below)).alias("tail_base"),
        F.sum(F.col("tf") * F.log10((c + 0.1) / in_class)).alias("tail_score"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    out = scored.join(tail, "row", "left")
    return out.select("doc_id", "trained", "n_tokens", plus("own", "tail_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
                      plus("base", "tail_base"), plus("score", "tail_score")).toDF(
        "doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    out = hmm_scores(docs, train=~held)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
