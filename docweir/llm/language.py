"""Language identification as inference of a mixture of languages."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.session import spread

from .common import pick, remainder, stored, text_slices

#: Buckets of hashed byte trigrams; words a worker remembers; languages a model may have (256 KB each), beyond which learning is refused.
BUCKETS, REMEMBERED, LANGUAGES = 1 << 16, 300_000, 256
#: Bytes of text worked on at a time.
SLICE = 1 << 20
#: EM steps for a set of languages; share at which a language enters it.
STEPS, ENTRY = 8, 0.1
#: The logarithm of a trigram's likelihood in letters at random, each bucket as likely as any other.
CHANCE = -math.log(BUCKETS)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word with a space on either side, on end, and where each word's begin."""
    buf = np.frombuffer(b" " + b" ".join(w.encode() for w in words) + b" ", np.uint8).astype(np.int64)
    mid = np.nonzero(buf != 32)[0]
    code = (buf[mid - 1] << 16 | buf[mid] << 8 | buf[mid + 1]) * 2_654_435_761 >> 13 & (BUCKETS - 1)
    starts = np.nonzero(buf[mid - 1] == 32)[0]
    return code, starts


def _letters(word: str) -> bool:
    return any(map(str.isalpha, word))


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for langs, texts in text_slices(batches, 1, SLICE):
            words: dict[str, Counter] = {}
            for lang, text in zip(langs, texts, strict=True):
                if text:
                    words.setdefault(lang, Counter()).update(text.lower().split())
            for lang, seen in words.items():
                kept = [w for w in seen if _letters(w)]
                if kept:
                    code, starts = trigrams(kept)
                    times = np.repeat([seen[w] for w in kept], np.diff(np.append(starts, len(code))))
                    sums[lang] = sums.get(lang, 0) + np.bincount(code, times, BUCKETS)
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                                             ["lang", "bucket", "n"])

    return docs.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Word likelihoods of each language, and EM over the words of documents."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs
        self.known: dict[str, int] = {}
        # By word: likelihoods as shares of the greatest one; the logarithm of that, and how many trigrams it is of.
        self.table, self.level = np.zeros((1024, len(langs)), np.float32), np.zeros((1024, 2), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of the word table; -1 for words without a letter."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            lettered = [w for w in new if _letters(w)]
            known.update((w, -1) for w in new)
            base = len(known)
            if lettered:
                code, starts = trigrams(lettered)
                logs = np.add.reduceat(self.logs[code], starts, axis=0)
                if base + len(lettered) > len(self.table):
                    self.table, self.level = (np.concatenate([x, np.zeros((base + len(lettered) - len(x), x.shape[1]), np.float32)]) for x in (self.table, self.level))
                at = base - len(lettered) + np.arange(len(lettered))
                top = logs.max(1, keepdims=True)
                self.table[at] = np.exp(logs - top)
                self.level[at, 0], self.level[at, 1] = top[:, 0], np.diff(np.append(starts, len(code)))
                known.update(zip(lettered, at.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _em(like: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of each document's languages after STEPS steps, the likelihood of each word under them, and each document's log-likelihood."""
        for _ in range(STEPS):
            joint = like * np.repeat(share, sizes, axis=0)
            joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
        mix = np.maximum((like * np.repeat(share, sizes, axis=0)).sum(1), 1e-30)
        return share, mix, np.add.reduceat(np.log(mix), starts)

    def _grow(self, like: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Shares of the languages of each document, whose words are on end.

        A set of languages starts with the one that fits best alone. The next one is that which raises the likelihood most if it enters with a
        share of ENTRY; EM then fits the shares of the set. The set grows as long as the likelihood rises by more than the penalty, to
        all languages if need be.
        """
        n, k = len(sizes), len(self.langs)
        starts = np.cumsum(sizes) - sizes
        single = np.add.reduceat(np.log(np.maximum(like, 1e-30)), starts, axis=0)
        best = np.zeros((n, k), np.float32)
        best[np.arange(n), single.argmax(1)] = 1
        fit = single.max(1)
        growing, words, share = np.arange(n), like, best
        mix = np.maximum((words * np.repeat(share, sizes, axis=0)).sum(1), 1e-30)
        for size in range(1, k):
            own = sizes[growing]
            at = np.cumsum(own) - own
            with np.errstate(divide="ignore"):
                gain = np.add.reduceat(np.log((1 - ENTRY) + ENTRY * words / mix[:, None]), at, axis=0)
            gain[share > 0] = -np.inf
            start = share * (1 - ENTRY)
            start[np.arange(len(growing)), gain.argmax(1)] = ENTRY
            new, mix, now = self._em(words, at, own, start)
            better = now - 2 * np.log(own + 1) > fit[growing]  # each further language must pay for itself
            if not better.any():
                break
            inner = np.repeat(better, own)
            growing, share, words, mix = growing[better], np.maximum(new[better], 1e-9 * (start[better] > 0)), words[inner], mix[inner]
            fit[growing] = now[better] - 2 * np.log(own[better] + 1)
            best[growing] = new[better]
        return best

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
        """The main language of each text, its share, the set with its shares, and the share of its words that are likelier under
        the mixture than letters at random."""
        out, score, sets, sense = ["und"] * len(texts), np.zeros(len(texts)), [""] * len(texts), np.full(len(texts), np.nan)
        split = [(t or "").lower().split() for t in texts]
        if not self.langs:
            return out, score, sets, np.where([any(map(_letters, words)) for words in split], 1.0, np.nan)
        numbers = self._numbers([w for words in split for w in words])
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])[numbers >= 0]
        if not len(doc):
            return out, score, sets, sense
        numbers = numbers[numbers >= 0]
        docs, starts, sizes = np.unique(doc, return_index=True, return_counts=True)
        like = self.table[numbers]
        best = self._grow(like, sizes)
        main = best.argmax(1)
        order = np.argsort(-best, axis=1, kind="stable")
        for i, d in enumerate(docs):
            out[d] = self.langs[main[i]]
            sets[d] = ",".join(f"{self.langs[j]}:{best[i, j]:.3f}" for j in order[i] if best[i, j] >= 0.01)
        score[docs] = np.clip(best[np.arange(len(docs)), main], 0, 1)
        level, grams = self.level[numbers].T
        mix = np.maximum((like * np.repeat(best, sizes, axis=0)).sum(1), 1e-30)
        sense[docs] = np.add.reduceat((level + np.log(mix) > grams * CHANCE).astype(float), starts) / sizes
        return out, score, sets, sense


def mixture_language(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, lang_mix, sense.

    Learns byte-trigram counts of every language over all rows with a language for which `train` (a condition on doc_id)
    holds; they are added up in the workers and then by Spark, and take 65,536 buckets a language at most. Each text is a
    mixture of languages: EM over its words finds the shares of a set of languages, which grows one by one, without a limit, while each
    one raises the log-likelihood by more than a penalty. The one with the greatest share is the prediction, the share its score, lang_mix
    lists the set, and sense is the share of the words with a letter that are likelier under the mixture than letters at random. The model goes to the workers by broadcast, 256 KB a language; more than LANGUAGES values of the language column are refused.

    Null texts and those without a letter give `und`, score 0 and a null sense. Without any language to learn, all give `und` and score 0; sense is 1 for texts with
    a letter then. Null and repeated ids are rows of their own. An empty table gives no rows; other columns are ignored. `keep` leaves out doc_id's name and returns all
    columns of the input beside the results, under names starting with an underscore.
    """
    spark = docs.sparkSession
    rows = pick(docs, **{id_col: "bigint", text_col: "string", lang_col: "string"}).toDF("doc_id", "text", "lang")
    learn = rows.where("lang is not null and text is not null")
    if train is not None:
        learn = learn.where(F.coalesce(train, F.lit(False)))
    counted = stored(count_trigrams(learn.select("lang", "text")), "trigrams")
    langs = sorted(r.lang for r in counted.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are named; clean the column {lang_col} or raise LANGUAGES")
    found = counted.toPandas()
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[found["bucket"].to_numpy(int), np.searchsorted(langs, found["lang"]) if langs else []] += found["n"].to_numpy(float)
    model = spark.sparkContext.broadcast((langs, np.log(counts / counts.sum(0)).astype(np.float32)))

    frame = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns)))) if keep else rows.select("doc_id", "text")
    at = docs.columns.index(text_col) if keep else 1
    fields = [*frame.schema.fields]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(*model.value)
        for b in batches:
            done = 0
            for (texts,) in text_slices(iter([b.select([at])]), 0, SLICE):
                lang, score, mix, sense = mixture.predict(texts)
                part = b.slice(done, len(texts))
                done += len(texts)
                columns = part.columns if keep else part.columns[:1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang), pa.array(score), pa.array(mix), pa.array(sense, from_pandas=True)], names)

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    given = fields if keep else fields[:1]
    extra = [StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("lang_mix", StringType()), ("sense", DoubleType()))]
    names = [f.name for f in [*given, *extra]]
    return frame.mapInArrow(predict, StructType([*given, *extra]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = mixture_language(docs, train=~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "lang_mix")
