"""A corpus pipeline: each stage works on all documents its predecessor kept, with the operators of docweir.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm import language, line_dedup, packing, quality, simhash, words
from docweir.llm.common import Scratch, drop_table

#: Kept documents keep all columns of `documents`, in their order and types.


def _named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the input, which operators number, under their names."""
    return kept.select(*(F.col(f"_c{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those most of whose words are no likelier in any mixture of the learned languages than letters at random. Where no
    language can be learned, only the former."""
    return _named(language.mixture_language(docs, keep=True).where("sense >= 0.5"), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained classifier scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _named(quality.co_trained_quality(docs, labels, keep=True).where("kept"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in 10 documents or more from all but the first of them, so that one of each group of copies keeps its text; a document's
    text and n_chars are those of what stays."""
    out = line_dedup.repeated_lines(docs, min_docs=10, keep=True)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(*(made.get(n, F.col(f"_c{i}")).alias(n) for i, n in enumerate(docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five words, similarity of 0.8 or more) the document with the smallest id."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack_documents(docs, words.tokenizer_path())


STAGES = [("language_id", language_id), ("quality", quality_filter), ("line_dedup", dedup_lines), ("simhash_near_dedup", near_dedup),
          ("packing", pack)]

#: Learned models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's own tables and its input go as soon as its result is written."""
    given = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scratch() as scratch:
            made = scratch.finish(stage(spark, docs, sf_dir), name)
        if docs is not given:
            drop_table(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
