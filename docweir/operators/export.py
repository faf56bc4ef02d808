"""Documents and their assets as files: archives, one file with everything in it, merged batches."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from docweir.functions.text import base_name
from docweir.sources.archive import pack_files
from docweir.sources.markdown import target

EMBED_BYTES = 20 * 1024 * 1024
_LINK = re.compile(r"\]\(([^)]*)\)")


def artifact_name(name: Column, extension: str = "md") -> Column:
    return F.concat(base_name(name), F.lit(f".{extension}"))


def assets_bytes(assets: Column) -> Column:
    return F.aggregate(F.coalesce(assets, F.array()), F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["size"], F.lit(0)))


def packaging(assets: Column, most: int = EMBED_BYTES) -> Column:
    """md without assets; embedded up to `most` bytes of them; zip beyond."""
    total = assets_bytes(assets)
    return F.when(F.coalesce(F.size(assets), F.lit(0)) <= 0, "md").when(total > most, "zip").otherwise("embedded")


def embed(markdown: str, assets: list[tuple[str, bytes | None, str]]) -> tuple[str, list[str]]:
    """The text with targets of assets, plain or escaped, replaced by data URIs in one pass; and the names of unreadable ones."""
    uris = {}
    for name, content, kind in assets:
        if content is not None:
            uris[name] = uris[target(name)] = f"data:{kind};base64,{base64.b64encode(content).decode()}"
    return _LINK.sub(lambda m: f"]({uris.get(m[1], m[1])})", markdown), [n for n, c, _ in assets if c is None]


def archive(markdown: str, name: str, assets: list[tuple[str, bytes | None, str]]) -> tuple[bytes, list[str]]:
    """A ZIP of the text and every readable asset; and the names of the others."""
    return pack_files([(name, markdown.encode()), *((n, c) for n, c, _ in assets if c is not None)]), [n for n, c, _ in assets if c is None]


_FILE = StructType([StructField("name", StringType()), StructField("content", BinaryType()), StructField("failed", ArrayType(StringType()))])


@F.udf(_FILE, useArrow=True)
def _package(markdown, base, kind, assets):
    files = [(a["name"], a["content"], a["type"]) for a in assets or ()]
    if kind == "zip":
        data, failed = archive(markdown or "", f"{base}.md", files)
        return f"{base}.zip", data, failed
    text, failed = embed(markdown or "", files)
    return f"{base}.md", text.encode(), failed


def package(docs: DataFrame, most: int = EMBED_BYTES) -> DataFrame:
    """(doc_id, name, content, failed, report) for documents (doc_id, name, markdown, assets): one file each."""
    kind = packaging(F.col("assets"), most)
    out = docs.select("doc_id", _package("markdown", base_name(F.col("name")), kind, "assets").alias("f")).select("doc_id", "f.*")
    report = F.when(F.size("failed") > 0, F.concat(F.size("failed").cast("string"), F.lit(" not saved: "), F.array_join("failed", ", ")))
    return out.withColumn("report", report)


def saved_names(files: DataFrame) -> DataFrame:
    """The files (name, content) with saved_as: a name of its own for each. Of files of one name (case counts for nothing), the first by content keeps it and the others get
    a number, as in `a (1).md`; where that is taken, the number and a hash."""
    given = files.select("name", "content", F.lower("name").alias("_key"))
    order = Window.partitionBy("_key").orderBy("name", F.xxhash64("content"))
    numbered = given.withColumn("_k", F.row_number().over(order) - 1)
    stem, ending = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    apart = lambda k: F.concat(F.when(stem == "", F.lit("file")).otherwise(stem), F.lit(" ("), k, F.lit(")"))
    count = F.col("_k").cast("string")
    tried = numbered.withColumn("_try", F.when(F.col("_k") == 0, F.col("name")).otherwise(F.concat(apart(count), ending)))
    taken = given.select(F.col("_key").alias("_taken")).distinct()
    met = tried.join(taken, (F.col("_k") > 0) & (F.lower("_try") == F.col("_taken")), "left")
    other = F.concat(apart(count), F.lit("-"), F.lower(F.hex(F.xxhash64("name", "_k"))), ending)
    return met.select("name", "content", F.when(F.col("_taken").isNull(), F.col("_try")).otherwise(other).alias("saved_as"))


def save_files(files: DataFrame, directory: str) -> DataFrame:
    """Writes files (name, content) under a directory that all executors share; returns (name, saved_as, error) for each, errors kept apart.

    Files of one name are told apart (`saved_names`); one that is there from before is replaced. A file is written under another name, measured and moved,
    so it is whole or not there. A name with a path in it is refused (BAD_NAME), as is a file without content (NO_CONTENT).
    """
    import uuid
    from collections.abc import Iterator

    import pandas as pd

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(directory)
        store.create_dir(top, recursive=True)

        def save(name: str | None, content: bytes | None) -> str | None:
            if not name or name in (".", "..") or any(c in name for c in "/\\\0"):
                return "BAD_NAME"
            if content is None:
                return "NO_CONTENT"
            part = f"{top}/.{uuid.uuid4().hex}"
            try:
                with store.open_output_stream(part) as f:
                    f.write(content)
                if store.get_file_info(part).size != len(content):
                    store.delete_file(part)
                    return "SHORT_WRITE"
                store.move(part, f"{top}/{name}")
            except OSError as e:
                return type(e).__name__
            return None

        for b in batches:
            yield pd.DataFrame({"name": b["name"], "saved_as": b["saved_as"], "error": [save(n, c) for n, c in zip(b["saved_as"], b["content"], strict=True)]})

    out = saved_names(files).mapInPandas(write, "name string, saved_as string, error string")
    return out.withColumn("saved_as", F.when(F.col("error").isNull(), F.col("saved_as")))


def merge_batch(rows: DataFrame, keys: list[str], order: str, name: str, text: str) -> DataFrame:
    """(keys, merged): the texts in order; with more than one, each under a line with its name."""
    part = F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(text).alias("t"))
    joined = lambda f: F.array_join(F.transform(F.col("_p"), f), "\n\n")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("_p")).select(
        *keys, F.when(F.size("_p") > 1, joined(lambda p: F.concat(F.lit("===== "), p.n, F.lit(" =====\n\n"), p.t))).otherwise(joined(lambda p: p.t)).alias("merged"))


def summary(docs: DataFrame, keys: list[str]) -> DataFrame:
    """How many documents went in, came out and failed."""
    return docs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def chosen(docs: DataFrame, selected: Column | None = None) -> DataFrame:
    """The rows that came out, of those selected: what saving all of a list takes."""
    return docs.where(F.col("error").isNull() & (F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))))
