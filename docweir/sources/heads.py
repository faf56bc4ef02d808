"""The first bytes of files, for questions that need no more: a listing with types reads 64 KiB of a file instead of all of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweir.functions.sniffing import HEAD, guard, sniff

#: Files a task reads the heads of.
FILES = 500


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("head", HEAD))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(top)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top, recursive=True))
        files = [(f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Files(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.paths:
            with store.open_input_file(path) as f:
                head = f.read(self.size)
                last = head[-1:]
                if size > len(head):
                    f.seek(size - 1)
                    last = f.read(1)
            yield path, size, head, last


class HeadSource(DataSource):
    """spark.read.format("file_heads").option("path", uri).load()"""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length bigint, head binary, last binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)


def file_types(spark: SparkSession, uri: str) -> DataFrame:
    """(path, length, type, detail, ole2_subtype, error) of the files below a URI that pyarrow opens."""
    spark.dataSource.register(HeadSource)
    rows = spark.read.format("file_heads").option("path", uri).load()
    kind = F.explode(F.array(sniff(F.col("head"), F.col("length"), F.col("last"))))
    return rows.select("path", "length", kind.alias("s")).select("path", "length", "s.*", guard(F.col("length")).alias("error"))
