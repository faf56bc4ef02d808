"""Files as rows: (doc_id, name, length, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

BINARY_FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()),
                          StructField("content", BinaryType())])


def _named(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files. A filter on the length goes to the scan, and unread columns are not loaded, so the size guard reads no content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def stream_files(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true")
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))
