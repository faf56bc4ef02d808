"""Sessions with the settings that the library's results and plans rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole files: batches of few rows and of bounded bytes keep a worker's memory bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def session(master: str | None = None, name: str = "docweir", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt to all of them before costly work; any other as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def fixed(df: DataFrame) -> DataFrame:
    """The rows in the partitions they are in now, whatever is made of them: all that is built on it reads one and the same shuffle, of which no columns are left out and
    no partitions are merged later. What comes before that shuffle is run once, when this is called; nothing is told of its size, so joins do not take it for small."""
    spark, frame = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False), spark)
