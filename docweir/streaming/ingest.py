"""Conversions as files arrive, newest-request-wins, and a bounded history kept by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweir.operators.history import LIMIT, append
from docweir.plans.convert import convert
from docweir.sources.files import stream_files


def convert_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, glob: str | None = None) -> StreamingQuery:
    """Converts what has arrived since the last run and ends; the sink is partitioned by type. A batch is written under its number, so a
    batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").partitionBy("type").parquet(f"{sink}/batch={number}")

    return stream_files(spark, source, glob).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_uri(events: DataFrame, key: str = "uri", time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Events without repeated deliveries; state is let go of with the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def latest_by_seq(events: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Of each key the event with the greatest number; the state is one row per key."""
    payload = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(payload, F.coalesce(F.col(seq), F.lit(-1))).alias("_p")).select(key, "_p.*")


def history_sink(spark: SparkSession, directory: str, limit: int = LIMIT, keep: Callable[[], bool] = lambda: True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest records. Each batch writes a new version of the table, whole or not at all, so a failed batch leaves the
    version before it in place; older ones than that go. A batch that the same query (the same checkpoint) has already written changes nothing; the first batches of a
    query with a new checkpoint go on from what is there."""

    def write(batch: DataFrame, number: int) -> None:
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        done = _versions(spark, directory)
        if not keep() or any(name.endswith(f"-{query}-{number}") for _, name in done):
            return
        new = batch.withColumn("ins_seq", F.lit((done[-1][0] if done else 0) + 1).cast("bigint") * (1 << 32) + F.monotonically_increasing_id() % (1 << 32))
        before = spark.read.parquet(f"{directory}/{done[-1][1]}") if done else new.limit(0)
        name = f"v={done[-1][0] + 1 if done else 1}-{query}-{number}"
        append(before, new, True, limit).coalesce(1).write.mode("overwrite").parquet(f"{directory}/{name}")
        top = spark._jvm.org.apache.hadoop.fs.Path(directory)
        for _, old in done[:-1]:
            top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{old}"), True)

    return write


def _versions(spark: SparkSession, directory: str) -> list[tuple[int, str]]:
    """Numbers and names of the whole versions, in order."""
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(directory)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(top)] if store.exists(top) else []
    return sorted((int(n[2:].split("-")[0]), n) for n in names if n.startswith("v=") and store.exists(jvm.Path(f"{directory}/{n}/_SUCCESS")))


def read_history(spark: SparkSession, directory: str) -> DataFrame:
    """The newest whole version."""
    return spark.read.parquet(f"{directory}/{_versions(spark, directory)[-1][1]}")
