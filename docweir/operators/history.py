"""The bounded table of past conversions: records(id, name, uri, bytes, mime, kind, created_at, ins_seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions.text import name_matches
from docweir.session import fixed

LIMIT, KINDS, VERSION = 200, ("md", "zip"), 1
RECORD = "struct<id:string,name:string,uri:string,bytes:double,mime:string,kind:string,createdAt:double>"


def newest_first() -> list[Column]:
    """Later first; of one moment, what was put in later."""
    return [F.desc("created_at"), F.desc("ins_seq")]


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place in a total order, from 1. Ranges of the order are numbered apart and take up where the ranges before them end, so no task sees all rows.

    Spark draws the ranges from a sample, another one each time the plan is run; sizes and places have to be of the same ranges.
    """
    ranged = fixed(rows.repartitionByRange(*order))
    sizes = ranged.groupBy(F.spark_partition_id().alias("_range")).agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    # Of this id, the lower 33 bits count the rows of a partition, and the others are the partition's number.
    placed = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return placed.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_range")).withColumn(name, place).select(*rows.columns, name)


def listing(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The records with their place in the list."""
    if not keys:
        return numbered(records, "place", *newest_first()).withColumn("place", F.col("place").cast("int"))
    return records.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first())))


def evict(records: DataFrame, limit: int = LIMIT, keys: list[str] | None = None) -> DataFrame:
    """The newest `limit` records, of each key if there are keys: Spark keeps only that many per task before it shuffles."""
    if not keys:
        return records.orderBy(*newest_first()).limit(limit)
    return listing(records, keys).where(F.col("place") <= limit).drop("place")


def valid(records: DataFrame) -> Column:
    """Whether a record may be in the history; on append, bytes must be over 0 besides."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    count = lambda c: F.coalesce((F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    return filled("id") & filled("name") & filled("uri") & F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & count("bytes") & count("created_at")


def normalized(records: DataFrame) -> DataFrame:
    """Whole numbers, and a type for every record."""
    default = F.when(F.col("kind") == "zip", "application/zip").otherwise("text/markdown")
    return records.withColumns({"bytes": F.floor("bytes").cast("bigint"), "created_at": F.floor("created_at").cast("bigint"),
                                "mime": F.coalesce(F.nullif(F.col("mime"), F.lit("")), default)})


def new_records(files: DataFrame, name: str = "name", uri: str = "path", size: str = "length", kind: str = "kind") -> DataFrame:
    """Records for saved files: a random id, the time of the query, in the order of the uri. Ids and times differ from run to run."""
    return numbered(files, "ins_seq", F.col(uri)).select(
        F.expr("uuid()").alias("id"), F.col(name).alias("name"), F.col(uri).alias("uri"), F.col(size).cast("double").alias("bytes"), F.lit("").alias("mime"),
        F.col(kind).alias("kind"), F.unix_millis(F.current_timestamp()).alias("created_at"), F.col("ins_seq").cast("bigint").alias("ins_seq"))


def append(records: DataFrame, new: DataFrame, keep: bool = True, limit: int = LIMIT) -> DataFrame:
    """The history with new records, and the oldest gone beyond the limit; unchanged if history is off."""
    if not keep:
        return records
    good = normalized(new.where(valid(new) & (F.col("bytes") > 0)))
    return evict(records.unionByName(good.select(*records.columns)), limit)


def remove(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id").distinct(), "id", "left_anti").select(*records.columns)


def removals(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, error) of ids to remove: `not-found` for those that no record has."""
    there = records.select("id").distinct().withColumn("_there", F.lit(True))
    return ids.select("id").distinct().join(there, "id", "left").select("id", F.when(F.col("_there").isNull(), "not-found").alias("error"))


def clear(states: DataFrame) -> DataFrame:
    """States without any record; whether history is kept stays as it is, and an error of loading is gone."""
    none = F.array().cast(f"array<{RECORD}>")
    return states.withColumns({"records": none, "error": F.lit(None).cast("string"), "keep_history": F.coalesce("keep_history", F.lit(True))})


def set_keep(states: DataFrame, on: Column) -> DataFrame:
    """States that keep history or not; the records stay. Anything but true is off."""
    return states.withColumn("keep_history", F.coalesce(on, F.lit(False)))


def state_text(states: DataFrame) -> Column:
    """The text that `parse_state` reads, of its columns keep_history and records."""
    return F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), F.col("keep_history").alias("keepHistory"), F.coalesce("records", F.array().cast(f"array<{RECORD}>")).alias("records")))


def search(records: DataFrame, query: str | None) -> DataFrame:
    return records.where(name_matches(F.col("name"), F.lit(query or "")))


def parse_state(states: DataFrame, text: str = "state") -> DataFrame:
    """The states with `error` (corrupt, schema or null), keep_history and records; all records must be valid and their ids differ."""
    parsed = F.from_json(text, f"schemaVersion double, keepHistory boolean, records array<{RECORD}>", {"mode": "PERMISSIVE"})
    shape = F.try_parse_json(F.col(text))
    rows = states.withColumns({"_s": parsed, "_v": shape})
    r = F.col("_s.records")
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    one = lambda x: (filled(x["id"]) & filled(x["name"]) & filled(x["uri"]) & F.coalesce(x["kind"].isin(*KINDS), F.lit(False))
                     & F.coalesce(x["bytes"] >= 0, F.lit(False)) & F.coalesce(x["createdAt"] >= 0, F.lit(False)))
    bad = F.col("_s.keepHistory").isNull() | r.isNull() | ~F.coalesce(F.forall(r, one), F.lit(False)) | (
        F.size(F.array_distinct(F.transform(r, lambda x: x.id))) != F.size(r))
    is_object = F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False))
    error = F.when(~is_object, "corrupt").when(F.coalesce(F.col("_s.schemaVersion") != VERSION, F.lit(True)), "schema").when(bad, "corrupt")
    return rows.withColumns({"error": error, "keep_history": F.when(error.isNull(), F.col("_s.keepHistory")),
                             "records": F.when(error.isNull(), r)}).drop("_s", "_v")


def check_uris(records: DataFrame, files: DataFrame | None) -> DataFrame:
    """The records with `state`: exists or missing by a listing (path), unknown without one."""
    if files is None:
        return records.withColumn("state", F.lit("unknown"))
    there = files.select(F.col("path").alias("uri")).distinct().withColumn("_there", F.lit(True))
    return records.join(there, "uri", "left").withColumn("state", F.when(F.col("_there"), "exists").otherwise("missing")).drop("_there")


def latest_wins(events: DataFrame, keys: list[str], seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """Events that are not older than any that came before; those without a number always count."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(seq).over(before)
    return events.withColumn("_top", top).where(F.col(seq).isNull() | F.col("_top").isNull() | (F.col(seq) >= F.col("_top"))).drop("_top")
