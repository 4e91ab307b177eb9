"""Incremental ingest of units: first occurrences of a content hash, and counts per hash, kept up over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import collapse, content_hash


def first_seen(stream: DataFrame, time: str, late: str = "1 day", text: str = "text") -> DataFrame:
    """A stream's rows with new content: repeats within the watermark are dropped."""
    rows = stream.filter(collapse(F.col(text)) != "").withColumn("id", content_hash(F.col(text)))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


def merge_units(stream: DataFrame, path: str, checkpoint: str, text: str = "text", source: str = "source") -> StreamingQuery:
    """Writes each batch's units (id, text, n, sources) below path; units() folds the batches into totals."""

    def batch(rows: DataFrame, number: int) -> None:
        units = rows.filter(collapse(F.col(text)) != "").groupBy(content_hash(F.col(text)).alias("id")).agg(F.min(text).alias("text"), F.count(F.lit(1)).alias("n"), F.collect_set(source).alias("sources"))
        units.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def units(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.sum("n").alias("n_occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
