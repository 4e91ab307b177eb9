"""An index of units that is kept up over a stream: exact counts and first occurrences per content hash and source, in keyed state.

Rows of a micro-batch are combined where they are read, so a text that a third of all rows repeat reaches its key as one row per task. The state of a
key (hash, source) is a count and its first row, kept by Spark's own aggregation over streams, without Python for each key; what changed is written as files sorted by hash, in folders by batch and by the hash's first two
digits. A batch that runs again replaces its folder. Readers take the newest row of a key; `compact` folds batches into one. A table of
texts is looked up in the folders that its hashes fall into and no others.

Blank and null texts are no units; a null source is one source; order is a long that grows with the rows, and the least one is first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import collapse, content_hash

SCHEMA = "id string, source string, n long, first long, text string"
PREFIX = 2
_KEY = ["id", "source"]


def updates(stream: DataFrame, order: str, text: str = "text", source: str = "source") -> DataFrame:
    """A stream of SCHEMA: the new state of each key that a micro-batch touches."""
    rows = stream.filter(collapse(F.coalesce(F.col(text), F.lit(""))) != "")
    rows = rows.select(content_hash(F.col(text)).alias("id"), F.col(source).cast("string").alias("source"), F.lit(1).cast("long").alias("n"), F.col(order).cast("long").alias("first"), F.col(text).alias("text"))
    kept = rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min(F.struct("first", "text")).alias("x"))
    return kept.select(*_KEY, "n", "x.first", "x.text")


def _bucketed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("bucket", F.substring("id", 1, PREFIX))
    return rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "id")


def keep(stream: DataFrame, path: str, checkpoint: str, order: str, text: str = "text", source: str = "source") -> StreamingQuery:
    """Runs over what is there and keeps the index at path up with it."""

    def batch(rows: DataFrame, number: int) -> None:
        _bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return updates(stream, order, text, source).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, id, source, n, first, text): the newest row of each key. Filters on bucket reach the folders."""
    rows = spark.read.schema(f"{SCHEMA}, batch long, bucket string").parquet(path)
    newest = F.max_by(F.struct("n", "first", "text"), F.col("batch")).alias("x")
    return rows.groupBy("bucket", *_KEY).agg(newest).select("bucket", *_KEY, "x.n", "x.first", "x.text")


def units(found: DataFrame) -> DataFrame:
    """(id, text, n_occurrences, sources) of entries: sources in the order of their first rows."""
    seen = F.array_sort(F.collect_list(F.struct("first", "source")))
    return found.groupBy("id").agg(F.min_by("text", "first").alias("text"), F.sum("n").alias("n_occurrences"), F.transform(seen, lambda x: x["source"]).alias("sources"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The newest rows as one batch of a new index, numbered so that later batches of the stream stay newer."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    _bucketed(entries(spark, path).drop("bucket")).write.partitionBy("bucket").parquet(f"{to}/batch={last}")


def lookup(spark: SparkSession, path: str, texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of texts with n_occurrences and sources of the unit that equals them up to white space; others are left out. Only folders of the
    texts' hash prefixes (256 at most) are read."""
    asked = texts.withColumn("__id", content_hash(F.col(text)))
    hit = [r[0] for r in asked.select(F.substring("__id", 1, PREFIX).alias("b")).filter("b is not null").distinct().collect()]
    found = units(entries(spark, path).filter(F.col("bucket").isin(hit))).select(F.col("id").alias("__unit"), "n_occurrences", "sources")
    return asked.join(found, F.col("__id") == F.col("__unit")).drop("__id", "__unit")
