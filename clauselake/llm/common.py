"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts state it: \x20 and \x09-\x0D, which is what bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"
_staged: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, or a temporary one if
    driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or _own_dir(spark))
        found = sc.getCheckpointDir()
    return found


def _own_dir(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a reliable checkpoint, so a lost executor costs no earlier step."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    sweep(df.sparkSession)
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a compressed Parquet table in the shared folder and read again (for wide rows of which later steps read few columns, and
    for what is removed by release() once it has been used)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    forget_later(spark, path)
    sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df staged as a table in buckets of `key`, one for each shuffle partition: of a join by that key only the other side moves, however
    often it is joined. Spark does not split a bucket, so keys of the other side must not be frequent."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(name)
    forget_later(spark, path)
    sweep(spark)
    out = spark.table(name)
    out.staged_path, out.staged_table = path, name
    return out


def release(*tables: DataFrame) -> None:
    """Removes staged tables of which nothing is read any more."""
    for df in tables:
        spark, path = df.sparkSession, df.staged_path
        if hasattr(df, "staged_table"):
            spark.sql(f"DROP TABLE {df.staged_table}")
        _removed(spark, path)
        _staged.remove((spark, path))


_swept = 0.0


def sweep(spark: SparkSession, seconds: float = 3.0) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to: it does so when the driver's heap is collected, which in a
    long job of many small steps may be long after they fill the disks."""
    global _swept
    if time.monotonic() - _swept > seconds:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()


def forget_later(spark: SparkSession, path: str) -> None:
    """Removes a folder when the program ends."""
    if not _staged:
        atexit.register(_remove_staged)
    _staged.append((spark, path))


def _removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_staged() -> None:
    for spark, path in _staged:
        try:
            _removed(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; its owner removes the folder
            return


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch holds: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a gapless number from 0 in the given order, without a task that sees all rows.

    Range-sorted once and frozen; only one count per partition comes to the driver.
    """
    spark = df.sparkSession
    base = cut(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id()))
    at = F.col("__mono")
    counts = base.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        starts[r["p"]], total = total, total + r["n"]
    offsets = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else None
    start = F.element_at(offsets, F.shiftright(at, 33)) if starts else F.lit(0)
    return base.withColumn(name, (start + at.bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__mono")


def running_sum(xs: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in blocks, so that long arrays cost n * sqrt(n) at most."""
    n = F.size(xs)
    block = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def sums(x: Column, start: Column) -> Column:
        return F.aggregate(
            x,
            F.struct(start.alias("s"), empty.alias("a")),
            lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a")),
            lambda acc: acc["a"],
        )

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda b: F.slice(xs, b * block + 1, block))
    totals = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda s, v: s + v))
    starts = F.concat(F.array(zero), sums(totals, zero))
    return F.when(n <= 0, empty).otherwise(F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), sums)))


def groups(batches, keys: list[str]):
    """Data frames of equal keys, from batches sorted by them; a group may span batches."""
    import pandas as pd

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = [0, *((k[1:] != k[:-1]).any(axis=1).nonzero()[0] + 1), len(b)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = b.iloc[x:y]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)
