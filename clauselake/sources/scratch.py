"""Folders for files that a query writes and reads again, where driver and executors see them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or below the warehouse where that is unset; removed when the program ends."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended; its owner removes the folder
            return
