"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows of an Arrow batch while a table is written.
BATCH_ROWS = 200

_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str, steps: list[str] | None = None) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it again: plans stay small and survive lost executors.

    steps: gets the table's path, for discard().  Only where that setting is missing in a local session a temporary folder is used; a cluster must name one.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = told.get() if told.isDefined() else None
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidegate-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    if steps is not None:
        steps.append(path)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_to = spark.conf.get(batch)
    spark.conf.set(batch, str(min(int(set_to), BATCH_ROWS) if int(set_to) > 0 else BATCH_ROWS))  # rows are whole texts, and a task has a worker for each function
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(batch, set_to)
    return spark.read.schema(df.schema).parquet(path)


def discard(steps: list[str]) -> None:
    """Delete the tables of these paths; what read them must have been written."""
    for spark, path in [x for x in _written if x[1] in steps]:
        _written.remove((spark, path))
        _delete(spark, path)
    steps.clear()


def release() -> None:
    """Delete every table that cut() wrote, also at exit; what still reads them must be consumed first."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass
