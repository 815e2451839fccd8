"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's; where neither is set, a folder of this application's own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = kept.get() if kept.isDefined() else tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While a table is written: shuffle files go when the execution that made them ends, and rows go to Python in small batches.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

_written: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _written:
            _delete(spark, path)
    except Exception:  # the JVM may be gone by now; the folder then stays
        pass


atexit.register(_sweep)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: no lineage, survives lost executors, and its size is known to the planner.

    Shuffle files that made it are removed then, not when the driver happens to collect its garbage. The table's files stay until
    the application ends, as the plans that read them are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from cut() that nothing will read any more."""
    for df in tables:
        path = df.__dict__.pop("_cut_path", None)
        if path in _written:
            _written.discard(path)
            _delete(df.sparkSession, path)
