"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_written: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and runs in one process (tests), a local one is made."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{master}: spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="kontaktor-")
    return _own_folder


def written(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and lost executors cost no recomputation.
    by: a column of few values, each of which gets a part of its own that can be discarded alone.

    Its shuffle files go as soon as it is written: nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kontaktor-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(hadoop).delete(path, True)


def discard(*tables: DataFrame, part: str | None = None) -> None:
    """Delete tables that written() made and that no plan will read again, or one part of them, as in part="kind=2"."""
    for t in tables:
        if part:
            _delete(t.sparkSession, f"{t.written_at}/{part}")
            continue
        _written.remove(t.written_at)
        _delete(t.sparkSession, t.written_at)


def release(spark: SparkSession) -> None:
    """Delete all tables that written() made; call it once the results that rest on them are stored."""
    while _written:
        _delete(spark, _written.pop())
