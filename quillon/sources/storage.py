"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, deleted by clear_stored(). Only a local master may leave the setting out: on a cluster
    no other machine would see a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quillon-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows written as Parquet to shared storage and read back: lineage ends here, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def clear_stored() -> None:
    """Deletes what this process wrote below shared paths; runs at exit and may be called once no result is read any more."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return
