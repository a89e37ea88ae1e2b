"""The folder that driver and executors share, where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine, which only a local session may use."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "/tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, kind: str = "") -> str:
    """A new path in the shared folder, which ``release`` will delete."""
    path = f"{shared_dir(spark)}/ferrule-{kind}{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """A result that is read several times, written to the shared folder; outlives any executor."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core of the session.
TASKS = 4


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by ``by``, before work that is dear for each row: a file of millions of short rows is one split, thus one task."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *by)


def release(spark: SparkSession) -> int:
    """Deletes what the library has written to the shared folder so far, and says how many paths that were.

    To be called when results have been written elsewhere: until then these tables are the lineage of what was returned.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths, _written[:] = _written[:], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
