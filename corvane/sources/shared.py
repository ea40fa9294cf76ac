"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.errors import CorvaneError

_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session that names none, as in tests, gets one under /tmp; elsewhere that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise CorvaneError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"/tmp/corvane-checkpoints-{sc.applicationId}"
        sc.setCheckpointDir(base)
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many scratch tables there are; a starting point for purge."""
    return len(_PATHS)


def purge(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch tables made since, but `keep`. Only for callers that have written what they read from them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in _PATHS[since:] if p not in keep]
    _PATHS[since:] = [p for p in _PATHS[since:] if p in keep]
    for path in gone:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)
