"""Reading the tables, and cutting lineage with tables in the folder the cluster shares."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from tableview.storage import delete, new_path


#: Spark's setting that lets the shuffle files of a query go when it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def written(frame: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder, read again: lost executors repeat no more
    than what was running. Nothing reads the shuffle files of the writing job after it."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        frame.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete such tables, once all that reads them has been written in turn."""
    for frame in frames:
        for folder in {path.rsplit("/", 1)[0] for path in frame.inputFiles()}:
            delete(frame.sparkSession, folder)


def sent(spark: SparkSession, value):
    """Something of bounded size for all tasks; `received` brings it back there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast):
    return cloudpickle.loads(broadcast.value)
