"""Tables in the folder that all executors share: they cut lineage and survive a lost executor."""

from __future__ import annotations

import gc
import uuid
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one below the warehouse where that is unset (tests, local runs)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back; deleted when the application ends."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    at, system = _path(df.sparkSession, path)
    system.deleteOnExit(at)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Gives a function like table() whose tables are deleted when the block ends."""
    made: list[str] = []

    def make(df: DataFrame, name: str) -> DataFrame:
        made.append(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield make
    finally:
        for path in made:
            at, system = _path(spark, path)
            system.delete(at, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of queries that are no longer held go now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing_rounds(spark: SparkSession):
    """Gives a function that opens a round: it returns a maker of tables, which are deleted when the round after the next opens, as are the shuffle
    files of what isn't held any more."""
    stacks: list[ExitStack] = []

    def open_():
        stacks.append(ExitStack())
        if len(stacks) > 2:
            stacks.pop(0).close()
            release(spark)
        return stacks[-1].enter_context(passing(spark))

    try:
        yield open_
    finally:
        for s in stacks:
            s.close()


@contextmanager
def bucketed(df: DataFrame, buckets: int, key: str):
    """df as a table in buckets by key, so that grouping by key doesn't shuffle it; dropped when the block ends."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    try:
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at, system = _path(spark, path)
        system.delete(at, True)
