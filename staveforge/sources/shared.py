"""Tables staged in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """One machine and one process: `local` or `local[...]`, not `local-cluster[...]`."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of its own only in local mode, where all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "/tmp/staveforge").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is then left to the cluster's own retention
        pass


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """df with the rows of a key of by in one of as many partitions as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@contextmanager
def copartitioned(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join tables that lie by some of the join's keys as they lie; Spark else exchanges both sides by all keys.

    Nor are such tables broadcast: Spark judges them by their compressed files, and takes rows that an explode makes for as
    many as before, so the driver would hold many times what the threshold allows.
    """
    least = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in least}
    for name, value in least.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def staged_by(df: DataFrame, by: list[str]) -> DataFrame:
    """df staged as staged() does, in buckets by the columns by, one for each shuffle partition.

    Aggregates and windows whose keys contain by read such tables without another exchange, and so do joins that a further
    staged_by() writes; a key of by is one task there.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(spark)}/{name}"
    with copartitioned(spark):
        dealt(df, by).write.format("parquet").bucketBy(parts, *by).option("path", path).saveAsTable(name)
    atexit.register(_remove, spark, path)
    return spark.table(name)


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, so that its lineage ends there.

    A lost executor costs nothing that was written, and later reads prune columns. The table goes at the end of the process.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
