"""Shared plumbing: table reading, shared-folder scratch tables and a size-checked broadcast."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of its own only in local mode, where all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is then left to the cluster's own retention
        pass


class Scratch:
    """Parquet tables in the shared folder.

    They cut lineage the way checkpoint() does (a lost executor costs nothing that was written), but stay
    columnar, so that later reads prune columns. A table goes with drop(), the rest at the end of the process.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                _remove(self.spark, path)


#: Longs that may be broadcast (16 MB); a table of more rows than this over its columns is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def id_join(big: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """big joined with ids, a table of longs, on key. ids is counted first: broadcast below 16 MB, else a shuffled join."""
    most = BROADCAST_ROWS // len(ids.columns)
    return big.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids.hint("shuffle_hash"), key, how)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free(df: DataFrame, name: str) -> str:
    """name, with underscores appended while df has a column of that name (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
