"""From raw documents to training shards: filter, deduplicate, decontaminate, mix, shard.

Every stage reads the whole of what its predecessor kept and returns the columns of documents, but for the last,
which adds size, shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staveforge.llm.common import Scratch, table
from staveforge.llm.decontaminate import decontaminate
from staveforge.llm.minhash import drop_near_duplicates
from staveforge.llm.mixing import mix
from staveforge.llm.sharding import shard
from staveforge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7; trained on all labels (a bounded sample of them)."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of ten words of a benchmark item; documents that are mostly such runs go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks (0 to 3 rows); copies are equal rows."""
    names = docs.columns
    own = "_mix"
    while any(c.lower().startswith(own) for c in names):
        own += "_"
    mixed = mix(docs, weights=(5.0, 2.0, 1.0), cap=3, prefix=own)
    return mixed.withColumn(f"{own}n", F.explode(F.array_repeat(F.lit(1), F.col(f"{own}copies")))).select(*[F.col(f"`{c}`") for c in names])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, with a gapless slot in each."""
    return shard(docs, parts=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The learned stage has no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
