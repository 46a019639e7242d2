"""Drum hits: peak picking, grouping, spacing, refractory, annotation and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .islands import chain_groups

CLASSES = ("kick", "snare_or_clap", "hat", "cymbal", "tom_or_perc", "unknown")


def score(onset: Column, confidence: Column, attack: Column, dominance: Column) -> Column:
    """P20."""
    return 0.52 * onset + 0.26 * confidence + 0.10 * attack + 0.12 * dominance


def peaks(env: DataFrame, by: list[str], order: str, value: str, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float, minimum: float | Column) -> DataFrame:
    """W25 without its wait rule: values that are the largest of their frame, at least delta over its mean and at least minimum."""
    w = Window.partitionBy(*by).orderBy(order)
    top, mean = F.max(value).over(w.rowsBetween(-pre_max, post_max)), F.avg(value).over(w.rowsBetween(-pre_avg, post_avg))
    p = env.withColumns({"__t": top, "__m": mean}).where((F.col(value) >= minimum) & (F.col(value) >= F.col("__t")) & (F.col(value) >= F.col("__m") + delta))
    return p.drop("__t", "__m")


def keep_spaced(hits: DataFrame, by: list[str], at: str, strength: str, gap: Column, order: str) -> DataFrame:
    """W25's wait rule, W30, W31: hits in time order; one nearer than gap to the last kept hit replaces it if it is stronger, else goes.

    A hit that is its own gap or more behind the hit before it is that far behind every kept one, so it begins a new
    run; only the hits of a run are folded together. What stays are whole rows of hits, as they were.
    """
    w = Window.partitionBy(*by).orderBy(at, order, strength)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= F.col("__gap")), F.lit(True)).cast("int")
    row = F.struct(F.col(at).alias("__at"), F.col(order).alias("__o"), F.col(strength).alias("__v"), F.col("__gap"), F.struct(*hits.columns).alias("__row"))
    cut = hits.withColumn("__gap", gap.cast("double")).withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = cut.groupBy(*by, "__run").agg(F.array_sort(F.collect_list(row)).alias("__all"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        near = x["__at"] - last["__at"] < x["__gap"]
        head = F.slice(kept, F.lit(1), F.size(kept) - 1)
        return F.when(~near, F.concat(kept, F.array(x))).when(x["__v"] > last["__v"], F.concat(head, F.array(x))).otherwise(kept)

    first = F.slice("__all", 1, 1)
    kept = F.aggregate(F.expr("slice(__all, 2, greatest(size(__all) - 1, 0))"), first, step)
    return g.select(F.explode(kept).alias("__k")).select("__k.__row.*")


def transient_groups(hits: DataFrame, by: list[str], window: float) -> DataFrame:
    """W28."""
    return chain_groups(hits, by, "onset_sec", window, ["hit_id"], "transient")


def group_winners(hits: DataFrame, by: list[str], window: float) -> DataFrame:
    """Suppressed is false for the best hit of each group, by score, then time."""
    g = transient_groups(hits, by, window)
    rank = F.row_number().over(Window.partitionBy(*by, "transient").orderBy(F.col("score").desc(), "onset_sec", "hit_id"))
    return g.withColumn("suppressed", rank > 1)


def velocities(hits: DataFrame, by: list[str]) -> DataFrame:
    """P22."""
    s = hits.withColumn("__s", F.col("onset_score") * (0.70 + 0.20 * F.col("confidence")))
    q = s.groupBy(*by).agg(F.percentile("__s", 0.1).alias("__lo"), F.percentile("__s", 0.9).alias("__hi"))
    norm = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("__s") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9))))
    v = F.rint(20 + 88 * norm + 12 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))).cast("int")
    return s.join(q, by).withColumn("velocity", F.greatest(F.lit(1), F.least(F.lit(127), v))).drop("__s", "__lo", "__hi")


def bpm(intervals: Column) -> Column:
    """60 over a median interval, doubled or halved into 70..190."""
    b = 60 / intervals
    low = F.when(b < 70, b * F.pow(F.lit(2.0), F.ceil(F.log2(70 / b)))).otherwise(b)
    return F.when(low > 190, low / F.pow(F.lit(2.0), F.ceil(F.log2(low / 190)))).otherwise(low)
