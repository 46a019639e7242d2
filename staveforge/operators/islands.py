"""Gaps and islands: chained sessions, interval unions, hysteresis regions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def chain_groups(df: DataFrame, by: list[str], at: str, gap: float, order: list[str], out: str = "group_no") -> DataFrame:
    """Number (from 0) of the group of each row; a row joins the group before it if it is at most gap after the row before."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    start = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__s", start).withColumn(out, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__s")


def merge_spans(df: DataFrame, by: list[str], gap: float = 0.0, aggs: list[Column] | None = None) -> DataFrame:
    """(by, start_sec, end_sec, members, ...): spans joined where one starts at most gap after the furthest end so far."""
    w = Window.partitionBy(*by).orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = df.withColumn("__s", F.coalesce((F.col("start_sec") > reach + gap).cast("int"), F.lit(0)))
    s = s.withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*by, "__g").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("members"), *(aggs or [])).drop("__g")


def hysteresis_regions(frames: DataFrame, by: list[str], hold: float, min_region: float, merge_gap: float, ratio: float = 0.18, hint: str | None = None) -> DataFrame:
    """Regions of activity (by, start_sec, end_sec, peak_energy, mean_energy, onset_count, confidence).

    frames: by, frame_index, start_sec, end_sec, energy, onset. A frame is active at energy >= max(1e-6, ratio * peak, 0.6 * mean),
    or by hint. A silence shorter than hold belongs to the region around it; a longer one ends the region at the last
    frame for which the silence was still shorter. Regions shorter than min_region without an onset go; regions at most
    merge_gap apart join, with means weighed by duration.
    """
    every = Window.partitionBy(*by)
    w = every.orderBy("frame_index")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    threshold = F.greatest(F.lit(1e-6), F.max("energy").over(every) * ratio, F.avg("energy").over(every) * 0.6)
    frames = frames.withColumn("__th", threshold)
    active = F.col("energy") >= F.col("__th")
    if hint:
        active = active | F.col(hint)
    f = frames.withColumn("__a", active)
    # The silent run that a frame belongs to is counted by the active frames before it.
    f = f.withColumn("__run", F.sum(F.col("__a").cast("int")).over(upto))
    run = Window.partitionBy(*by, "__run").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("__from", F.min(F.when(~F.col("__a"), F.col("start_sec"))).over(run))
    f = f.withColumn("__break", (~F.col("__a")) & (F.col("end_sec") - F.col("__from") >= hold))
    f = f.withColumn("__island", F.sum(F.col("__break").cast("int")).over(upto)).where(~F.col("__break"))
    isl = Window.partitionBy(*by, "__island").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("__seen", F.max(F.col("__a").cast("int")).over(isl)).where("__seen = 1")
    r = f.groupBy(*by, "__island").agg(F.min("start_sec").alias("start_sec"), F.max_by("end_sec", "frame_index").alias("end_sec"), F.max("energy").alias("peak_energy"), F.avg("energy").alias("mean_energy"), F.sum((F.col("onset") > 0).cast("int")).alias("onset_count"), F.first("__th").alias("__th")).drop("__island")
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean_energy") / F.col("__th") * 0.6 + 0.1 * F.col("onset_count")))
    r = r.withColumn("confidence", sure).drop("__th")
    r = r.where((F.col("end_sec") - F.col("start_sec") >= min_region) | (F.col("onset_count") > 0))
    length = F.col("end_sec") - F.col("start_sec")
    order = Window.partitionBy(*by).orderBy("start_sec")
    new = F.coalesce((F.greatest(F.lit(0.0), F.col("start_sec") - F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))) > merge_gap).cast("int"), F.lit(0))
    r = r.withColumn("__n", new).withColumn("__g", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = r.groupBy(*by, "__g").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("peak_energy").alias("peak_energy"),
        F.sum("onset_count").alias("onset_count"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "mean_energy"))).alias("__parts"),
    )

    def join(a: Column, x: Column) -> Column:  # the span so far, gaps included, weighs against the next region
        da, dx = a["end_sec"] - a["start_sec"], x["end_sec"] - x["start_sec"]
        mean = (a["mean_energy"] * da + x["mean_energy"] * dx) / F.greatest(F.lit(1e-6), da + dx)
        return F.struct(a["start_sec"].alias("start_sec"), F.greatest(a["end_sec"], x["end_sec"]).alias("end_sec"), mean.alias("mean_energy"))

    mean = F.aggregate(F.expr("slice(__parts, 2, greatest(size(__parts) - 1, 0))"), F.col("__parts")[0], join, lambda a: a["mean_energy"])
    return g.select(*by, "start_sec", "end_sec", "peak_energy", mean.alias("mean_energy"), "onset_count", "confidence")
