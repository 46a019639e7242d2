"""Packing under budgets: which rows of a recording a request keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .timejoin import interval_join, nearest_join

REC = ["recording_id"]

# How much a note is worth at an end of the recording, in a strong region, where the pitch changes, and for even cover.
ENDS, KEEP = 1000, 24
REGION_EDGE, REGION_MIDDLE, REGION_NEAR, REGION_BESIDE = 900, 920, 880, 820
CHANGE_NEAR, CHANGE_BESIDE = 860, 810
EVEN = 600


def indexed(rows: DataFrame, order: list[str], bucket: float = 60.0) -> DataFrame:
    """rows with index, their place in the recording from 0, and count, the recording's rows; order begins with start_sec.

    Places inside a time bucket plus the sizes of the buckets before, so that no recording is ordered in one task.
    """
    r = rows.withColumn("__t", F.floor(F.col("start_sec") / bucket))
    sizes = r.groupBy(*REC, "__t").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*REC)
    before = F.coalesce(F.sum("__c").over(w.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*REC, "__t", before.alias("__b"), F.sum("__c").over(w).alias("count"))
    place = F.row_number().over(Window.partitionBy(*REC, "__t").orderBy(*order)) - 1
    return r.join(sizes, [*REC, "__t"]).withColumn("index", F.col("__b") + place).drop("__t", "__b")


def even(rows: DataFrame, limit: int) -> DataFrame:
    """Limit rows of each recording, evenly spread over index, with the first and the last; all if there are no more."""
    most = max(1, limit)
    if most == 1:
        return rows.where("index = 0")
    # The k-th place is index rint(k / (most - 1) * (count - 1)); a row asks whether its nearest k leads to it.
    k = F.rint(F.col("index") * (most - 1) / (F.col("count") - 1))
    hit = F.rint(k / F.lit(float(most - 1)) * (F.col("count") - 1)) == F.col("index")
    return rows.where((F.col("count") <= most) | F.coalesce(hit, F.lit(False)))


def select_notes(notes: DataFrame, regions: DataFrame, changes: DataFrame, limit: int = 180, width: float = 4.0) -> DataFrame:
    """The limit most telling notes of each recording, all of them if there are no more; in time order by index.

    notes: start_sec, end_sec, note_id. regions: start_sec, end_sec, rms_peak, onset_count. changes: start_sec, where the
    pitch changes. A note counts by the best of its reasons: one of the first or last KEEP; first, middle or last of a
    strong region, or nearest to the middle of one that holds none, or beside that; nearest to a change, or beside
    that; or needed for even cover. Of equal notes the earlier stays. Reasons are rows, and only the best limit of them stay.
    """
    most = max(1, limit)
    n = indexed(notes, ["start_sec", "end_sec", "note_id"])
    many = n.where(F.col("count") > most)
    counts = many.select(*REC, "count").distinct()
    place = F.row_number().over(Window.partitionBy(*REC).orderBy(F.col("rms_peak").desc(), F.col("onset_count").desc(), "start_sec"))
    total = F.count(F.lit(1)).over(Window.partitionBy(*REC))
    top = regions.join(counts.select(*REC), REC).select("*", place.alias("__k"), total.alias("__n"))
    top = top.where(F.col("__k") <= F.greatest(F.lit(6), F.least(F.col("__n"), F.lit(max(1, limit // 6))))).select(*REC, F.col("__k").alias("region"), "start_sec", "end_sec")
    inside = interval_join(top, many.select(*REC, "start_sec", "end_sec", "index"), REC, width).select(*REC, "region", F.col("r_index").alias("index"))
    w = Window.partitionBy(*REC, "region")
    j = F.row_number().over(w.orderBy("index")) - 1
    c = F.count(F.lit(1)).over(w)
    inside = inside.select(*REC, "region", "index", j.alias("j"), c.alias("c"))
    middle = F.col("j") == F.floor(F.col("c") / 2)
    marks = [
        many.where((F.col("index") < KEEP) | (F.col("index") >= F.col("count") - KEEP)).select(*REC, "index", F.lit(ENDS).alias("worth")),
        inside.where(middle | (F.col("j") == 0) | (F.col("j") == F.col("c") - 1)).select(*REC, "index", F.when(middle, REGION_MIDDLE).otherwise(REGION_EDGE).alias("worth")),
        even(many, most).select(*REC, "index", F.lit(EVEN).alias("worth")),
    ]
    at = many.groupBy(*REC, F.col("start_sec").alias("at")).agg(F.min("index").alias("index"))
    bare = top.join(inside.select(*REC, "region").distinct(), [*REC, "region"], "left_anti")
    for targets, near, beside in ((bare.select(*REC, ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at")), REGION_NEAR, REGION_BESIDE), (changes.join(counts.select(*REC), REC).select(*REC, F.col("start_sec").alias("at")), CHANGE_NEAR, CHANGE_BESIDE)):
        hit = nearest_join(targets, at, REC, "at", ["index"])
        three = F.array(*[F.struct((F.col("index") + d).alias("index"), F.lit(near if d == 0 else beside).alias("worth")) for d in (-1, 0, 1)])
        marks.append(hit.where("index is not null").select(*REC, F.inline(three)))
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    best = every.groupBy(*REC, "index").agg(F.max("worth").alias("worth")).join(counts, REC).where((F.col("index") >= 0) & (F.col("index") < F.col("count")))
    rank = F.row_number().over(Window.partitionBy(*REC).orderBy(F.col("worth").desc(), "index"))
    chosen = best.withColumn("__r", rank).where(F.col("__r") <= most).select(*REC, "index", "worth")
    return n.join(chosen, [*REC, "index"], "left").where((F.col("count") <= most) | F.col("worth").isNotNull()).drop("count")
