"""Bars of a fixed length and their families (A22, A23, A38, W34, W35, F19, U7, U8); completion.py has bars by tempo and meter and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E

REC = ["recording_id"]


def monophonic(notes: DataFrame) -> DataFrame:
    """One note for each (bar, slot): the lowest pitch, then the longest, then the loudest."""
    rank = F.row_number().over(Window.partitionBy(*REC, "bar", "slot").orderBy("pitch_midi", F.col("slots").desc(), F.col("velocity").desc(), "note_id"))
    return notes.withColumn("__r", rank).where("__r = 1").drop("__r")


def on_grid(notes: DataFrame, bar_sec: float, slots_per_bar: int) -> DataFrame:
    """Bar, slot and length in slots (at least 1) of each note; slots are half to even and stay inside the bar."""
    bar = F.floor(F.col("start_sec") / bar_sec)
    slot = F.rint((F.col("start_sec") - bar * bar_sec) * (slots_per_bar / bar_sec)).cast("int")
    return notes.withColumns({"bar": bar.cast("int"), "slot": F.least(F.lit(slots_per_bar - 1), slot), "slots": F.greatest(F.lit(1), F.rint((F.col("end_sec") - F.col("start_sec")) * (slots_per_bar / bar_sec)).cast("int"))})


def bars(grid: DataFrame, slots_per_bar: int) -> DataFrame:
    """(recording_id, bar, n, slots_at, pitches, lengths, intervals, empty_slots) of every bar up to the last; bars without notes have empty arrays."""
    got = grid.groupBy(*REC, "bar").agg(F.array_sort(F.collect_list(F.struct("slot", "pitch_midi", F.col("slots").alias("len"), "note_id"))).alias("x"))
    last = grid.groupBy(*REC).agg(F.max("bar").alias("last"))
    every = last.select(*REC, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bar"))
    b = every.join(got, [*REC, "bar"], "left").withColumn("x", F.coalesce("x", F.expr("cast(array() as array<struct<slot:int,pitch_midi:int,len:int,note_id:string>>)")))
    p = F.transform("x", lambda v: v["pitch_midi"])
    step = F.zip_with(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, c: a - c)
    at = F.transform("x", lambda v: v["slot"])
    return b.select(*REC, "bar", F.size("x").alias("n"), at.alias("slots_at"), p.alias("pitches"), F.transform("x", lambda v: v["len"]).alias("lengths"), step.alias("intervals"), F.array_except(F.sequence(F.lit(0), F.lit(slots_per_bar - 1)), at).alias("empty_slots"))


def families(b: DataFrame) -> DataFrame:
    """Bars with equal slots, pitches and lengths, two or more; numbered from 1 by size, then first bar."""
    f = b.where("n > 0").groupBy(*REC, "slots_at", "pitches", "lengths").agg(F.count(F.lit(1)).alias("size"), F.min("bar").alias("first_bar"), F.array_sort(F.collect_list("bar")).alias("occurrences")).where("size > 1")
    no = F.row_number().over(Window.partitionBy(*REC).orderBy(F.col("size").desc(), "first_bar"))
    return f.withColumn("family_no", no)


def family_id(no: Column) -> Column:
    """pattern_A to pattern_Z, then pattern_027."""
    return F.when(no <= 26, F.concat(F.lit("pattern_"), F.char(no + 64))).otherwise(F.format_string("pattern_%03d", no))


def reference_count(b: DataFrame) -> DataFrame:
    """The commonest count of notes in a bar; of equally common ones the larger."""
    c = b.where("n > 0").groupBy(*REC, "n").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*REC).agg(F.max(F.struct("c", "n")).alias("b")).select(*REC, F.col("b.n").alias("notes_per_bar"))


def sparse_runs(b: DataFrame) -> DataFrame:
    """Runs of consecutive bars with at most max(1, ceil(0.35 * median)) notes: (recording_id, first_bar, last_bar)."""
    m = b.where("n > 0").groupBy(*REC).agg(F.greatest(F.lit(1), F.ceil(0.35 * F.median("n"))).alias("limit"))
    s = b.join(m, REC).where("n <= limit")
    run = F.col("bar") - F.row_number().over(Window.partitionBy(*REC).orderBy("bar"))
    return s.withColumn("run", run).groupBy(*REC, "run").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar")).drop("run")


def match_families(b: DataFrame, f: DataFrame) -> DataFrame:
    """(recording_id, bar, family_no, score): the best family with more notes than the bar, from .52 on.

    .45 pitch + .30 slot + .15 interval + .10 length, each the best of prefix, suffix and inner fragment over the bar's
    count; the pitches must match in all but one place.
    """
    fam = f.select(*REC, "family_no", F.col("slots_at").alias("fs"), F.col("pitches").alias("fp"), F.col("lengths").alias("fl"), F.size("pitches").alias("fn"))
    step = lambda p: F.zip_with(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: x - y)
    j = b.where("n > 0").join(fam, REC).where("n < fn")

    def best(x: Column, y: Column, tolerance: float = 0.0) -> Column:
        return F.greatest(E.prefix_length(x, y, tolerance), E.suffix_length(x, y, tolerance), E.fragment_length(x, y))

    n = F.col("n")
    pitch = best(F.col("pitches"), F.col("fp"))
    slot = best(F.col("slots_at"), F.col("fs"), 1.0)
    iv = F.when(n > 1, best(F.col("intervals"), step(F.col("fp"))) / (n - 1)).otherwise(0.0)
    total = 0.45 * pitch / n + 0.30 * slot / n + 0.15 * iv + 0.10 * best(F.col("lengths"), F.col("fl"), 1.0) / n
    s = j.withColumns({"pitch_match": pitch, "score": F.round(total, 9)}).where((F.col("pitch_match") >= n - 1) & (F.col("score") >= 0.52))
    return s.groupBy(*REC, "bar").agg(F.min(F.struct((-F.col("score")).alias("s"), "family_no")).alias("b")).select(*REC, "bar", "b.family_no", (-F.col("b.s")).alias("score"))


def missing_bars(b: DataFrame, f: DataFrame) -> DataFrame:
    """(recording_id, bar, family_no) where a family's median step says that it should stand but the bar is sparse."""
    o = f.select(*REC, "family_no", F.explode("occurrences").alias("bar"))
    w = Window.partitionBy(*REC, "family_no").orderBy("bar")
    gaps = o.withColumn("before", F.lag("bar").over(w)).where("before is not null").withColumn("gap", F.col("bar") - F.col("before"))
    period = gaps.groupBy(*REC, "family_no").agg(F.greatest(F.lit(1), F.rint(F.median("gap")).cast("int")).alias("period"))
    wide = gaps.join(period, [*REC, "family_no"]).where("gap >= 2 * period")
    want = wide.select(*REC, "family_no", F.explode(F.sequence(F.col("before") + F.col("period"), F.col("bar") - 1, F.col("period"))).alias("bar"))
    runs = sparse_runs(b).select(*REC, F.explode(F.sequence("first_bar", "last_bar")).alias("bar"))
    return want.join(runs, [*REC, "bar"], "left_semi").distinct()


def missing_slots(observed: Column, expected: Column) -> Column:
    """U8: expected slots that are not there, in order."""
    return F.array_except(expected, observed)
