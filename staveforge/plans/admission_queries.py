"""Admission of proposed notes (M22, P26, J26, X62, A39) on the phrase tables: each bar's notes, moved on by a bar, are proposed for the sparse bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.operators import admission as A
from staveforge.operators import completion as C
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import staged_by

from .registry import query

REC = ["recording_id"]


def proposed(t: Tables) -> DataFrame:
    """Every note of the phrases a bar later, some changed in pitch, length or time by their tick and velocity."""
    n = t.phrases.join(t.phrase_timing.select(*REC, "beats_per_bar", "beat_sec"), REC)
    v, k = F.col("velocity"), F.col("start_tick") / 2
    on = F.col("start_sec") + F.col("beats_per_bar") * F.col("beat_sec") - F.when(v % 17 == 0, 1000.0).otherwise(0.0)
    length = F.when(v % 13 == 0, 0.02).when(v % 19 == 0, 9.0).when(v % 23 == 0, 0.0).otherwise((F.col("end_sec") - F.col("start_sec")) / 2)
    step = F.when(k % 7 == 0, -24).when(k % 7 == 1, 2).otherwise(0)
    return n.select(*REC, "note_id", F.round(on, 6).alias("start_sec"), F.round(on + length, 6).alias("end_sec"), (F.col("pitch_midi") + step).cast("int").alias("pitch_midi"), v.alias("velocity"), (v / 100).alias("confidence"))


def regions(t: Tables) -> DataFrame:
    """Bars with two notes at most, each a region with the pitches of the bars beside it."""
    b = staged_by(C.bars(C.on_bars(t.phrases, t.phrase_timing)), REC)
    near = b.select(*REC, "pitches", F.explode(F.array(F.col("bar") - 1, F.col("bar") + 1)).alias("bar")).select(*REC, "bar", F.explode("pitches").alias("p"))
    local = near.groupBy(*REC, "bar").agg(F.array_sort(F.collect_set("p")).alias("pitches"))
    r = b.where("n <= 2").drop("pitches").join(local, [*REC, "bar"])
    return r.select(
        *REC, F.col("bar").alias("region_no"), "start_sec", "end_sec", (F.col("start_sec") + 0.01).alias("write_start_sec"), F.col("end_sec").alias("write_end_sec"), F.array_min("pitches").alias("low"), F.array_max("pitches").alias("high"),
        F.when(F.col("bar") % 5 == 0, F.array().cast("array<int>")).otherwise(F.col("pitches")).alias("pitches"), (F.col("bar") % 3 == 0).alias("any_pitch"), F.lit(0.06).alias("min_duration"), (1 + F.col("bar") % 4).alias("most"),
        (1.0 + F.col("bar") % 2).alias("density"), (F.col("n") > 0).alias("optional"), (F.col("bar") % 2).alias("least"),
    )


def limits(t: Tables) -> DataFrame:
    return t.phrases.groupBy(*REC).agg(F.max("end_sec").alias("duration_sec"), (3 + F.count(F.lit(1)) % 5).alias("most_notes"))


def _admitted(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The verdicts and the regions. All steps go by recording, so notes and regions are staged by it and exchanged once."""
    t.phrases = staged_by(t.phrases, REC)
    r = staged_by(regions(t), REC)
    return staged_by(A.admit(staged_by(proposed(t), REC), t.phrases, r, staged_by(limits(t), REC)), REC), r


@query("m22_p26_admission")
def m22(t: Tables) -> DataFrame:
    """The verdict on every proposed note."""
    return _admitted(t)[0]


@query("a39_region_report")
def a39(t: Tables) -> DataFrame:
    return A.region_report(*_admitted(t))
