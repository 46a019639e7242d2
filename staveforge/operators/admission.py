"""Admission of proposed notes under the limits of their regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .timejoin import interval_join

REC = ["recording_id"]
NOTE = [*REC, "note_id"]
OUTSIDE = "outside_allowed_completion_region"


def region_of(notes: DataFrame, regions: DataFrame, width: float = 4.0) -> DataFrame:
    """(recording_id, note_id, region_no): the first region, by number, whose write span holds the whole note; notes in none have no row.

    The two meet in time buckets of width seconds.
    """
    spans = regions.select(*REC, "region_no", F.col("write_start_sec").alias("start_sec"), F.col("write_end_sec").alias("end_sec"))
    # Touching spans must meet too: a note may begin or end where its region does, or be a point.
    j = interval_join(notes.where("start_sec <= end_sec").select(*NOTE, "start_sec", "end_sec"), spans, REC, width, closed=True)
    return j.where("start_sec >= r_start_sec and end_sec <= r_end_sec").groupBy(*NOTE).agg(F.min("r_region_no").alias("region_no"))


def doubles(notes: DataFrame, base: DataFrame, width: float = 1.0) -> DataFrame:
    """(recording_id, note_id, double) of notes that a base note within a semitone is in the way of: onset within 30 ms, or 70 % of the shorter one overlapped; that of the first such note in time."""
    j = interval_join(notes.where("start_sec < end_sec").select(*NOTE, "start_sec", "end_sec", "pitch_midi"), base.select(*NOTE, "start_sec", "end_sec", "pitch_midi"), REC, width)
    over = F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec")
    shorter = F.greatest(F.lit(1e-6), F.least(F.col("end_sec") - F.col("start_sec"), F.col("r_end_sec") - F.col("r_start_sec")))
    why = F.when(F.abs(F.col("start_sec") - F.col("r_start_sec")) <= 0.03, "duplicate_base_note_onset").when(over / shorter >= 0.7, "duplicate_base_note_overlap")
    hit = j.where(F.abs(F.col("pitch_midi") - F.col("r_pitch_midi")) <= 1).withColumn("why", why).where("why is not null")
    return hit.groupBy(*NOTE).agg(F.min(F.struct("r_start_sec", "r_end_sec", "r_pitch_midi", "r_note_id", "why"))["why"].alias("double"))


def capacity(most: Column, density: Column, seconds: Column) -> Column:
    """The largest count that is within most and whose density over seconds is within density; 0 at least."""
    near = F.floor(density * seconds)
    fits = F.when((near + 1) / seconds <= density, near + 1).when(near / seconds <= density, near).otherwise(near - 1)
    return F.greatest(F.lit(0), F.least(most, fits)).cast("long")


def admit(notes: DataFrame, base: DataFrame, regions: DataFrame, limits: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Notes with region_no (null outside) and reason, the first rule that they break, or null if they are admitted.

    notes: recording_id, note_id (unique in a recording), start_sec, end_sec, pitch_midi, confidence. regions: region_no,
    start_sec, end_sec, write_start_sec, write_end_sec, low, high, pitches (empty: all), any_pitch, min_duration, most,
    density. limits: a row for each recording, duration_sec and most_notes.

    Notes are taken by start, end and id. Whether one is admitted depends on how many were before: a region takes
    notes until its count or density is reached, a recording until most_notes are in. Both counts only rise, so they
    are places among the notes that pass the rules before: the k-th such note of a region is within its limits while
    k <= capacity(), the n-th of those of a recording while n <= most_notes. Beyond most_notes a region's count stands
    still, at its place when the last note went in, and that place decides which of the two limits is named. The
    recording's places are counted by time bucket first, so that no recording is ordered in one task.

    A recording without regions admits none; one without limits or without base notes is left out of the result.
    """
    pitch = base.groupBy(*REC).agg((F.min("pitch_midi") - 12).alias("b_low"), (F.max("pitch_midi") + 12).alias("b_high"))
    span = regions.groupBy(*REC).agg(F.min("low").alias("r_low"), F.max("high").alias("r_high"))
    r = regions.select(*REC, "region_no", "low", "high", "pitches", "any_pitch", "min_duration", "most", "density", F.greatest(F.lit(1e-6), F.col("end_sec") - F.col("start_sec")).alias("seconds"))
    n = notes.join(limits.select(*REC, "duration_sec", "most_notes"), REC).join(pitch, REC).join(span, REC, "left")
    n = n.join(region_of(notes, regions), NOTE, "left").join(r, [*REC, "region_no"], "left").join(doubles(notes, base), NOTE, "left")
    long = F.col("end_sec") - F.col("start_sec")
    low, high = F.coalesce("r_low", "b_low"), F.coalesce("r_high", "b_high")
    alone = (
        F.when(F.col("r_low").isNull(), OUTSIDE)
        .when((F.col("start_sec") < 0) | (F.col("end_sec") < 0), "negative_time")
        .when(F.col("end_sec") <= F.col("start_sec"), "end_before_or_equal_start")
        .when((F.col("start_sec") > F.col("duration_sec")) | (F.col("end_sec") > F.col("duration_sec")), "outside_project_duration")
        .when(long < 0.025, "note_too_short")
        .when((long > 8.0) & (F.col("confidence") < 0.9), "note_too_long_low_confidence")
        .when((F.col("pitch_midi") < low) | (F.col("pitch_midi") > high), "pitch_outside_allowed_range")
        .when(F.col("double").isNotNull(), F.col("double"))
        .when(F.col("region_no").isNull(), OUTSIDE)
        .when(F.col("pitch_midi") < F.col("low"), "pitch_below_region_range")
        .when(F.col("pitch_midi") > F.col("high"), "pitch_above_region_range")
        .when((F.size("pitches") > 0) & ~F.array_contains("pitches", F.col("pitch_midi")) & ~F.col("any_pitch"), "pitch_not_in_local_pitch_set")
        .when(long < F.col("min_duration"), "note_too_short")
    )
    order = ["start_sec", "end_sec", "note_id"]
    n = n.withColumn("alone", alone)
    ok = F.col("alone").isNull()
    in_region = Window.partitionBy(*REC, "region_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("k", F.when(ok, F.sum(ok.cast("long")).over(in_region))).withColumn("room", capacity(F.col("most").cast("long"), F.col("density"), F.col("seconds")))
    # Places in the recording, of the notes that their regions have room for.
    fits = ok & (F.col("k") <= F.col("room"))
    n = n.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("t", F.floor(F.coalesce(F.col("start_sec"), F.lit(0.0)) / bucket))
    sizes = n.groupBy(*REC, "t").agg(F.sum(F.col("fits").cast("long")).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*REC).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.join(sizes.select(*REC, "t", before.alias("before")), [*REC, "t"])
    inside = F.sum(F.col("fits").cast("long")).over(Window.partitionBy(*REC, "t").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("place", F.col("before") + inside)
    n = n.withColumn("in", F.col("fits") & (F.col("place") <= F.col("most_notes")))
    # The region's count when this note's turn comes.
    held = F.coalesce(F.sum(F.col("in").cast("long")).over(in_region.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("next", held + 1)
    late = (
        F.when(F.col("next") > F.col("most"), "region_expected_count_exceeded").when(F.col("next") / F.col("seconds") > F.col("density"), "region_note_density_too_high")
        .when(~F.col("in"), "max_completion_notes_exceeded")
    )
    return n.select(*notes.columns, "region_no", F.coalesce("alone", late).alias("reason"))


def region_report(admitted: DataFrame, regions: DataFrame) -> DataFrame:
    """For each region how many notes were proposed in it, admitted and rejected, and why it got none."""
    c = admitted.where("region_no is not null").groupBy(*REC, "region_no").agg(F.count(F.lit(1)).alias("proposed"), F.count_if(F.col("reason").isNull()).alias("accepted"))
    r = regions.select(*REC, "region_no", "optional", "least").join(c, [*REC, "region_no"], "left").na.fill(0, ["proposed", "accepted"])
    none = (
        F.when(F.col("accepted") > 0, None).when(F.col("proposed") > 0, "all_region_notes_rejected").when(F.col("optional"), "optional_or_low_confidence_region")
        .when(F.col("least") > 0, "required_region_received_no_notes").otherwise("no_notes_proposed")
    )
    return r.select(*REC, "region_no", "proposed", "accepted", (F.col("proposed") - F.col("accepted")).alias("rejected"), none.alias("reason_if_zero"))
