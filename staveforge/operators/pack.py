"""Summaries that describe a piece to a completion service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E

from .timejoin import interval_join

REC = ["recording_id"]


def sections(lengths: DataFrame, least: float, parts: int) -> DataFrame:
    """(recording_id, section, start_sec, end_sec): pieces of max(least, duration / parts), the last one cut at duration_sec; a duration of 0 gives one."""
    size = F.greatest(F.lit(least), F.col("duration_sec") / parts)
    last = F.greatest(F.lit(0), F.ceil(F.round(F.col("duration_sec") / size, 9)).cast("int") - 1)
    s = lengths.withColumn("__size", size).withColumn("section", F.explode(F.sequence(F.lit(0), last)))
    return s.select(*REC, "section", (F.col("section") * F.col("__size")).alias("start_sec"), F.least("duration_sec", (F.col("section") + 1) * F.col("__size")).alias("end_sec"))


def active_runs(frames: DataFrame, ratio: float, onset: float) -> DataFrame:
    """Runs of frames with energy at ratio times the recording's or an onset: times, mean and peak energy, onsets."""
    every, w = Window.partitionBy(*REC), Window.partitionBy(*REC).orderBy("frame_index")
    level = F.greatest(F.lit(1e-6), F.sqrt(F.avg(F.col("rms") * F.col("rms")).over(every)) * ratio)
    f = frames.withColumn("__on", (F.col("rms") >= level) | (F.col("onset_score") >= onset))
    f = f.withColumn("__run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*REC, "__on").orderBy("frame_index"))).where("__on")
    return f.groupBy(*REC, "__run").agg(F.min("start_sec").alias("start_sec"), F.max_by("end_sec", "frame_index").alias("end_sec"), F.avg("rms").alias("rms_mean"), F.max("rms").alias("rms_peak"), F.count_if(F.col("onset_score") >= onset).alias("onset_count")).drop("__run")


def run_pitch(runs: DataFrame, pitch: DataFrame, bucket: float) -> DataFrame:
    """runs with dominant_pitch (most voiced frames, the first of equals) and pitch_confidence (mean of all frames)."""
    f = pitch.select(*REC, "start_sec", "end_sec", "frame_index", "voiced", F.col("confidence").alias("sure"), F.rint(E.hz_to_midi(F.col("f0_hz"))).cast("int").alias("pm"))
    j = interval_join(runs.select(*REC, "start_sec", "end_sec"), f, REC, bucket)
    sure = j.groupBy(*REC, "start_sec").agg(F.avg("r_sure").alias("pitch_confidence"))
    c = j.where("r_voiced").groupBy(*REC, "start_sec", "r_pm").agg(F.count(F.lit(1)).alias("c"), F.min("r_frame_index").alias("f"))
    top = c.groupBy(*REC, "start_sec").agg(F.min(F.struct((-F.col("c")).alias("c"), "f", F.col("r_pm").alias("p"))).alias("b")).select(*REC, "start_sec", F.col("b.p").alias("dominant_pitch"))
    return runs.join(sure, [*REC, "start_sec"], "left").join(top, [*REC, "start_sec"], "left")


def key_estimate(notes: DataFrame, by: list[str]) -> DataFrame:
    """(by, key_name): the commonest pitch class as root (the first heard of equals), major or minor by how many classes each scale holds; under three notes unknown."""
    n = notes.withColumn("pc", F.pmod("pitch_midi", F.lit(12)).cast("int"))
    c = n.groupBy(*by, "pc").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("start_sec", "note_id")).alias("first"))
    g = c.groupBy(*by).agg(F.sum("c").alias("notes"), F.min(F.struct((-F.col("c")).alias("c"), "first", "pc")).alias("top"), F.collect_set("pc").alias("pcs"))
    root = F.col("top.pc")

    def held(steps: tuple[int, ...]) -> Column:
        return F.size(F.filter("pcs", lambda x: F.array_contains(F.array(*[F.lit(s) for s in steps]), F.pmod(x - root + 12, F.lit(12)).cast("int"))))

    major, minor = held((0, 2, 4, 5, 7, 9, 11)), held((0, 2, 3, 5, 7, 8, 10))
    name = F.element_at(F.array(*[F.lit(x) for x in E.NAMES]), root + 1)
    kind = F.when(minor > major, " minor (estimated)").when(major > minor, " major (estimated)").otherwise(" modal (estimated)")
    return g.select(*by, F.when(F.col("notes") < 3, "unknown").otherwise(F.concat(name, kind)).alias("key_name"))


def gaps(notes: DataFrame, least: float) -> DataFrame:
    """(recording_id, start_sec, end_sec) of silences of at least least between the furthest end so far and the next note."""
    w = Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id")
    g = notes.withColumn("__e", F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return g.where(F.round(F.col("start_sec") - F.col("__e"), 9) >= least).select(*REC, F.col("__e").alias("start_sec"), F.col("start_sec").alias("end_sec"))


def gap_evidence(open_: DataFrame, runs: DataFrame, tones: DataFrame, bucket: float) -> DataFrame:
    """Gaps with active_ratio, onset_count, pitch_hits, active_start, active_end, has_evidence and reason. tones: sections with dominant_pitch and voiced_ratio."""
    j = interval_join(open_, runs.select(*REC, "start_sec", "end_sec", "onset_count"), REC, bucket)
    a, b = F.greatest("start_sec", "r_start_sec"), F.least("end_sec", "r_end_sec")
    r = j.groupBy(*REC, "start_sec").agg(F.sum(b - a).alias("o"), F.sum("r_onset_count").alias("n"), F.min(a).alias("a"), F.max(b).alias("b"))
    t = interval_join(open_, tones.where("dominant_pitch is not null and voiced_ratio >= 0.2").select(*REC, "start_sec", "end_sec"), REC, bucket).groupBy(*REC, "start_sec").agg(F.count(F.lit(1)).alias("h"))
    g = open_.join(r, [*REC, "start_sec"], "left").join(t, [*REC, "start_sec"], "left")
    ratio = F.round(F.coalesce("o", F.lit(0.0)) / F.greatest(F.lit(1e-6), F.col("end_sec") - F.col("start_sec")), 9)
    g = g.select(*REC, "start_sec", "end_sec", ratio.alias("active_ratio"), F.coalesce("n", F.lit(0)).alias("onset_count"), F.coalesce("h", F.lit(0)).alias("pitch_hits"), F.coalesce("a", "start_sec").alias("active_start"), F.coalesce("b", "end_sec").alias("active_end"))
    has = (F.col("active_ratio") >= 0.18) | (F.col("onset_count") >= 1) | (F.col("pitch_hits") >= 2)
    why = F.when((F.col("active_ratio") >= 0.4) & (F.col("onset_count") >= 1), "long_gap_with_strong_audio_activity").when(F.col("onset_count") >= 1, "long_gap_with_onset_evidence").when(F.col("pitch_hits") >= 2, "long_gap_with_pitch_contour_evidence").otherwise("long_gap_with_activity_evidence")
    return g.withColumns({"has_evidence": has, "reason": why})


def merge_candidates(found: DataFrame, gap: float = 0.1) -> DataFrame:
    """Candidates (start_sec, end_sec, onset_count, reason) at most gap apart as one, with the first reason, or the first strong one."""
    w = Window.partitionBy(*REC).orderBy("start_sec")
    far = F.round(F.col("start_sec") - F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1)), 9) > gap
    f = found.withColumn("__n", F.coalesce(far.cast("int"), F.lit(0))).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    strong = F.min_by(F.when(F.col("reason").contains("strong"), F.col("reason")), F.when(F.col("reason").contains("strong"), F.col("start_sec")))
    return f.groupBy(*REC, "__g").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("onset_count").alias("onset_count"), F.coalesce(strong, F.min_by("reason", "start_sec")).alias("reason")).drop("__g")


def pitch_changes(tones: DataFrame, limit: int) -> DataFrame:
    """(recording_id, start_sec, change) of the limit largest changes of at least 0.75 between neighbouring sections: semitones plus twice the change of confidence."""
    w = Window.partitionBy(*REC).orderBy("start_sec")
    step = F.coalesce(F.abs(F.col("dominant_pitch") - F.lag("dominant_pitch").over(w)).cast("double"), F.lit(0.0))
    c = tones.withColumn("change", F.round(step + 2 * F.abs(F.col("mean_confidence") - F.lag("mean_confidence").over(w)), 9)).where("change >= 0.75")
    return c.withColumn("__k", F.row_number().over(Window.partitionBy(*REC).orderBy(F.col("change").desc(), "start_sec"))).where(F.col("__k") <= limit).select(*REC, "start_sec", "change")


def select_runs(runs: DataFrame, notes: DataFrame, limit: int, bucket: float) -> DataFrame:
    """Limit runs of a recording: the top bucket by peak, by onsets and by fewest notes, then by 1.5 times peak plus onsets; the earliest of them by time if there are more."""
    n = interval_join(runs.select(*REC, "start_sec", "end_sec"), notes.select(*REC, "start_sec", "end_sec"), REC, bucket).groupBy(*REC, "start_sec").agg(F.count(F.lit(1)).alias("notes"))
    r = runs.join(n, [*REC, "start_sec"], "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
    by = Window.partitionBy(*REC)
    top = max(8, max(1, limit // 3))
    ranks = {
        "__a": F.row_number().over(by.orderBy(F.col("rms_peak").desc(), "start_sec")), "__b": F.row_number().over(by.orderBy(F.col("onset_count").desc(), F.col("rms_peak").desc(), "start_sec")),
        "__c": F.row_number().over(by.orderBy("notes", F.col("rms_peak").desc(), "start_sec")), "__all": F.count(F.lit(1)).over(by),
        "__d": F.row_number().over(by.orderBy((F.round(F.col("rms_peak") * 1.5 + F.col("onset_count"), 9)).desc(), "notes", "start_sec")),
    }
    r = r.withColumns(ranks).withColumn("__in", (F.least("__a", "__b", "__c") <= top).cast("int"))
    # Those outside the union fill it up in the order of __d.
    r = r.withColumn("__u", F.sum("__in").over(by)).withColumn("__f", F.row_number().over(by.orderBy("__in", "__d")))
    chosen = (F.col("__all") <= limit) | (F.col("__in") == 1) | ((F.col("__in") == 0) & (F.col("__f") <= F.lit(limit) - F.col("__u")))
    r = r.where(chosen).withColumn("__t", F.row_number().over(by.orderBy("start_sec"))).where((F.col("__t") <= limit) | (F.col("__all") <= limit))
    return r.select(*runs.columns, "notes")
