"""Repair of notes against audio activity: decisions by phase, the whole pass, scores and the loop of passes (M5, M6).

A phase decides about all its notes or regions on the notes as they are when it starts; what one decision changes for
another comes up in the next phase or pass. Every phase is joins and aggregates by recording and time bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E
from staveforge.sources.shared import staged

from .islands import merge_spans
from .timejoin import asof_join, band_join, interval_join
from .windows import overlap_best, overlap_mode, overlap_stats

REC = ["recording_id"]


@dataclass(frozen=True)
class Repair:
    """Seconds, ratios and confidences of a pass."""

    missing_min: float = 0.08
    max_extend: float = 0.5
    max_insert: float = 0.7
    context: float = 0.8
    overhang_min: float = 0.22
    tail_padding: float = 0.09
    min_duration: float = 0.1
    sustain_ratio: float = 0.16
    sustain_hold: float = 0.18
    pitch_hold: float = 0.16
    legato_window: float = 0.22
    legato_silence: float = 0.1
    split_min: float = 0.5
    split_edge: float = 0.12
    split_onset_ratio: float = 0.55
    split_valley: float = 0.35
    split_back: float = 0.12
    split_pitch: float = 0.75
    split_confidence: float = 0.75
    close_gap: float = 0.05
    near_pitch: int = 1
    insert_confidence: float = 0.8
    contour_confidence: float = 0.75
    bucket: float = 4.0


def profile(name: str, p: Repair) -> Repair:
    """Aggressive, sustain_legato, conservative; balanced, as any other name, is p itself."""
    if name == "aggressive":
        return replace(p, overhang_min=0.16, missing_min=0.06, insert_confidence=max(0.6, p.insert_confidence - 0.10), split_confidence=max(0.6, p.split_confidence - 0.08), split_pitch=max(0.4, p.split_pitch - 0.20))
    if name == "sustain_legato":
        return replace(p, overhang_min=max(0.26, p.overhang_min), close_gap=max(0.06, p.close_gap), insert_confidence=max(0.84, p.insert_confidence), split_confidence=max(0.82, p.split_confidence), sustain_ratio=max(0.20, p.sustain_ratio), legato_window=max(0.26, p.legato_window), split_pitch=max(0.9, p.split_pitch))
    if name == "conservative":
        return replace(p, overhang_min=max(0.32, p.overhang_min), missing_min=max(0.09, p.missing_min), close_gap=max(0.055, p.close_gap), insert_confidence=max(0.95, p.insert_confidence), split_confidence=max(0.95, p.split_confidence), split_pitch=max(1.4, p.split_pitch))
    return p


def pass_profile(index: int) -> str:
    """X11: the base parameters first, then the two that protect what is there."""
    return "balanced" if index <= 1 else "sustain_legato" if index == 2 else "conservative"


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """J15."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def covered(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """a with covered: how much of it the rows of b (disjoint) cover."""
    p = interval_join(a.select(*REC, "start_sec", "end_sec").distinct(), b.select(*REC, "start_sec", "end_sec"), REC, bucket)
    c = p.groupBy(*REC, "start_sec", "end_sec").agg(F.sum(F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec")).alias("covered"))
    return a.join(c, [*REC, "start_sec", "end_sec"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def missing_coverage(regions: DataFrame, notes: DataFrame, pitch: DataFrame, p: Repair) -> DataFrame:
    """Phase 1, a row for each region that notes leave open by missing_min: action, target_note_id, pitch_midi, confidence.

    EXTEND_NOTE draws the note before to the region's end, CLOSE_GAP the next note to its start; else a note is inserted
    with the pitch of the contour or of the nearest note, or the region goes to review.
    """
    spans = merge_spans(notes, REC, p.close_gap)
    r = covered(regions, spans, p.bucket).where(F.round(F.col("end_sec") - F.col("start_sec") - F.col("covered"), 9) >= p.missing_min)
    r = staged(r.select(*REC, "start_sec", "end_sec", "confidence"))
    slim = notes.select(*REC, "note_id", "start_sec", "end_sec", "pitch_midi")
    inside = interval_join(r, slim, REC, p.bucket).groupBy(*REC, "start_sec").agg(F.min(F.struct((-F.col("r_end_sec")).alias("e"), F.col("r_start_sec").alias("s"), F.col("r_note_id").alias("id"))).alias("i"))
    ends = slim.groupBy(*REC, F.col("end_sec").alias("at")).agg(F.min(F.struct("start_sec", "note_id")).alias("b")).select(*REC, "at", F.col("at").alias("before_end"), F.col("b.note_id").alias("before_id"))
    starts = slim.groupBy(*REC, F.col("start_sec").alias("at")).agg(F.min(F.struct("end_sec", "note_id")).alias("b")).select(*REC, "at", F.col("at").alias("next_start"), F.col("b.note_id").alias("next_id"))
    r = r.join(inside, [*REC, "start_sec"], "left")
    r = asof_join(r.withColumn("at", F.col("start_sec")), ends, REC, "at", ["before_end", "before_id"])
    r = asof_join(r.withColumn("at", F.col("end_sec")), starts, REC, "at", ["next_start", "next_id"], forward=True)
    r = staged(r)
    mid = r.select(*REC, "start_sec", ((F.col("start_sec") + F.col("end_sec")) * 0.5).alias("mid"))
    edges = slim.select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec", F.explode(F.array("start_sec", "end_sec")).alias("edge"))
    near = band_join(mid, edges, REC, "mid", "edge", p.context).groupBy(*REC, "start_sec").agg(F.min(F.struct(F.round(F.abs(F.col("r_edge") - F.col("mid")), 9).alias("d"), F.col("r_start_sec").alias("s"), F.col("r_end_sec").alias("e"), F.col("r_note_id").alias("id"), F.col("r_pitch_midi").alias("pitch"))).alias("n"))
    voiced = pitch.where(F.col("voiced") & (F.col("confidence") >= p.contour_confidence)).select(*REC, "start_sec", "end_sec", "frame_index", F.col("confidence").alias("sure"), F.rint(E.hz_to_midi(F.col("f0_hz"))).cast("int").alias("pm"))
    contour = interval_join(r.select(*REC, "start_sec", "end_sec"), voiced, REC, p.bucket, closed=True).groupBy(*REC, "start_sec").agg(F.min(F.struct((-F.col("r_sure")).alias("c"), F.col("r_frame_index").alias("i"), F.col("r_pm").alias("pm"))).alias("c"))
    r = r.join(near, [*REC, "start_sec"], "left").join(contour, [*REC, "start_sec"], "left")
    prev_end, prev_id = F.coalesce(-F.col("i.e"), "before_end"), F.when(F.col("i").isNotNull(), F.col("i.id")).otherwise(F.col("before_id"))
    by, lead = F.round(F.col("end_sec") - prev_end, 9), F.round(F.col("next_start") - F.col("start_sec"), 9)
    short = F.round(F.col("end_sec") - F.col("start_sec"), 9) <= p.max_insert
    sure = F.when(F.col("n").isNotNull() & short, E.clip(0.55 + 0.4 * F.col("confidence"), 0.0, 1.0)).when(F.col("c").isNotNull() & short, E.clip(0.50 + 0.35 * F.col("confidence"), 0.0, 1.0))
    sure = F.round(sure, 9)
    extend, close, insert = (by > 0) & (by <= p.max_extend), (lead > 0) & (lead <= p.max_extend), sure >= p.insert_confidence
    action = F.when(extend, "EXTEND_NOTE").when(close, "CLOSE_GAP").when(insert, "INSERT_MISSING_NOTE").otherwise("REVIEW_MANUAL")
    r = r.withColumn("action", action)
    is_ = lambda x: F.col("action") == x
    target = F.when(is_("EXTEND_NOTE"), prev_id).when(is_("CLOSE_GAP"), F.col("next_id"))
    conf = F.when(is_("EXTEND_NOTE"), E.clip(0.7 + 0.2 * F.col("confidence"), 0.0, 1.0)).when(is_("CLOSE_GAP"), E.clip(0.65 + 0.2 * F.col("confidence"), 0.0, 1.0)).otherwise(F.coalesce(sure, F.lit(0.4)))
    return r.select(*REC, "start_sec", "end_sec", "action", target.alias("target_note_id"), F.when(is_("INSERT_MISSING_NOTE"), F.coalesce("c.pm", "n.pitch")).alias("pitch_midi"), F.round(conf, 9).alias("confidence"))


def apply_coverage(notes: DataFrame, found: DataFrame) -> DataFrame:
    """Notes after phase 1, with phase_1 naming what was done; inserted notes are repair_missing_000001 and on, in time order."""
    ext = found.where("action = 'EXTEND_NOTE'").groupBy(*REC, F.col("target_note_id").alias("note_id")).agg(F.max("end_sec").alias("__e"))
    gap = found.where("action = 'CLOSE_GAP'").groupBy(*REC, F.col("target_note_id").alias("note_id")).agg(F.min("start_sec").alias("__s"))
    n = notes.join(ext, [*REC, "note_id"], "left").join(gap, [*REC, "note_id"], "left")
    n = n.select(*REC, "note_id", "pitch_midi", F.least("start_sec", F.coalesce("__s", "start_sec")).alias("start_sec"), F.greatest("end_sec", F.coalesce("__e", "end_sec")).alias("end_sec"), F.when(F.col("__e").isNotNull(), "EXTENDED").when(F.col("__s").isNotNull(), "GAP_CLOSED").alias("phase_1"))
    no = F.row_number().over(Window.partitionBy(*REC).orderBy("start_sec"))
    new = found.where("action = 'INSERT_MISSING_NOTE'").select(*REC, F.format_string("repair_missing_%06d", no).alias("note_id"), "pitch_midi", "start_sec", "end_sec", F.lit("INSERTED").alias("phase_1"))
    return n.unionByName(new)


def overhangs(notes: DataFrame, regions: DataFrame, frames: DataFrame, pitch: DataFrame, p: Repair) -> DataFrame:
    """Phase 2, a row for each note that outlasts its best region by overhang_min: decision and proposed_end.

    A legato step to the next note, energy that goes on, or a voiced contour protect a note; else it is shortened,
    unless it would get shorter than min_duration.
    """
    n = notes.select(*REC, "note_id", "start_sec", "end_sec")
    r = regions.select(*REC, "start_sec", "end_sec")
    best = interval_join(n, r, REC, p.bucket)
    best = best.groupBy(*REC, "note_id", "start_sec", "end_sec").agg(F.min(F.struct((-F.round(F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec"), 9)).alias("o"), F.col("r_start_sec").alias("s"), F.col("r_end_sec").alias("e"))).alias("b"))
    o = best.withColumn("region_end", F.col("b.e")).where(F.round(F.col("end_sec") - F.col("region_end"), 9) >= p.overhang_min).withColumn("cand", F.least(F.col("end_sec"), F.col("region_end") + p.tail_padding)).drop("b")
    starts = n.select(*REC, F.col("start_sec").alias("at"), F.col("start_sec").alias("next_start")).distinct()
    o = staged(asof_join(o.withColumn("at", F.col("end_sec")), starts, REC, "at", ["next_start"], forward=True).drop("at"))
    gap = F.round(F.col("next_start") - F.col("end_sec"), 9)
    bridge = o.where(gap > 0).select(*REC, "note_id", F.col("end_sec").alias("start_sec"), F.col("next_start").alias("end_sec"))
    bridged = interval_join(bridge, r, REC, p.bucket).select(*REC, "note_id").distinct().withColumn("bridged", F.lit(True))
    points = frames.select(*REC, "start_sec", F.col("start_sec").alias("end_sec"), F.col("rms").alias("v"))

    def window(a: Column, b: Column, right: DataFrame, *values: str) -> DataFrame:
        w = o.select(*REC, "note_id", a.alias("start_sec"), b.alias("end_sec"))
        return overlap_stats(w, right, REC, "note_id", list(values), closed=True, width=p.bucket)

    until = lambda hold: F.greatest("cand", F.least("end_sec", F.col("cand") + hold))
    after = window(F.col("cand"), until(p.sustain_hold), points, "v").select(*REC, "note_id", F.col("avg_v").alias("after_mean"), F.col("max_v").alias("after_max"))
    own = window(F.col("start_sec"), F.col("end_sec"), points, "v").select(*REC, "note_id", F.col("max_v").alias("own_max"))
    tone = window(F.col("cand"), until(p.pitch_hold), pitch.select(*REC, "start_sec", "end_sec", "voiced", F.col("confidence").alias("sure")), "voiced", "sure").select(*REC, "note_id", (F.col("max_voiced") > 0).alias("voiced"), F.col("avg_sure").alias("sure"))
    for x in (bridged, after, own, tone):
        o = o.join(x, [*REC, "note_id"], "left")
    legato = (gap <= p.legato_window) & (F.coalesce("bridged", F.lit(False)) | (gap < p.legato_silence))
    ratio = F.round(F.col("after_mean") / F.greatest(F.lit(1e-6), F.coalesce("own_max", "after_max")), 9)
    decision = (
        F.when(legato, "LEGATO_PROTECTED").when(ratio >= p.sustain_ratio, "SUSTAIN_PROTECTED").when(F.col("voiced") & (F.round("sure", 9) >= 0.6), "PITCH_PROTECTED")
        .when(F.round(F.col("cand") - F.col("start_sec"), 9) >= p.min_duration, "SHORTENED").otherwise("MINIMUM_DURATION")
    )
    return o.select(*REC, "note_id", "start_sec", "end_sec", decision.alias("decision"), F.col("cand").alias("proposed_end"))


def apply_overhangs(notes: DataFrame, found: DataFrame) -> DataFrame:
    d = found.select(*REC, "note_id", F.col("decision").alias("phase_2"), F.col("proposed_end").alias("__e"))
    return notes.join(d, [*REC, "note_id"], "left").withColumn("end_sec", F.when(F.col("phase_2") == "SHORTENED", F.col("__e")).otherwise(F.col("end_sec"))).drop("__e")


def splits(notes: DataFrame, frames: DataFrame, pitch: DataFrame, p: Repair) -> DataFrame:
    """Phase 3, a row for each note with an inner onset after a valley: split_sec, pitch_change, confidence, SPLIT_NOTE or REVIEW_MANUAL."""
    n = notes.where(F.round(F.col("end_sec") - F.col("start_sec"), 9) >= p.split_min).select(*REC, "note_id", F.col("start_sec").alias("s"), F.col("end_sec").alias("e"), (F.col("start_sec") + p.split_edge).alias("a"), (F.col("end_sec") - p.split_edge).alias("b")).where("b > a")
    points = frames.select(*REC, "start_sec", F.col("start_sec").alias("end_sec"), "frame_index", F.col("onset_score").alias("v"))

    def window(a: Column, b: Column) -> DataFrame:
        return n.select(*REC, "note_id", a.alias("start_sec"), b.alias("end_sec"))

    inner = window(F.col("a"), F.col("b"))
    peak = overlap_best(inner, points, REC, "note_id", "v", True, p.bucket).select(*REC, "note_id", F.col("v").alias("onset"), F.col("at").alias("t"), F.col("avg_v").alias("mean"))
    n = staged(n.join(peak, [*REC, "note_id"]).where(F.col("onset") >= F.greatest(F.lit(1e-6), F.col("mean") * p.split_onset_ratio)))
    valley = overlap_stats(window(F.greatest("s", F.col("t") - p.split_back), F.col("t")), points, REC, "note_id", ["v"], True, p.bucket).select(*REC, "note_id", F.col("avg_v").alias("valley"))
    n = staged(n.join(valley, [*REC, "note_id"], "left").withColumn("valley", F.coalesce("valley", F.lit(0.0))).where(F.round("valley", 9) <= F.greatest(F.lit(1e-6), F.round(F.col("onset") * p.split_valley, 9))))
    tones = pitch.where("voiced").select(*REC, "start_sec", "end_sec", "frame_index", F.rint(E.hz_to_midi(F.col("f0_hz"))).cast("int").alias("pm"), F.lit(1.0).alias("one"))

    def dominant(a: Column, b: Column, out: str) -> DataFrame:
        return overlap_mode(window(a, b), tones, REC, "note_id", "pm", "one", p.bucket).select(*REC, "note_id", F.col("pm").alias(out))

    n = n.join(dominant(F.col("a"), F.greatest("a", F.col("t") - 0.04), "p0"), [*REC, "note_id"], "left").join(dominant(F.least("b", F.col("t") + 0.04), F.col("b"), "p1"), [*REC, "note_id"], "left")
    change = F.coalesce(F.abs(F.col("p1") - F.col("p0")).cast("double"), F.lit(0.0))
    sure = F.least(F.lit(1.0), F.least(F.lit(1.0), 0.65 + F.col("onset") / F.greatest(F.lit(1e-6), F.col("mean")) * 0.1) + F.when(change >= p.split_pitch, 0.12).otherwise(0.0))
    flat = (change < p.split_pitch) & (F.round("valley", 9) >= F.greatest(F.lit(1e-6), F.round(F.col("onset") * 0.02, 9)))
    action = F.when(flat | (F.round(sure, 9) < p.split_confidence), "REVIEW_MANUAL").otherwise("SPLIT_NOTE")
    return n.select(*REC, "note_id", F.col("t").alias("split_sec"), change.alias("pitch_change"), F.round(F.when(flat, 0.5).otherwise(sure), 9).alias("confidence"), action.alias("action"))


def apply_splits(notes: DataFrame, found: DataFrame) -> DataFrame:
    """Phase 4: notes cut in two, but for those that phase 1 made or drew out and those whose sustain phase 2 protected; second parts are repair_split_000001 and on."""
    s = found.where("action = 'SPLIT_NOTE'").select(*REC, "note_id", "split_sec")
    n = notes.join(s, [*REC, "note_id"], "left")
    cut = F.col("split_sec").isNotNull() & (F.col("split_sec") > F.col("start_sec")) & (F.col("split_sec") < F.col("end_sec")) & ~F.coalesce(F.col("phase_1").isin("INSERTED", "EXTENDED"), F.lit(False)) & ~F.coalesce(F.col("phase_2") == "SUSTAIN_PROTECTED", F.lit(False))
    n = n.withColumn("cut", cut)
    no = F.row_number().over(Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id"))
    second = n.where("cut").select(*REC, F.format_string("repair_split_%06d", no).alias("note_id"), "pitch_midi", F.col("split_sec").alias("start_sec"), "end_sec", "phase_1", "phase_2", F.lit(True).alias("cut"))
    return n.withColumn("end_sec", F.when(F.col("cut"), F.col("split_sec")).otherwise(F.col("end_sec"))).drop("split_sec").unionByName(second)


def close_and_trim(notes: DataFrame, regions: DataFrame, p: Repair) -> DataFrame:
    """Phase 5: gaps up to close_gap to a next note of near pitch close where audio is active; then an end past the next start is cut back to it."""
    w = Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id")
    n = notes.withColumns({"ns": F.lead("start_sec").over(w), "np": F.lead("pitch_midi").over(w)})
    gap = F.round(F.col("ns") - F.col("end_sec"), 9)
    small = n.where((gap > 0) & (gap <= p.close_gap) & (F.abs(F.col("np") - F.col("pitch_midi")) <= p.near_pitch)).select(*REC, "note_id", F.col("end_sec").alias("start_sec"), F.col("ns").alias("end_sec"))
    live = interval_join(small, regions.select(*REC, "start_sec", "end_sec"), REC, p.bucket).select(*REC, "note_id").distinct().withColumn("closes", F.lit(True))
    n = n.join(live, [*REC, "note_id"], "left")
    end = F.when(F.coalesce("closes", F.lit(False)), F.col("ns")).otherwise(F.col("end_sec"))
    return n.withColumn("end_sec", F.greatest("start_sec", F.least(end, F.coalesce("ns", end)))).withColumn("phase_5", F.coalesce("closes", F.lit(False))).drop("ns", "np", "closes")


def repair(notes: DataFrame, regions: DataFrame, frames: DataFrame, pitch: DataFrame, p: Repair) -> DataFrame:
    """M5: notes (recording_id, note_id, pitch_midi, start_sec, end_sec) after all phases, with what each phase did.

    Each phase reads the notes several times, so they are staged between phases, as is what a phase reads again inside.
    """
    n = staged(apply_coverage(notes, missing_coverage(regions, notes, pitch, p)))
    n = staged(apply_overhangs(n, overhangs(n, regions, frames, pitch, p)))
    n = staged(apply_splits(n, splits(n, frames, pitch, p)))
    return close_and_trim(n, regions, p)


def dominant_pitch(notes: DataFrame, pitch: DataFrame, bucket: float) -> DataFrame:
    """(recording_id, note_id, expected): the pitch with most confidence under a note, the first of equals; notes without voiced frames have no row."""
    f = pitch.where("voiced").select(*REC, "start_sec", "end_sec", "frame_index", "confidence", F.rint(E.hz_to_midi(F.col("f0_hz"))).cast("int").alias("pm"))
    return overlap_mode(notes.select(*REC, "note_id", "start_sec", "end_sec"), f, REC, "note_id", "pm", "confidence", bucket).select(*REC, "note_id", F.col("pm").alias("expected"))


def heard(notes: DataFrame, pitch: DataFrame, bucket: float = 4.0) -> DataFrame:
    """Notes that have a dominant pitch with it as expected."""
    return notes.select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec").join(dominant_pitch(notes, pitch, bucket), [*REC, "note_id"])


def error_regions(notes: DataFrame, regions: DataFrame, pitch: DataFrame, bucket: float = 4.0, known: DataFrame | None = None) -> DataFrame:
    """(recording_id, kind, start_sec, end_sec, severity, note_id) of gaps in coverage, overhangs, micro gaps and wrong pitches.

    known: heard(), where the caller has it.
    """
    n = notes.select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec")
    audio, midi = merge_spans(regions, REC), merge_spans(n, REC)
    length = F.greatest(F.lit(1e-9), F.col("end_sec") - F.col("start_sec"))
    share = F.round(F.col("covered") / length, 9)
    gap = covered(regions.select(*REC, "start_sec", "end_sec"), midi, bucket).withColumn("c", share).where("c < 0.9").select(*REC, F.lit("AUDIO_GAP").alias("kind"), "start_sec", "end_sec", (1 - F.col("c")).alias("severity"), F.lit(None).cast("string").alias("note_id"))
    over = covered(n, audio, bucket).withColumn("c", share).where("c < 0.85").join(regions.select(*REC).distinct(), REC, "left_semi")
    over = over.select(*REC, F.lit("MIDI_OVERHANG").alias("kind"), "start_sec", "end_sec", (1 - F.col("c")).alias("severity"), "note_id")
    nx = F.lead("start_sec").over(Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id"))
    micro = n.withColumn("ns", nx).withColumn("g", F.round(F.col("ns") - F.col("end_sec"), 9)).where("g > 0 and g <= 0.06")
    micro = micro.select(*REC, F.lit("MICRO_GAP").alias("kind"), F.col("end_sec").alias("start_sec"), F.col("ns").alias("end_sec"), F.least(F.lit(1.0), F.col("g") / 0.06).alias("severity"), "note_id")
    wrong = (known if known is not None else heard(n, pitch, bucket)).where(F.abs(F.col("pitch_midi") - F.col("expected")) > 1)
    wrong = wrong.select(*REC, F.lit("PITCH_MISMATCH").alias("kind"), "start_sec", "end_sec", F.lit(0.6).alias("severity"), "note_id")
    return gap.unionByName(over).unionByName(micro).unionByName(wrong)


def score(notes: DataFrame, regions: DataFrame, pitch: DataFrame, bucket: float = 4.0) -> DataFrame:
    """Coverage, overhang, continuity, pitch_consistency, total and errors of each recording that has notes or regions."""
    return assess(notes, regions, pitch, bucket)[0]


def assess(notes: DataFrame, regions: DataFrame, pitch: DataFrame, bucket: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """score() and the error_regions() that it counts, staged, with the dominant pitches searched once for both."""
    known = staged(heard(notes, pitch, bucket))
    errors = staged(error_regions(notes, regions, pitch, bucket, known))
    audio, midi = merge_spans(regions, REC), merge_spans(notes, REC)
    length = F.col("end_sec") - F.col("start_sec")
    a = covered(audio, midi, bucket).groupBy(*REC).agg(F.sum(length).alias("audio"), F.sum("covered").alias("both"))
    m = midi.groupBy(*REC).agg(F.sum(length).alias("midi"))
    found = errors.groupBy(*REC).agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("kind") == "MICRO_GAP").alias("micro"))
    t = known.groupBy(*REC).agg(F.avg((F.abs(F.col("pitch_midi") - F.col("expected")) <= 1).cast("double")).alias("pitch"))
    s = a.join(m, REC, "full").join(found, REC, "left").join(t, REC, "left").na.fill(0.0, ["audio", "both", "midi"]).na.fill(0, ["errors", "micro"])
    cover = F.when(F.col("audio") <= 1e-9, 1.0).otherwise(E.clip(F.col("both") / F.col("audio"), 0.0, 1.0))
    hang = 1 - F.when(F.col("midi") <= 1e-9, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("midi") - F.col("both")) / F.col("midi")))
    flow = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("micro") * 0.06))
    s = s.select(*REC, cover.alias("coverage"), hang.alias("overhang"), flow.alias("continuity"), F.coalesce("pitch", F.lit(0.9)).alias("pitch_consistency"), "errors")
    return s.withColumn("total", 0.35 * F.col("coverage") + 0.20 * F.col("overhang") + 0.30 * F.col("continuity") + 0.15 * F.col("pitch_consistency")), errors


def fingerprint(start: Column, end: Column) -> Column:
    """milliseconds, half to even."""
    return F.struct(F.rint(start * 1000).cast("long").alias("start_ms"), F.rint(end * 1000).cast("long").alias("end_ms"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """after with kind (NEW, CHANGED, SAME) against the same note in before, whose times come as old_start and old_end."""
    b = before.select(*REC, "note_id", F.col("start_sec").alias("old_start"), F.col("end_sec").alias("old_end"))
    same = fingerprint(F.col("start_sec"), F.col("end_sec")) == fingerprint(F.col("old_start"), F.col("old_end"))
    return after.join(b, [*REC, "note_id"], "left").withColumn("kind", F.when(F.col("old_start").isNull(), "NEW").when(same, "SAME").otherwise("CHANGED"))


def restrict(before: DataFrame, after: DataFrame, errors: DataFrame, bucket: float = 4.0) -> DataFrame:
    """Changes outside error regions of a severity of 0.2 are taken back, new notes there are dropped; a recording without such regions stays as it is."""
    e = errors.where(F.round("severity", 9) >= 0.20).select(*REC, "start_sec", "end_sec")
    c = changes(before, after)
    # Errors that overlap are one span; spans that only touch stay apart, so the result is that of the single errors.
    inside = interval_join(c.select(*REC, "note_id", "start_sec", "end_sec"), merge_spans(e, REC, -1e-12).select(*REC, "start_sec", "end_sec"), REC, bucket).select(*REC, "note_id").distinct().withColumn("inside", F.lit(True))
    c = c.join(inside, [*REC, "note_id"], "left").join(e.select(*REC).distinct().withColumn("bound", F.lit(True)), REC, "left")
    out = F.coalesce("bound", F.lit(False)) & ~F.coalesce("inside", F.lit(False))
    back = out & (F.col("kind") == "CHANGED")
    c = c.where(~(out & (F.col("kind") == "NEW")))
    return c.withColumns({"start_sec": F.when(back, F.col("old_start")).otherwise(F.col("start_sec")), "end_sec": F.when(back, F.col("old_end")).otherwise(F.col("end_sec"))}).drop("old_start", "old_end", "kind", "inside", "bound")


def stable_notes(before: DataFrame, after: DataFrame, errors: DataFrame, tolerance_ms: float = 20.0, bucket: float = 4.0) -> DataFrame:
    """(recording_id, note_id) that moved at most tolerance_ms and that no error region touches; an error with a note touches that note only."""
    c = changes(before, after).where("kind <> 'NEW'")
    f, g = fingerprint(F.col("start_sec"), F.col("end_sec")), fingerprint(F.col("old_start"), F.col("old_end"))
    near = c.where((F.abs(f["start_ms"] - g["start_ms"]) <= tolerance_ms) & (F.abs(f["end_ms"] - g["end_ms"]) <= tolerance_ms)).select(*REC, "note_id")
    own = errors.where("note_id is not null").select(*REC, "note_id")
    touched = interval_join(after.select(*REC, "note_id", "start_sec", "end_sec"), errors.where("note_id is null").select(*REC, "start_sec", "end_sec"), REC, bucket).select(*REC, "note_id")
    return near.join(own.union(touched).distinct(), [*REC, "note_id"], "left_anti")


def freeze(before: DataFrame, after: DataFrame, stable: DataFrame) -> DataFrame:
    """Stable notes go back to their times in before; frozen marks them."""
    b = before.select(*REC, "note_id", F.col("start_sec").alias("__s"), F.col("end_sec").alias("__e"))
    a = after.join(stable.select(*REC, "note_id").withColumn("__f", F.lit(True)), [*REC, "note_id"], "left").join(b, [*REC, "note_id"], "left")
    frozen = F.coalesce(F.col("__f"), F.lit(False)) & F.col("__s").isNotNull()
    return a.withColumns({"start_sec": F.when(frozen, F.col("__s")).otherwise(F.col("start_sec")), "end_sec": F.when(frozen, F.col("__e")).otherwise(F.col("end_sec")), "frozen": frozen}).drop("__s", "__e", "__f")


def iterate(notes: DataFrame, regions: DataFrame, frames: DataFrame, pitch: DataFrame, p: Repair, passes: int = 3, min_improvement: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """M6: (notes of the best pass, summary rows): passes with their profiles, each recording by itself.

    A pass is accepted where the total score rises; from the second pass on only changes inside error regions count.
    A recording stops after a gain below min_improvement or without errors. State is checkpointed after each pass, scores
    and errors of the notes as they stand with it: those of an accepted candidate are the next pass's own.
    """
    core = ["recording_id", "note_id", "pitch_midi", "start_sec", "end_sec"]
    regions, pitch, frames = staged(regions), staged(pitch), staged(frames)
    current = staged(notes.select(*core))
    open_, summary = staged(current.select(*REC).distinct()), None
    totals, errors = assess(current, regions.join(open_, REC, "left_semi"), pitch)
    totals = staged(totals.select(*REC, F.col("total").alias("was")))
    for i in range(1, passes + 1):
        q = profile(pass_profile(i) if i < passes else "conservative", p)
        live, audio = staged(current.join(open_, REC, "left_semi")), staged(regions.join(open_, REC, "left_semi"))
        cand = repair(live, audio, frames, pitch, q).select(*core)
        # Names of a later pass must not meet those of an earlier one.
        fresh = F.col("note_id").rlike("^repair_(missing|split)_[0-9]{6}$")
        cand = cand.join(live.select(*REC, "note_id").withColumn("__old", F.lit(True)), [*REC, "note_id"], "left").withColumn("note_id", F.when(fresh & F.col("__old").isNull(), F.concat("note_id", F.lit(f"_p{i}"))).otherwise(F.col("note_id"))).drop("__old")
        if i > 1:
            cand = restrict(live, staged(cand), errors.join(open_, REC, "left_semi")).select(*core)
        cand = staged(cand)
        now, found = assess(cand, audio, pitch)
        s = staged(totals.join(open_, REC, "left_semi").join(now.select(*REC, F.col("total").alias("now"), "errors"), REC).withColumn("accepted", F.col("now") > F.col("was")).withColumn("iteration", F.lit(i)))
        summary = s if summary is None else summary.unionByName(s)
        good = s.where("accepted").select(*REC)
        current = staged(current.join(good, REC, "left_anti").unionByName(cand.join(good, REC, "left_semi")))
        if i < passes:
            totals = staged(totals.join(good, REC, "left_anti").unionByName(s.where("accepted").select(*REC, F.col("now").alias("was"))))
            errors = staged(errors.join(good, REC, "left_anti").unionByName(found.join(good, REC, "left_semi")))
            stop = F.col("accepted") & ((F.col("now") - F.col("was") < min_improvement) | (F.col("errors") == 0))
            open_ = staged(open_.join(s.where(stop).select(*REC), REC, "left_anti"))
    return current, summary
