"""Notes against frames: validation, planning, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.functions import exprs as E
from staveforge.operators import align as AL
from staveforge.operators import validate as V
from staveforge.operators import windows as W
from staveforge.operators.timejoin import nearest_join
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import staged

from .registry import query, sql

# The fixture's time runs a thousand times faster than a stem's, so windows and thresholds are wider here.
WINDOW, MIN_ONSET, MIN_RMS = 0.5, 0.05, 0.3

EVIDENCE = """, ev AS (
  SELECT n.recording_id, n.note_id, count(f.frame_index) AS n_frames, coalesce(max(f.rms), 0.0) AS max_rms, coalesce(avg(f.rms), 0.0) AS mean_rms,
         coalesce(avg(CASE WHEN f.is_silent THEN 0.0 ELSE 1.0 END) FILTER (WHERE f.frame_index IS NOT NULL), 0.0) AS sustained
  FROM notes n LEFT JOIN frames f ON f.recording_id = n.recording_id AND f.end_sec > n.start_sec AND f.start_sec < n.end_sec GROUP BY ALL)"""
ONSET = f""", onset AS (
  SELECT recording_id, note_id, onset_score, nearest_onset_sec, onset_frame FROM (
    SELECT n.recording_id, n.note_id, f.onset_score, f.start_sec AS nearest_onset_sec, f.frame_index AS onset_frame,
           row_number() OVER (PARTITION BY n.recording_id, n.note_id ORDER BY f.onset_score DESC, abs(f.start_sec - n.start_sec), f.frame_index) AS rn
    FROM notes n JOIN frames f ON f.recording_id = n.recording_id AND abs(f.start_sec - n.start_sec) <= {WINDOW}) WHERE rn = 1)"""
VALID = f""", scored AS (
  SELECT n.recording_id, n.note_id, n.pitch_midi, n.layer, n.start_sec, n_frames, max_rms, mean_rms, sustained, coalesce(onset_score, 0.0) AS onset_score, nearest_onset_sec,
         0.6 * least(1.0, mean_rms / {MIN_RMS}) + 0.4 * least(1.0, max_rms / {2 * MIN_RMS}) AS energy_score, least(1.0, coalesce(onset_score, 0.0) / {MIN_ONSET}) AS onset_norm
  FROM notes n JOIN ev USING (recording_id, note_id) LEFT JOIN onset USING (recording_id, note_id)),
valid AS (SELECT *, least(1.0, greatest(0.0, 0.35 * onset_norm + 0.40 * energy_score + 0.25 * sustained)) AS confidence FROM scored)"""


@query("j5_interval_overlap", sql(", p AS (SELECT n.note_id, n.recording_id, f.frame_index FROM notes n JOIN frames f ON f.recording_id = n.recording_id AND f.end_sec > n.start_sec AND f.start_sec < n.end_sec) SELECT recording_id, note_id, frame_index FROM p", "notes", "frames"))
def j5(t: Tables) -> DataFrame:
    p = W.overlap_runs(t.notes, t.frames, ["recording_id"], "note_id")
    return p.select("recording_id", "note_id", F.explode(F.sequence("first", "last")).alias("frame_index"))


@query("j6_onset_top1", sql(ONSET + " SELECT recording_id, note_id, round(onset_score, 6) AS onset_score, onset_frame FROM onset", "notes", "frames"))
def j6(t: Tables) -> DataFrame:
    return V.onset_top1(t.notes, t.frames, WINDOW).select("recording_id", "note_id", F.round("onset_score", 6).alias("onset_score"), "onset_frame")


@query("a3_note_evidence", sql(EVIDENCE + " SELECT recording_id, note_id, n_frames, round(max_rms, 9) AS max_rms, round(mean_rms, 9) AS mean_rms, round(sustained, 9) AS sustained FROM ev", "notes", "frames"))
def a3(t: Tables) -> DataFrame:
    return V.note_evidence(t.notes, t.frames).select("recording_id", "note_id", "n_frames", *[F.round(c, 9).alias(c) for c in ("max_rms", "mean_rms", "sustained")])


def _valid(t: Tables) -> DataFrame:
    return V.validate(t.notes, t.frames, WINDOW, MIN_ONSET, MIN_RMS)


@query("p1_p4_validate_notes", sql(EVIDENCE + ONSET + VALID + f""" SELECT recording_id, note_id, round(energy_score, 6) AS energy_score, round(onset_norm, 6) AS onset_norm, round(confidence, 6) AS confidence,
  CASE WHEN confidence >= 0.70 THEN 'KEEP' WHEN confidence >= 0.45 THEN 'REVIEW' ELSE 'MUTE_CANDIDATE' END AS recommended_action,
  coalesce(nullif(concat_ws('; ', CASE WHEN n_frames = 0 THEN '{E.NO_FRAMES}' END, CASE WHEN onset_score < {MIN_ONSET} THEN '{E.WEAK_ONSET}' END, CASE WHEN mean_rms < {MIN_RMS} THEN '{E.LOW_RMS}' END, CASE WHEN sustained < 0.5 THEN '{E.WEAK_SUSTAIN}' END, CASE WHEN confidence >= 0.7 THEN '{E.HIGH_MATCH}' END), ''), '{E.MIXED}') AS reasons FROM valid""", "notes", "frames"))
def p1(t: Tables) -> DataFrame:
    return _valid(t).select("recording_id", "note_id", *[F.round(c, 6).alias(c) for c in ("energy_score", "onset_norm", "confidence")], "recommended_action", F.array_join("reasons", "; ").alias("reasons"))


_PLAN = "CASE WHEN confidence >= 0.70 THEN 'KEEP' WHEN confidence >= 0.45 THEN 'REVIEW' WHEN confidence < 0.20 THEN 'DELETE_CANDIDATE' ELSE 'MUTE' END"


@query("p5_plan_action", sql(EVIDENCE + ONSET + VALID + f" SELECT recording_id, note_id, {_PLAN} AS plan_action FROM valid", "notes", "frames"))
def p5(t: Tables) -> DataFrame:
    return V.plan(_valid(t), allow_delete=True).select("recording_id", "note_id", "plan_action")


@query("validate_plan", sql(EVIDENCE + ONSET + VALID + f" SELECT recording_id, {_PLAN} AS plan_action, count(*) AS notes, round(avg(confidence), 6) AS mean_confidence FROM valid GROUP BY ALL", "notes", "frames"))
def validate_plan(t: Tables) -> DataFrame:
    """The flagship: which notes should be kept, reviewed, muted or deleted, by recording (M2, M3, A4)."""
    return V.plan(_valid(t), allow_delete=True).groupBy("recording_id", "plan_action").agg(F.count(F.lit(1)).alias("notes"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("p13_selected_notes", sql(EVIDENCE + ONSET + VALID + f", plan AS (SELECT *, {_PLAN} AS a FROM valid) SELECT n.recording_id, n.note_id, n.pitch_midi FROM notes n WHERE EXISTS (SELECT 1 FROM plan p WHERE p.note_id = n.note_id AND p.recording_id = n.recording_id AND a IN ('KEEP', 'REVIEW'))", "notes", "frames"))
def p13(t: Tables) -> DataFrame:
    chosen = V.plan(_valid(t), allow_delete=True).where(F.col("plan_action").isin("KEEP", "REVIEW"))
    return t.notes.join(chosen.select("recording_id", "note_id"), ["recording_id", "note_id"], "left_semi").select("recording_id", "note_id", "pitch_midi")


@query("a4_action_report", sql(EVIDENCE + ONSET + VALID + " SELECT count(*) AS notes, count(*) FILTER (confidence >= 0.7) AS kept, count(*) FILTER (confidence >= 0.45 AND confidence < 0.7) AS review, count(*) FILTER (confidence < 0.45) AS muted, round(avg(confidence), 6) AS mean_confidence FROM valid", "notes", "frames"))
def a4(t: Tables) -> DataFrame:
    a = F.col("recommended_action")
    return _valid(t).agg(F.count(F.lit(1)).alias("notes"), F.count_if(a == "KEEP").alias("kept"), F.count_if(a == "REVIEW").alias("review"), F.count_if(a == "MUTE_CANDIDATE").alias("muted"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("j8_nearest_frame", sql(""", d AS (SELECT n.recording_id, n.note_id, f.frame_index, row_number() OVER (PARTITION BY n.recording_id, n.note_id ORDER BY abs(f.start_sec - n.end_sec), f.start_sec) AS rn
  FROM notes n JOIN frames f ON f.recording_id = n.recording_id) SELECT recording_id, note_id, frame_index FROM d WHERE rn = 1""", "notes", "frames"))
def j8(t: Tables) -> DataFrame:
    n = t.notes.select("recording_id", "note_id", F.col("end_sec").alias("at"))
    return nearest_join(n, t.frames.select("recording_id", F.col("start_sec").alias("at"), "frame_index"), ["recording_id"], "at", ["frame_index"]).select("recording_id", "note_id", "frame_index")


@query("w10_prev_next_rms", sql(" SELECT recording_id, frame_index, round(lag(rms, 1, 0.0) OVER w, 6) AS prev_rms, round(coalesce(lead(rms) OVER w, rms), 6) AS next_rms FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY frame_index)", "frames"))
def w10(t: Tables) -> DataFrame:
    return AL.neighbours(t.frames).select("recording_id", "frame_index", F.round("prev_rms", 6).alias("prev_rms"), F.round("next_rms", 6).alias("next_rms"))


@query("w11_onset_evidence", sql(f", r AS (SELECT *, rms - lag(rms, 1, 0.0) OVER (PARTITION BY recording_id ORDER BY frame_index) AS rise FROM frames) SELECT recording_id, frame_index, round(onset_score + rise + rms, 6) AS weight FROM r WHERE onset_score >= {MIN_ONSET} AND rms >= {MIN_RMS} AND rise > 0", "frames"))
def w11(t: Tables) -> DataFrame:
    return AL.onset_evidence(t.frames, MIN_ONSET, MIN_RMS).select("recording_id", "frame_index", F.round("weight", 6).alias("weight"))


@query("j9_best_onset", sql(f""", r AS (SELECT *, rms - lag(rms, 1, 0.0) OVER (PARTITION BY recording_id ORDER BY frame_index) AS rise FROM frames),
 c AS (SELECT n.recording_id, n.note_id, f.frame_index, f.onset_score, f.rise, f.rms, abs(f.start_sec - n.start_sec) AS d FROM notes n JOIN r f ON f.recording_id = n.recording_id AND abs(f.start_sec - n.start_sec) <= {WINDOW}),
 s AS (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY onset_score DESC, rise DESC, d, frame_index) AS rn FROM c WHERE onset_score >= {MIN_ONSET} AND rms >= {MIN_RMS} AND rise > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY onset_score DESC, d, frame_index) AS rn FROM c)
 SELECT k.recording_id, k.note_id, s.frame_index AS strong_frame, k.frame_index AS weak_frame FROM k LEFT JOIN s ON s.recording_id = k.recording_id AND s.note_id = k.note_id AND s.rn = 1 WHERE k.rn = 1""", "notes", "frames"))
def j9(t: Tables) -> DataFrame:
    best = AL.best_onsets(t.notes.select("recording_id", "note_id", F.col("start_sec").alias("anchor")), AL.neighbours(t.frames), WINDOW, MIN_ONSET, MIN_RMS)
    return best.select("recording_id", "note_id", F.col("strong.frame_index").alias("strong_frame"), F.col("weak.frame_index").alias("weak_frame"))


@query("j11_offset_search", sql(f""", r AS (SELECT *, rms - lag(rms, 1, 0.0) OVER (PARTITION BY recording_id ORDER BY frame_index) AS rise FROM frames),
 e AS (SELECT recording_id, start_sec AS t, onset_score + rise + rms AS w FROM r WHERE onset_score >= {MIN_ONSET} AND rms >= {MIN_RMS} AND rise > 0),
 mx AS (SELECT recording_id, max(w) AS mw FROM e GROUP BY 1), g AS (SELECT CAST(i AS INTEGER) AS i, CAST(-3.0 AS DOUBLE) + CAST(0.02 AS DOUBLE) * i AS off FROM range(301) x(i)),
 p AS (SELECT n.recording_id, g.i, n.note_id, n.start_sec + g.off AS at FROM notes n, g),
 nb AS (SELECT p.recording_id, p.i, p.note_id, arg_min(e.w, (abs(e.t - p.at), -e.t)) AS w, min(abs(e.t - p.at)) AS d FROM p JOIN e ON e.recording_id = p.recording_id AND abs(e.t - p.at) <= 0.08 GROUP BY ALL),
 sc AS (SELECT recording_id, i, sum(w / mw * (1 - d / 0.08)) AS s, count(*) AS m FROM nb JOIN mx USING (recording_id) GROUP BY ALL),
 cn AS (SELECT recording_id, count(*) AS n FROM notes GROUP BY 1),
 cf AS (SELECT cn.recording_id, g.i, g.off, 0.7 * coalesce(s, 0.0) / n + 0.3 * coalesce(m, 0) / n AS c FROM cn CROSS JOIN g JOIN mx USING (recording_id) LEFT JOIN sc USING (recording_id, i)),
 b AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(c, 9) DESC, i) AS rn FROM cf)
 SELECT recording_id, i AS step_no, round(off, 6) AS offset_sec, round(c, 6) AS confidence FROM b WHERE rn = 1""", "notes", "frames"))
def j11_search(t: Tables) -> DataFrame:
    """The whole grid: 301 offsets over 3 s either way."""
    best = AL.global_offset(t.notes, AL.onset_evidence(t.frames, MIN_ONSET, MIN_RMS))
    return best.select("recording_id", "step_no", F.round("offset_sec", 6).alias("offset_sec"), F.round("confidence", 6).alias("confidence"))


@query("p7_alignment_confidence", sql(EVIDENCE + ONSET + f""", a AS (SELECT n.recording_id, n.note_id, coalesce(onset_score, 0.0) AS o, mean_rms AS r, sustained AS s, ['ALIGNED', 'REVIEW_TIMING', 'KEEP_ORIGINAL_LOW_CONFIDENCE', 'NO_AUDIO_EVIDENCE'][CAST(pitch_midi % 4 AS INTEGER) + 1] AS action FROM notes n JOIN ev USING (recording_id, note_id) LEFT JOIN onset USING (recording_id, note_id)),
 z AS (SELECT *, least(1.0, o / {MIN_ONSET}) AS x, least(1.0, r / {MIN_RMS}) AS y FROM a)
 SELECT recording_id, note_id, action, round(CASE action WHEN 'ALIGNED' THEN 0.55 * x + 0.30 * y + 0.15 * s WHEN 'REVIEW_TIMING' THEN 0.30 * x + 0.30 * y + 0.20 * s WHEN 'KEEP_ORIGINAL_LOW_CONFIDENCE' THEN 0.20 * x + 0.20 * y + 0.20 * s ELSE 0.0 END, 6) AS confidence FROM z""", "notes", "frames"))
def p7(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("ALIGNED", "REVIEW_TIMING", "KEEP_ORIGINAL_LOW_CONFIDENCE", "NO_AUDIO_EVIDENCE")])
    n = _valid(t).withColumn("action", F.element_at(kinds, F.col("pitch_midi") % 4 + 1))
    return n.select("recording_id", "note_id", "action", F.round(E.alignment_confidence(F.col("action"), F.col("onset_score"), F.col("mean_rms"), F.col("sustained"), MIN_ONSET, MIN_RMS), 6).alias("confidence"))


@query("p8_safe_interval", sql(", d AS (SELECT *, start_sec - 0.4 AS s0, end_sec - 0.6 AS e0 FROM notes), x AS (SELECT *, least(greatest(0.0, s0), 39.9) AS s FROM d) SELECT recording_id, note_id, round(s, 6) AS start_sec, round(least(greatest(e0, s + 0.1), 40.0), 6) AS end_sec FROM x", "notes"))
def p8(t: Tables) -> DataFrame:
    s, e = E.safe_interval(F.col("start_sec") - 0.4, F.col("end_sec") - 0.6, F.lit(40.0), 10)
    return t.notes.select("recording_id", "note_id", F.round(s, 6).alias("start_sec"), F.round(e, 6).alias("end_sec"))


@query("p9_side_errors", sql(ONSET + " SELECT n.recording_id, n.note_id, round(greatest(0.0, (n.start_sec - nearest_onset_sec) * 1000), 3) AS before_ms, round(greatest(0.0, (nearest_onset_sec - n.start_sec) * 1000), 3) AS after_ms FROM notes n JOIN onset USING (recording_id, note_id)", "notes", "frames"))
def p9(t: Tables) -> DataFrame:
    b, a = E.side_errors(F.col("start_sec"), F.col("nearest_onset_sec"))
    n = t.notes.join(V.onset_top1(t.notes, t.frames, WINDOW), ["recording_id", "note_id"])
    return n.select("recording_id", "note_id", F.round(b, 3).alias("before_ms"), F.round(a, 3).alias("after_ms"))


@query("a5_a6_correction_percentiles", sql(ONSET + ", c AS (SELECT n.recording_id, abs(nearest_onset_sec - start_sec) * 1000 AS ms FROM notes n JOIN onset USING (recording_id, note_id)) SELECT recording_id, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(max(ms), 6) AS max_ms FROM c GROUP BY 1", "notes", "frames"))
def a5(t: Tables) -> DataFrame:
    v = t.notes.join(V.onset_top1(t.notes, t.frames, WINDOW), ["recording_id", "note_id"]).withColumn("ms", F.abs(F.col("nearest_onset_sec") - F.col("start_sec")) * 1000)
    return v.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("ms", 0.5), 6).alias("median_ms"), F.round(F.percentile("ms", 0.95), 6).alias("p95_ms"), F.round(F.max("ms"), 6).alias("max_ms"))


@query("j7_window_frames", sql(" SELECT n.recording_id, n.note_id, count(*) AS frames FROM notes n JOIN frames f ON f.recording_id = n.recording_id AND abs(f.start_sec - n.end_sec) <= 0.4 GROUP BY ALL", "notes", "frames"))
def j7(t: Tables) -> DataFrame:
    return W.band_counts(t.notes.select("recording_id", "note_id", F.col("end_sec").alias("start_sec")), t.frames, ["recording_id"], "note_id", 0.4).withColumnRenamed("n", "frames")


@query("m1_align_notes")
def m1(t: Tables) -> DataFrame:
    """Alignment of every note, after the global offset of its recording where that has the reference's least confidence."""
    p = AL.Parameters(onset_window=WINDOW, offset_window=WINDOW, min_onset=MIN_ONSET, min_rms=MIN_RMS, max_start_correction=0.4, max_end_correction=0.4, min_global_confidence=0.05)
    # A row for each recording, written once: align() reads it in several joins, each of which would search again.
    offsets = staged(AL.global_offset(t.notes, AL.onset_evidence(t.frames, MIN_ONSET, MIN_RMS)))
    a = AL.align(t.notes, t.frames, p, offsets)
    return a.select("recording_id", "note_id", "alignment_action", *[F.round(c, 6).alias(c) for c in ("aligned_start_sec", "aligned_end_sec", "alignment_confidence")])


@query("m4_refine_notes")
def m4(t: Tables) -> DataFrame:
    """Refined notes; tests hold the stages against scenarios and plain loops."""
    from staveforge.operators import refine as R

    p = R.Parameters(attack_lookback=0.6, max_attack_advance=0.6, merge_gap=0.3, max_merge_span=1.5, minimum_silence=0.3, tail_silence_hold=0.5, minimum_duration=0.2, gap_close=0.1, pitch_tolerance=12)
    v = _valid(t).select("recording_id", "note_id", "pitch_midi", "start_sec", "end_sec", "confidence")
    r = R.refine(v, t.frames, p)
    return r.select("recording_id", "note_id", F.round("start_sec", 9).alias("start_sec"), F.round("end_sec", 9).alias("end_sec"), F.size("merged").alias("merged"), F.array_join("actions", ",").alias("actions"))
