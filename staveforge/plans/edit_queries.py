"""Note-table editing, exports and QA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E
from staveforge.operators import edit as ED
from staveforge.operators.windows import overlap_stats
from staveforge.sources.adapters import Tables

from .note_queries import EVIDENCE, ONSET, VALID, _PLAN, _valid
from .registry import query, sql

REC = ["recording_id"]
SEL = "pitch_midi % 10 = 0"


@query("d1_d5_session_tracks", sql(" SELECT recording_id, track_index, CAST(dense_rank() OVER (PARTITION BY recording_id ORDER BY track_index) AS INTEGER) AS editable_track, count(*) AS notes, array_to_string(list_sort(list_distinct(list(layer))), ',') AS sources FROM notes GROUP BY recording_id, track_index", "notes"))
def d1(t: Tables) -> DataFrame:
    g = t.notes.groupBy(*REC, "track_index").agg(F.count(F.lit(1)).alias("notes"), F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("sources"))
    return g.withColumn("editable_track", F.dense_rank().over(Window.partitionBy(*REC).orderBy("track_index")))


@query("d2_lowest_free_track", sql(", u AS (SELECT DISTINCT recording_id, track_index FROM notes WHERE track_index <> 2), s AS (SELECT DISTINCT recording_id, CAST(i AS INTEGER) AS i FROM notes, range(12) r(i)) SELECT s.recording_id, min(i) AS free_track FROM s LEFT JOIN u ON u.recording_id = s.recording_id AND u.track_index = s.i WHERE u.track_index IS NULL GROUP BY 1", "notes"))
def d2(t: Tables) -> DataFrame:
    return ED.lowest_free_track(t.notes.where("track_index <> 2"), 12)


@query("d3_d4_move_merge_tracks", sql(f" SELECT recording_id, note_id, CASE WHEN {SEL} THEN 9 WHEN track_index IN (1, 3) THEN 1 ELSE track_index END AS track_index FROM notes", "notes"))
def d3(t: Tables) -> DataFrame:
    """Tracks 1 and 3 merge into the lower one, then the selection moves to track 9."""
    merged = ED.merge_tracks(t.notes, [1, 3])
    return ED.update(merged, F.expr(SEL), {"track_index": F.lit(9)}).select(*REC, "note_id", "track_index")


@query("d6_group_move", sql(f", s AS (SELECT recording_id, greatest(-5000, -min(start_tick)) AS dt, least(40, 127 - max(pitch_midi)) AS dp FROM notes WHERE {SEL} GROUP BY 1) SELECT n.recording_id, note_id, start_tick + CASE WHEN {SEL} THEN dt ELSE 0 END AS start_tick, end_tick + CASE WHEN {SEL} THEN dt ELSE 0 END AS end_tick, CAST(pitch_midi + CASE WHEN {SEL} THEN dp ELSE 0 END AS INTEGER) AS pitch_midi FROM notes n LEFT JOIN s USING (recording_id)", "notes"))
def d6(t: Tables) -> DataFrame:
    return ED.move_group(t.notes, F.expr(SEL), -5000, 40).select(*REC, "note_id", "start_tick", "end_tick", "pitch_midi")


@query("d7_resize_edge", sql(f" SELECT recording_id, note_id, greatest(CASE WHEN {SEL} THEN start_tick + 30 ELSE end_tick END, start_tick + 10) AS end_tick FROM notes", "notes"))
def d7(t: Tables) -> DataFrame:
    return ED.resize_right(t.notes, F.expr(SEL), F.col("start_tick") + 30, 10).select(*REC, "note_id", "end_tick")


@query("d8_draw_note", sql(" SELECT recording_id, note_id, start_tick, end_tick FROM notes UNION ALL SELECT DISTINCT recording_id, 'drawn_000001', 100, 500 FROM notes", "notes"))
def d8(t: Tables) -> DataFrame:
    return ED.draw(t.notes.select(*REC, "note_id", "start_tick", "end_tick"), 500, 100)


@query("d9_merge_all_notes", sql(" SELECT recording_id, track_index, channel, pitch_midi, arg_min(note_id, (start_tick, note_id)) || '_merged' AS note_id, min(start_tick) AS start_tick, max(end_tick) AS end_tick, count(*) AS merged FROM notes GROUP BY recording_id, track_index, channel, pitch_midi HAVING count(*) >= 2", "notes"))
def d9_all(t: Tables) -> DataFrame:
    """Every note."""
    return ED.merge_notes(t.notes, [*REC, "track_index", "channel", "pitch_midi"])


@query("d10_delete", sql(f" SELECT recording_id, note_id FROM notes WHERE NOT ({SEL})", "notes"))
def d10(t: Tables) -> DataFrame:
    return t.notes.join(t.notes.where(SEL).select("note_id"), "note_id", "left_anti").select(*REC, "note_id")


@query("d11_mute_toggle", sql(f", m AS (SELECT *, velocity < 40 AS muted FROM notes), a AS (SELECT recording_id, bool_and(muted) AS every FROM m WHERE {SEL} GROUP BY 1) SELECT recording_id, note_id, CASE WHEN {SEL} THEN NOT every ELSE muted END AS muted FROM m LEFT JOIN a USING (recording_id)", "notes"))
def d11(t: Tables) -> DataFrame:
    return ED.toggle_mute(t.notes.withColumn("muted", F.col("velocity") < 40), F.expr(SEL)).select(*REC, "note_id", "muted")


@query("u12_d13_upsert", sql(", p AS (SELECT recording_id, note_id, start_tick + 7 AS start_tick FROM notes WHERE pitch_midi < 20 UNION ALL SELECT DISTINCT recording_id, 'extra', 1 FROM notes) SELECT coalesce(p.recording_id, n.recording_id) AS recording_id, coalesce(p.note_id, n.note_id) AS note_id, coalesce(p.start_tick, n.start_tick) AS start_tick FROM notes n FULL JOIN p ON p.recording_id = n.recording_id AND p.note_id = n.note_id", "notes"))
def u12(t: Tables) -> DataFrame:
    n = t.notes.select(*REC, "note_id", "start_tick")
    p = n.where("true").join(t.notes.where("pitch_midi < 20").select(*REC, "note_id"), [*REC, "note_id"], "left_semi").withColumn("start_tick", F.col("start_tick") + 7)
    p = p.unionByName(n.select(*REC).distinct().select(*REC, F.lit("extra").alias("note_id"), F.lit(1).cast("long").alias("start_tick")))
    return ED.upsert(n, p, [*REC, "note_id"])


@query("d14_velocity_delta", sql(f" SELECT recording_id, note_id, CAST(least(127, greatest(1, velocity + CASE WHEN {SEL} THEN 50 ELSE 0 END)) AS INTEGER) AS velocity FROM notes", "notes"))
def d14(t: Tables) -> DataFrame:
    return ED.update(t.notes, F.expr(SEL), {"velocity": E.clip(F.col("velocity") + 50, 1, 127).cast("int")}).select(*REC, "note_id", "velocity")


@query("d15_d17_loop_recordings", sql(", s AS (SELECT recording_id, max(end_tick) - min(start_tick) AS len FROM notes GROUP BY 1) SELECT n.recording_id, note_id || '_c' || CAST(i AS VARCHAR) AS note_id, CAST(start_tick + i * greatest(len, 1) AS BIGINT) AS start_tick FROM notes n JOIN s USING (recording_id), range(1, 4) r(i)", "notes"))
def d15_all(t: Tables) -> DataFrame:
    """Whole recordings."""
    return ED.loop(t.notes, 3).select(*REC, "note_id", "start_tick")


@query("d18_snap", sql(" SELECT recording_id, note_id, CAST(floor(start_tick / 120.0 + 0.5) * 120 AS BIGINT) AS start_tick FROM notes", "notes"))
def d18(t: Tables) -> DataFrame:
    return t.notes.select(*REC, "note_id", E.snap(F.col("start_tick"), 480, 16).alias("start_tick"))


@query("d20_playback", sql(" SELECT recording_id, note_id, round((start_sec - 1.0) * 1000, 6) AS start_ms, round(greatest(30.0, (end_sec - start_sec) * 1000), 6) AS duration_ms FROM notes WHERE velocity >= 40 AND start_sec >= 1.0", "notes"))
def d20(t: Tables) -> DataFrame:
    n = t.notes.where("velocity >= 40 and start_sec >= 1.0")
    return n.select(*REC, "note_id", F.round((F.col("start_sec") - 1.0) * 1000, 6).alias("start_ms"), F.round(F.greatest(F.lit(30.0), (F.col("end_sec") - F.col("start_sec")) * 1000), 6).alias("duration_ms"))


@query("d21_velocity_groups", sql(" SELECT recording_id, start_tick // 960 AS beat, track_index, count(*) AS notes, min(velocity) AS low, max(velocity) AS high, array_to_string(list(note_id ORDER BY pitch_midi, note_id), ',') AS ids FROM notes GROUP BY recording_id, start_tick // 960, track_index HAVING count(*) >= 2", "notes"))
def d21(t: Tables) -> DataFrame:
    g = t.notes.withColumn("beat", F.floor(F.col("start_tick") / 960)).groupBy(*REC, "beat", "track_index")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pitch_midi", "note_id"))), lambda x: x["note_id"]), ",")
    return g.agg(F.count(F.lit(1)).alias("notes"), F.min("velocity").alias("low"), F.max("velocity").alias("high"), ids.alias("ids")).where("notes >= 2")


@query("d22_rectangle", sql(" SELECT recording_id, note_id FROM notes WHERE end_tick > 10000 AND start_tick < 20000 AND pitch_midi BETWEEN 30 AND 60", "notes"))
def d22(t: Tables) -> DataFrame:
    return t.notes.where("end_tick > 10000 and start_tick < 20000 and pitch_midi between 30 and 60").select(*REC, "note_id")


@query("a32_recording_velocity", sql(" SELECT recording_id, count(*) AS notes, min(velocity) AS low, CAST(round_even(avg(velocity), 0) AS INTEGER) AS mean, max(velocity) AS high FROM notes GROUP BY 1", "notes"))
def a32_all(t: Tables) -> DataFrame:
    """Every note."""
    return t.notes.groupBy(*REC).agg(F.count(F.lit(1)).alias("notes"), F.min("velocity").alias("low"), F.rint(F.avg("velocity")).cast("int").alias("mean"), F.max("velocity").alias("high"))


@query("w43_bar_beat", sql(" SELECT recording_id, note_id, CASE WHEN start_tick < 19200 THEN start_tick // 1920 + 1 ELSE 10 + (start_tick - 19200) // 1440 + 1 END AS bar, CASE WHEN start_tick < 19200 THEN start_tick % 1920 // 480 + 1 ELSE (start_tick - 19200) % 1440 // 480 + 1 END AS beat FROM notes", "notes"))
def w43(t: Tables) -> DataFrame:
    sig = t.spark.createDataFrame([(0, 4, 4), (19200, 3, 4)], "tick long, numerator int, denominator int")
    return ED.bar_beat(t.notes.select(*REC, "note_id", "start_tick"), sig, 480).select(*REC, "note_id", "bar", "beat")


@query("p34_local_thresholds", sql(" SELECT recording_id, round(least(0.15, greatest(0.10, 0.45 * median(end_sec - start_sec))), 9) AS min_duration, round(greatest(35.0, 0.45 * median(velocity)), 9) AS min_velocity FROM notes GROUP BY 1", "notes"))
def p34(t: Tables) -> DataFrame:
    d = F.median(F.col("end_sec") - F.col("start_sec"))
    return t.notes.groupBy(*REC).agg(F.round(E.clip(0.45 * d, 0.10, 0.15), 9).alias("min_duration"), F.round(F.greatest(F.lit(35.0), 0.45 * F.median("velocity")), 9).alias("min_velocity"))


@query("j23_collision", sql(", a AS (SELECT * FROM notes WHERE pitch_midi % 2 = 0), b AS (SELECT recording_id, note_id, start_sec, end_sec, pitch_midi - pitch_midi % 2 AS p FROM notes WHERE pitch_midi % 2 = 1), c AS (SELECT a.recording_id, a.note_id, CASE WHEN a.pitch_midi = b.p AND abs(a.start_sec - b.start_sec) <= 0.02 THEN 'duplicate' WHEN (least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)) / least(a.end_sec - a.start_sec, b.end_sec - b.start_sec) >= 0.65 THEN 'collision' END AS r, row_number() OVER (PARTITION BY a.recording_id, a.note_id ORDER BY b.start_sec, b.note_id) AS rn FROM a JOIN b ON a.recording_id = b.recording_id AND b.end_sec > a.start_sec AND b.start_sec < a.end_sec), f AS (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY rn) AS k FROM c WHERE r IS NOT NULL) SELECT recording_id, note_id, r AS reason FROM f WHERE k = 1", "notes"))
def j23(t: Tables) -> DataFrame:
    """Even pitches against odd ones: the first base note that a proposal repeats or covers."""
    a = t.notes.where("pitch_midi % 2 = 0").select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec")
    b = t.notes.where("pitch_midi % 2 = 1").select(*REC, "note_id", "start_sec", "end_sec", (F.col("pitch_midi") - 1).alias("pitch_midi"))
    return ED.first_clash(a, b)


_PRI = "CASE a WHEN 'KEEP' THEN 4 WHEN 'REVIEW' THEN 3 WHEN 'MUTE' THEN 2 ELSE 1 END"


@query("j21_merged_action", sql(EVIDENCE + ONSET + VALID + f", pl AS (SELECT *, {_PLAN} AS a FROM valid), g AS (SELECT recording_id, pitch_midi, max({_PRI}) AS p FROM pl GROUP BY ALL) SELECT recording_id, pitch_midi, CASE p WHEN 4 THEN 'KEEP' WHEN 3 THEN 'REVIEW' WHEN 2 THEN 'MUTE' ELSE 'DELETE_CANDIDATE' END AS action FROM g", "notes", "frames"))
def j21(t: Tables) -> DataFrame:
    """The action of a merged note is the highest of its members' (here: the notes of one pitch)."""
    from staveforge.operators import validate as V

    p = V.plan(_valid(t), allow_delete=True)
    return p.groupBy(*REC, "pitch_midi").agg(ED.strongest(F.col("plan_action")).alias("action"))


@query("a30_qa_summary", sql(EVIDENCE + ONSET + VALID + f", pl AS (SELECT *, {_PLAN} AS a FROM valid) SELECT recording_id, count(*) AS notes, count(*) FILTER (a = 'KEEP') AS keep, count(*) FILTER (a = 'REVIEW') AS review, count(*) FILTER (a = 'MUTE') AS mute, count(*) FILTER (a = 'DELETE_CANDIDATE') AS del, count(*) FILTER (onset_score < 0.05) AS weak_onset, count(*) FILTER (mean_rms < 0.3) AS low_rms FROM pl GROUP BY 1", "notes", "frames"))
def a30(t: Tables) -> DataFrame:
    from staveforge.operators import validate as V

    a = F.col("plan_action")
    return V.plan(_valid(t), allow_delete=True).groupBy(*REC).agg(F.count(F.lit(1)).alias("notes"), F.count_if(a == "KEEP").alias("keep"), F.count_if(a == "REVIEW").alias("review"), F.count_if(a == "MUTE").alias("mute"), F.count_if(a == "DELETE_CANDIDATE").alias("del"), F.count_if(F.col("onset_score") < 0.05).alias("weak_onset"), F.count_if(F.col("mean_rms") < 0.3).alias("low_rms"))


@query("a31_upper_percentiles", sql(", l AS (SELECT recording_id, list_sort(list(end_sec - start_sec)) AS x FROM notes GROUP BY 1) SELECT recording_id, round(x[len(x) // 2 + 1], 9) AS upper_median, round(x[CAST(floor((len(x) - 1) * 0.95) AS BIGINT) + 1], 9) AS p95 FROM l", "notes"))
def a31(t: Tables) -> DataFrame:
    """The upper median, and the 95th percentile at a truncated index, by ranks."""
    w = Window.partitionBy(*REC)
    x = t.notes.select(*REC, (F.col("end_sec") - F.col("start_sec")).alias("d"))
    r = x.withColumns({"r": F.row_number().over(w.orderBy("d")), "n": F.count(F.lit(1)).over(w)})
    return r.groupBy(*REC).agg(F.round(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("d"))), 9).alias("upper_median"), F.round(F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * 0.95) + 1, F.col("d"))), 9).alias("p95"))


@query("t12_qa_lowest", sql(EVIDENCE + ONSET + VALID + ", r AS (SELECT *, row_number() OVER (ORDER BY round(confidence, 9), note_id) AS rk FROM valid) SELECT CAST(rk AS INTEGER) AS rank_no, note_id, round(confidence, 6) AS confidence FROM r WHERE rk <= 25", "notes", "frames"))
def t12(t: Tables) -> DataFrame:
    """The 25 notes of the lowest confidence: a top-k report."""
    top = _valid(t).select("note_id", F.round("confidence", 9).alias("c")).orderBy("c", "note_id").limit(25)
    return top.select(F.row_number().over(Window.orderBy("c", "note_id")).alias("rank_no"), "note_id", F.round("c", 6).alias("confidence"))


@query("t6_action_cap", sql(f", c AS (SELECT *, CASE WHEN {SEL} THEN abs(velocity - 64) ELSE 0 END AS m FROM notes), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY m DESC, note_id) AS rk FROM c) SELECT recording_id, note_id, CAST(CASE WHEN m > 0 AND rk <= 5 THEN 64 ELSE velocity END AS INTEGER) AS velocity FROM r", "notes"))
def t6(t: Tables) -> DataFrame:
    """Only the five largest changes of a recording stay; the others are reverted."""
    new = ED.update(t.notes, F.expr(SEL), {"velocity": F.lit(64)})
    return ED.cap_changes(t.notes, new, [*REC, "note_id"], "velocity", REC, 5).select(*REC, "note_id", "velocity")


@query("t9_t11_downsample", sql(", r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, note_id) - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM notes) SELECT recording_id, note_id FROM r WHERE i % CAST(ceil(n / 50.0) AS BIGINT) = 0", "notes"))
def t9(t: Tables) -> DataFrame:
    """A stride that leaves at most 50 notes of a recording: a sampling operator."""
    w = Window.partitionBy(*REC)
    r = t.notes.withColumns({"i": F.row_number().over(w.orderBy("start_sec", "note_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    return r.where(F.col("i") % F.ceil(F.col("n") / 50) == 0).select(*REC, "note_id")


@query("j13_unknown_ids", sql(" SELECT recording_id, note_id FROM notes WHERE layer = 'view' AND NOT EXISTS (SELECT 1 FROM notes m WHERE m.layer <> 'view' AND m.recording_id = notes.recording_id AND m.pitch_midi = notes.pitch_midi)", "notes"))
def j13(t: Tables) -> DataFrame:
    known = t.notes.where("layer <> 'view'").select(*REC, "pitch_midi")
    return t.notes.where("layer = 'view'").join(known, [*REC, "pitch_midi"], "left_anti").select(*REC, "note_id")


@query("j30_activity_ratio", sql(" SELECT n.recording_id, n.note_id, round(avg(CASE WHEN coalesce(CASE WHEN f.k % 9 = 0 THEN NULL ELSE f.is_silent END, false) THEN 0.0 ELSE 1.0 END), 9) AS active_ratio FROM notes n JOIN frames f ON f.recording_id = n.recording_id AND f.end_sec > n.start_sec AND f.start_sec < n.end_sec GROUP BY ALL", "notes", "frames"))
def j30(t: Tables) -> DataFrame:
    """A frame whose silence flag is missing counts as active."""
    silent = F.when(F.col("k") % 9 == 0, F.lit(None)).otherwise(F.col("is_silent"))
    f = t.frames.select(*REC, "start_sec", "end_sec", F.when(F.coalesce(silent, F.lit(False)), 0.0).otherwise(1.0).alias("active"))
    return overlap_stats(t.notes, f, REC, "note_id", ["active"]).select(*REC, "note_id", F.round("avg_active", 9).alias("active_ratio"))
