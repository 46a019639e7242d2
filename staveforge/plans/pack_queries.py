"""Completion-pack queries (A24, A25, A27, A29, J25, J29, W38, W39, T8, T13, X55, X56) and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E
from staveforge.operators import pack as K
from staveforge.operators import regions as R
from staveforge.operators.timejoin import interval_join
from staveforge.sources.adapters import Tables

from .registry import query, sql

REC = ["recording_id"]
_LEN = ", ln AS (SELECT recording_id, max(end_sec) AS dur FROM frames GROUP BY 1)"


def _sections_sql(least: float, parts: int) -> str:
    return _LEN + f""", sz AS (SELECT recording_id, dur, greatest({least}, dur / {parts}) AS z FROM ln), se AS (SELECT recording_id, dur, z, CAST(unnest(range(0, greatest(1, CAST(ceil(round(dur / z, 9)) AS INTEGER)))) AS INTEGER) AS section FROM sz),
 sections AS (SELECT recording_id, section, section * z AS start_sec, least(dur, (section + 1) * z) AS end_sec FROM se)"""


def _lengths(t: Tables) -> DataFrame:
    return t.frames.groupBy(*REC).agg(F.max("end_sec").alias("duration_sec"))


@query("a24_density_by_section", sql(_sections_sql(2.0, 8) + " SELECT s.recording_id, section, round(s.start_sec, 6) AS start_sec, round(s.end_sec, 6) AS end_sec, count(n.note_id) AS note_count, round(count(n.note_id) / greatest(1e-6, s.end_sec - s.start_sec), 6) AS notes_per_sec FROM sections s LEFT JOIN notes n ON n.recording_id = s.recording_id AND n.end_sec > s.start_sec AND n.start_sec < s.end_sec GROUP BY s.recording_id, section, s.start_sec, s.end_sec", "frames", "notes"))
def a24(t: Tables) -> DataFrame:
    s = K.sections(_lengths(t), 2.0, 8)
    c = interval_join(s, t.notes.select(*REC, "start_sec", "end_sec"), REC, 4.0).groupBy(*REC, "section").agg(F.count(F.lit(1)).alias("c"))
    n = F.coalesce("c", F.lit(0))
    return s.join(c, [*REC, "section"], "left").select(*REC, "section", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), n.alias("note_count"), F.round(n / F.greatest(F.lit(1e-6), F.col("end_sec") - F.col("start_sec")), 6).alias("notes_per_sec"))


@query("a24_base_summary", sql(", c AS (SELECT recording_id, pitch_midi, count(*) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY count(*) DESC, min(start_sec), pitch_midi) AS k FROM notes GROUP BY 1, 2), p AS (SELECT recording_id, string_agg(pitch_midi || ':' || n, ',' ORDER BY k) AS common FROM c WHERE k <= 8 GROUP BY 1) SELECT recording_id, count(*) AS note_count, min(pitch_midi) AS low, max(pitch_midi) AS high, round(median(end_sec - start_sec), 6) AS median_duration, any_value(common) AS common FROM notes JOIN p USING (recording_id) GROUP BY 1", "notes"))
def a24b(t: Tables) -> DataFrame:
    c = t.notes.groupBy(*REC, "pitch_midi").agg(F.count(F.lit(1)).alias("n"), F.min("start_sec").alias("s"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy(*REC).orderBy(F.col("n").desc(), "s", "pitch_midi"))).where("k <= 8")
    p = c.groupBy(*REC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "pitch_midi", "n"))), lambda x: F.concat(x["pitch_midi"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("common"))
    g = t.notes.groupBy(*REC).agg(F.count(F.lit(1)).alias("note_count"), F.min("pitch_midi").alias("low"), F.max("pitch_midi").alias("high"), F.round(F.median(F.col("end_sec") - F.col("start_sec")), 6).alias("median_duration"))
    return g.join(p, REC)


_RUNS = """, lv AS (SELECT recording_id, greatest(1e-6, sqrt(avg(rms * rms)) * 0.6) AS lv FROM frames GROUP BY 1), ao AS (SELECT f.*, rms >= lv OR onset_score >= 0.25 AS act FROM frames f JOIN lv USING (recording_id)),
 ar AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_index) - row_number() OVER (PARTITION BY recording_id, act ORDER BY frame_index) AS run FROM ao),
 runs AS (SELECT recording_id, min(start_sec) AS start_sec, max_by(end_sec, frame_index) AS end_sec, avg(rms) AS rms_mean, max(rms) AS rms_peak, count(*) FILTER (onset_score >= 0.25) AS onset_count FROM ar WHERE act GROUP BY recording_id, run)"""


def _runs(t: Tables) -> DataFrame:
    return K.active_runs(t.frames, 0.6, 0.25)


@query("a25_region_summary", sql(_RUNS + """, pj AS (SELECT r.recording_id, r.start_sec, p.frame_index, p.voiced, p.confidence, CAST(round_even(69 + 12 * log2(p.f0_hz / 440), 0) AS INTEGER) AS pm FROM runs r JOIN pitch_frames p ON p.recording_id = r.recording_id AND p.end_sec > r.start_sec AND p.start_sec < r.end_sec),
 sr AS (SELECT recording_id, start_sec, avg(confidence) AS pc FROM pj GROUP BY 1, 2), tp AS (SELECT recording_id, start_sec, pm, row_number() OVER (PARTITION BY recording_id, start_sec ORDER BY count(*) DESC, min(frame_index)) AS k FROM pj WHERE voiced GROUP BY 1, 2, 3)
 SELECT r.recording_id, round(r.start_sec, 6) AS start_sec, round(r.end_sec, 6) AS end_sec, round(rms_mean, 8) AS rms_mean, round(rms_peak, 8) AS rms_peak, onset_count, pm AS dominant_pitch, round(pc, 6) AS pitch_confidence FROM runs r LEFT JOIN sr ON sr.recording_id = r.recording_id AND sr.start_sec = r.start_sec LEFT JOIN tp ON tp.recording_id = r.recording_id AND tp.start_sec = r.start_sec AND k = 1""", "frames", "pitch_frames"))
def a25(t: Tables) -> DataFrame:
    r = K.run_pitch(_runs(t), t.pitch_frames, 1.0)
    return r.select(*REC, F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), F.round("rms_mean", 8).alias("rms_mean"), F.round("rms_peak", 8).alias("rms_peak"), "onset_count", "dominant_pitch", F.round("pitch_confidence", 6).alias("pitch_confidence"))


@query("a27_pattern_windows", sql(_sections_sql(2.0, 12) + """, j AS (SELECT s.recording_id, section, CAST(round_even(n.start_sec * 1000000, 0) AS BIGINT) AS us, row_number() OVER (PARTITION BY s.recording_id, section ORDER BY n.start_sec, n.note_id) AS k FROM sections s JOIN notes n ON n.recording_id = s.recording_id AND n.end_sec > s.start_sec AND n.start_sec < s.end_sec),
 d AS (SELECT *, us - lag(us) OVER (PARTITION BY recording_id, section ORDER BY k) AS gap FROM j) SELECT recording_id, section, max(k) AS notes, count(*) FILTER (k <= 64) AS onsets, CAST(sum(gap) FILTER (k <= 64) AS BIGINT) / CAST(1000000 AS DOUBLE) AS spread, max(gap) FILTER (k <= 64) / CAST(1000000 AS DOUBLE) AS longest FROM d GROUP BY 1, 2""", "frames", "notes"))
def a27(t: Tables) -> DataFrame:
    """Windows of a twelfth: their notes, and of the first 64 onsets how many, and the sum and longest of intervals, taken in whole microseconds."""
    s = K.sections(_lengths(t), 2.0, 12)
    w = Window.partitionBy(*REC, "section").orderBy("r_start_sec", "r_note_id")
    j = interval_join(s, t.notes.select(*REC, "note_id", "start_sec", "end_sec"), REC, 4.0)
    j = j.withColumns({"k": F.row_number().over(w), "us": F.rint(F.col("r_start_sec") * 1000000).cast("long")})
    j = j.withColumns({"gap": F.col("us") - F.lag("us").over(w)})
    gap = F.when(F.col("k") <= 64, F.col("gap"))
    return j.groupBy(*REC, "section").agg(F.max("k").cast("long").alias("notes"), F.count_if(F.col("k") <= 64).alias("onsets"), (F.sum(gap) / F.lit(1e6)).alias("spread"), (F.max(gap) / F.lit(1e6)).alias("longest"))


@query("a28_a29_key_estimate", sql(_sections_sql(2.0, 8) + """, nn AS (SELECT s.recording_id, section, n.note_id, n.start_sec, CAST(n.pitch_midi % 12 AS INTEGER) AS pc FROM sections s JOIN notes n ON n.recording_id = s.recording_id AND n.end_sec > s.start_sec AND n.start_sec < s.end_sec),
 c AS (SELECT recording_id, section, pc, count(*) AS c, min(start_sec) AS f FROM nn GROUP BY 1, 2, 3), g AS (SELECT recording_id, section, CAST(sum(c) AS BIGINT) AS n, arg_min(pc, (-c, f, pc)) AS root, list(pc) AS pcs FROM c GROUP BY 1, 2),
 h AS (SELECT *, len(list_filter(pcs, lambda x: list_contains([0, 2, 4, 5, 7, 9, 11], (x - root + 12) % 12))) AS ma, len(list_filter(pcs, lambda x: list_contains([0, 2, 3, 5, 7, 8, 10], (x - root + 12) % 12))) AS mi FROM g)
 SELECT recording_id, section, CASE WHEN n < 3 THEN 'unknown' ELSE list_extract(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], root + 1) || CASE WHEN mi > ma THEN ' minor (estimated)' WHEN ma > mi THEN ' major (estimated)' ELSE ' modal (estimated)' END END AS key_name FROM h""", "frames", "notes"))
def a29(t: Tables) -> DataFrame:
    j = interval_join(K.sections(_lengths(t), 2.0, 8), t.notes.select(*REC, "note_id", "start_sec", "end_sec", "pitch_midi"), REC, 4.0)
    return K.key_estimate(j.select(*REC, "section", F.col("r_note_id").alias("note_id"), F.col("r_start_sec").alias("start_sec"), F.col("r_pitch_midi").alias("pitch_midi")), [*REC, "section"])


_TONES = """, tj AS (SELECT s.recording_id, s.section, s.start_sec, s.end_sec, p.frame_index, p.voiced, p.confidence, CAST(round_even(69 + 12 * log2(p.f0_hz / 440), 0) AS INTEGER) AS pm FROM sections s JOIN pitch_frames p ON p.recording_id = s.recording_id AND p.end_sec > s.start_sec AND p.start_sec < s.end_sec),
 tc AS (SELECT recording_id, section, pm, row_number() OVER (PARTITION BY recording_id, section ORDER BY count(*) DESC, min(frame_index)) AS k FROM tj WHERE voiced GROUP BY 1, 2, 3),
 tm AS (SELECT recording_id, section, start_sec, end_sec, avg(confidence) AS mean_confidence, avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END) AS voiced_ratio FROM tj GROUP BY 1, 2, 3, 4), tones AS (SELECT tm.*, pm AS dominant_pitch FROM tm LEFT JOIN tc ON tc.recording_id = tm.recording_id AND tc.section = tm.section AND k = 1)"""


def _tones(t: Tables) -> DataFrame:
    f = t.pitch_frames.select(*REC, "start_sec", "end_sec", "frame_index", "voiced", F.col("confidence").alias("sure"), F.rint(E.hz_to_midi(F.col("f0_hz"))).cast("int").alias("pm"))
    j = interval_join(K.sections(_lengths(t), 1.0, 60), f, REC, 2.0)
    m = j.groupBy(*REC, "section", "start_sec", "end_sec").agg(F.avg("r_sure").alias("mean_confidence"), F.avg(F.col("r_voiced").cast("double")).alias("voiced_ratio"))
    c = j.where("r_voiced").groupBy(*REC, "section", "r_pm").agg(F.count(F.lit(1)).alias("c"), F.min("r_frame_index").alias("f"))
    top = c.groupBy(*REC, "section").agg(F.min(F.struct((-F.col("c")).alias("c"), "f", F.col("r_pm").alias("p"))).alias("b")).select(*REC, "section", F.col("b.p").alias("dominant_pitch"))
    return m.join(top, [*REC, "section"], "left")


@query("w39_pitch_changes", sql(_sections_sql(1.0, 60) + _TONES + """, d AS (SELECT recording_id, start_sec, round(coalesce(CAST(abs(dominant_pitch - lag(dominant_pitch) OVER w) AS DOUBLE), 0.0) + 2 * abs(mean_confidence - lag(mean_confidence) OVER w), 9) AS change FROM tones WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec)),
 k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY change DESC, start_sec) AS k FROM d WHERE change >= 0.75) SELECT recording_id, round(start_sec, 6) AS start_sec, change FROM k WHERE k <= 12""", "frames", "pitch_frames"))
def w39(t: Tables) -> DataFrame:
    return K.pitch_changes(_tones(t), 12).withColumn("start_sec", F.round("start_sec", 6))


_GAPS = """, ge AS (SELECT *, max(end_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM notes), gaps AS (SELECT recording_id, e AS start_sec, start_sec AS end_sec FROM ge WHERE round(start_sec - e, 9) >= 0.75),
 gr AS (SELECT g.recording_id, g.start_sec, sum(least(g.end_sec, r.end_sec) - greatest(g.start_sec, r.start_sec)) AS o, sum(r.onset_count) AS n, min(greatest(g.start_sec, r.start_sec)) AS a, max(least(g.end_sec, r.end_sec)) AS b FROM gaps g JOIN runs r ON r.recording_id = g.recording_id AND r.end_sec > g.start_sec AND r.start_sec < g.end_sec GROUP BY 1, 2),
 gt AS (SELECT g.recording_id, g.start_sec, count(*) AS h FROM gaps g JOIN tones s ON s.recording_id = g.recording_id AND s.end_sec > g.start_sec AND s.start_sec < g.end_sec AND dominant_pitch IS NOT NULL AND voiced_ratio >= 0.2 GROUP BY 1, 2),
 gv AS (SELECT g.recording_id, g.start_sec, g.end_sec, round(coalesce(o, 0.0) / greatest(1e-6, g.end_sec - g.start_sec), 9) AS active_ratio, CAST(coalesce(n, 0) AS BIGINT) AS onset_count, coalesce(h, 0) AS pitch_hits, coalesce(a, g.start_sec) AS active_start, coalesce(b, g.end_sec) AS active_end FROM gaps g LEFT JOIN gr ON gr.recording_id = g.recording_id AND gr.start_sec = g.start_sec LEFT JOIN gt ON gt.recording_id = g.recording_id AND gt.start_sec = g.start_sec),
 ev AS (SELECT *, active_ratio >= 0.18 OR onset_count >= 1 OR pitch_hits >= 2 AS has_evidence, CASE WHEN active_ratio >= 0.4 AND onset_count >= 1 THEN 'long_gap_with_strong_audio_activity' WHEN onset_count >= 1 THEN 'long_gap_with_onset_evidence' WHEN pitch_hits >= 2 THEN 'long_gap_with_pitch_contour_evidence' ELSE 'long_gap_with_activity_evidence' END AS reason FROM gv)"""


def _evidence(t: Tables) -> DataFrame:
    return K.gap_evidence(K.gaps(t.notes, 0.75), _runs(t), _tones(t), 4.0)


@query("j25_gap_evidence", sql(_sections_sql(1.0, 60) + _TONES + _RUNS + _GAPS + " SELECT recording_id, round(start_sec, 6) AS start_sec, active_ratio, onset_count, pitch_hits, round(active_start, 6) AS active_start, round(active_end, 6) AS active_end, has_evidence, reason FROM ev", "frames", "notes", "pitch_frames"))
def j25(t: Tables) -> DataFrame:
    return _evidence(t).select(*REC, *[F.round(c, 6).alias(c) for c in ("start_sec", "active_start", "active_end")], "active_ratio", "onset_count", "pitch_hits", "has_evidence", "reason")


@query("w38_merge_candidates", sql(_sections_sql(1.0, 60) + _TONES + _RUNS + _GAPS + """, fa AS (SELECT *, CASE WHEN round(active_start - max(active_end) OVER (PARTITION BY recording_id ORDER BY active_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) > 0.5 THEN 1 ELSE 0 END AS nw FROM ev WHERE has_evidence), gn AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY active_start) AS g FROM fa)
 SELECT recording_id, round(min(active_start), 6) AS start_sec, round(max(active_end), 6) AS end_sec, CAST(sum(onset_count) AS BIGINT) AS onset_count, coalesce(arg_min(reason, active_start) FILTER (reason LIKE '%strong%'), arg_min(reason, active_start)) AS reason FROM gn GROUP BY recording_id, g""", "frames", "notes", "pitch_frames"))
def w38(t: Tables) -> DataFrame:
    c = _evidence(t).where("has_evidence").select(*REC, F.col("active_start").alias("start_sec"), F.col("active_end").alias("end_sec"), "onset_count", "reason")
    return K.merge_candidates(c, 0.5).withColumns({"start_sec": F.round("start_sec", 6), "end_sec": F.round("end_sec", 6)})


@query("m18_completion_regions")
def m18(t: Tables) -> DataFrame:
    """Regions that a completion may write, with their context; lists as text."""
    r = R.completion_regions(t.notes, _runs(t), _tones(t), _lengths(t))
    lists = [c for c, kind in r.dtypes if kind.startswith("array")]
    times = [c for c, kind in r.dtypes if kind == "double"]
    return r.withColumns({**{c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists}, **{c: F.round(c, 6) for c in times}})


@query("t8_select_regions", sql(_RUNS + """, rn AS (SELECT r.*, (SELECT count(*) FROM notes n WHERE n.recording_id = r.recording_id AND n.end_sec > r.start_sec AND n.start_sec < r.end_sec) AS notes FROM runs r),
 rk AS (SELECT *, row_number() OVER (p ORDER BY rms_peak DESC, start_sec) AS a, row_number() OVER (p ORDER BY onset_count DESC, rms_peak DESC, start_sec) AS b, row_number() OVER (p ORDER BY notes, rms_peak DESC, start_sec) AS c, row_number() OVER (p ORDER BY round(rms_peak * 1.5 + onset_count, 9) DESC, notes, start_sec) AS d, count(*) OVER p AS n FROM rn WINDOW p AS (PARTITION BY recording_id)),
 u AS (SELECT *, CASE WHEN least(a, b, c) <= 8 THEN 1 ELSE 0 END AS i FROM rk), v AS (SELECT *, sum(i) OVER (PARTITION BY recording_id) AS su, row_number() OVER (PARTITION BY recording_id ORDER BY i, d) AS f FROM u), x AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec) AS t FROM v WHERE n <= 20 OR i = 1 OR (i = 0 AND f <= 20 - su))
 SELECT recording_id, round(start_sec, 6) AS start_sec, notes FROM x WHERE t <= 20 OR n <= 20""", "frames", "notes"))
def t8(t: Tables) -> DataFrame:
    return K.select_runs(_runs(t), t.notes, 20, 4.0).select(*REC, F.round("start_sec", 6).alias("start_sec"), "notes")


@query("t13_x55_context_notes", sql(_GAPS.split(", gr AS")[0] + ", c AS (SELECT g.recording_id, g.start_sec, n.note_id, row_number() OVER (PARTITION BY g.recording_id, g.start_sec ORDER BY round(least(abs(n.start_sec - g.start_sec), abs(n.end_sec - g.end_sec)), 9), n.start_sec, n.note_id) AS k FROM gaps g JOIN notes n ON n.recording_id = g.recording_id AND (abs(n.start_sec - g.start_sec) <= 3 OR abs(n.end_sec - g.end_sec) <= 3)) SELECT recording_id, round(start_sec, 6) AS start_sec, note_id, k AS rank_no FROM c WHERE k <= 8", "notes"))
def t13(t: Tables) -> DataFrame:
    """The eight notes nearest to each gap, by start to its start or end to its end, within three seconds."""
    g = K.gaps(t.notes, 0.75)
    reach = g.select(*REC, F.col("start_sec").alias("gs"), F.col("end_sec").alias("ge"), (F.col("start_sec") - 3).alias("start_sec"), (F.col("end_sec") + 3).alias("end_sec"))
    j = interval_join(reach, t.notes.select(*REC, "note_id", "start_sec", "end_sec"), REC, 8.0, closed=True)
    a, b = F.abs(F.col("r_start_sec") - F.col("gs")), F.abs(F.col("r_end_sec") - F.col("ge"))
    k = F.row_number().over(Window.partitionBy(*REC, "gs").orderBy(F.round(F.least(a, b), 9), "r_start_sec", "r_note_id"))
    return j.where((a <= 3) | (b <= 3)).withColumn("rank_no", k.cast("long")).where("rank_no <= 8").select(*REC, F.round("gs", 6).alias("start_sec"), F.col("r_note_id").alias("note_id"), "rank_no")


@query("x56_rhythm_intervals", sql(_sections_sql(2.0, 8) + ", j AS (SELECT s.recording_id, section, n.start_sec, n.start_sec - lag(n.start_sec) OVER (PARTITION BY s.recording_id, section ORDER BY n.start_sec, n.end_sec, n.note_id) AS d, n.end_sec, n.note_id FROM sections s JOIN notes n ON n.recording_id = s.recording_id AND n.end_sec > s.start_sec AND n.start_sec < s.end_sec), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, section ORDER BY start_sec, end_sec, note_id) AS k FROM j WHERE d > 0) SELECT recording_id, section, k AS place, round(d, 6) AS interval_sec FROM r WHERE k <= 24", "frames", "notes"))
def x56(t: Tables) -> DataFrame:
    w = Window.partitionBy(*REC, "section").orderBy("r_start_sec", "r_end_sec", "r_note_id")
    j = interval_join(K.sections(_lengths(t), 2.0, 8), t.notes.select(*REC, "note_id", "start_sec", "end_sec"), REC, 4.0)
    j = j.withColumn("d", F.col("r_start_sec") - F.lag("r_start_sec").over(w)).where("d > 0").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 24")
    return j.select(*REC, "section", "place", F.round("d", 6).alias("interval_sec"))


@query("j29_notes_in_region", sql(_RUNS + " SELECT r.recording_id, round(r.start_sec, 6) AS region_start, n.note_id FROM runs r JOIN notes n ON n.recording_id = r.recording_id AND n.start_sec < r.end_sec AND n.end_sec > r.start_sec", "frames", "notes"))
def j29(t: Tables) -> DataFrame:
    return interval_join(_runs(t), t.notes.select(*REC, "note_id", "start_sec", "end_sec"), REC, 0.5).select(*REC, F.round("start_sec", 6).alias("region_start"), F.col("r_note_id").alias("note_id"))


@query("f32_f33_f34_text", "SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(source || ' / <' || coalesce(lang, '') || '> & \"x\"', '&', '&amp;', 'g'), '<', '&lt;', 'g'), '>', '&gt;', 'g'), 1) AS html, '\"' || replace(source || ' \"' || coalesce(lang, ''), '\"', '\"\"') || '\"' AS csv, regexp_replace(source || ' /a:' || coalesce(lang, ''), '[^A-Za-z0-9._-]+', '_', 'g') AS file_name, round(n_chars / 7.0, 3) AS short FROM documents")
def f32(t: Tables) -> DataFrame:
    """Escapes for HTML and CSV, a safe file name, and a rounded number."""
    lang = F.coalesce("lang", F.lit(""))
    return t.read("documents").select(
        "doc_id", E.html_escape(F.concat("source", F.lit(" / <"), lang, F.lit('> & "x"'))).alias("html"), E.csv_field(F.concat("source", F.lit(' "'), lang)).alias("csv"),
        E.safe_file_name(F.concat("source", F.lit(" /a:"), lang)).alias("file_name"), F.round(F.col("n_chars") / 7.0, 3).alias("short"),
    )
