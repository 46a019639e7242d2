"""Frame analytics, islands and pitch (A1, A2, A7-A12, W1-W6, W12, W18-W23, P10-P12, J14-J20, X*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E
from staveforge.operators import frames as FR
from staveforge.operators import islands as IS
from staveforge.operators import repair as RP
from staveforge.operators import windows as W
from staveforge.operators.timejoin import asof_join, interval_join
from staveforge.sources.adapters import Tables

from .registry import query, sql

REC = ["recording_id"]


def _pcm(t: Tables) -> DataFrame:
    return t.read("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("signal"))


@query("a1_frame_features", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 64), 9) AS rms, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 9) AS peak, round(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (embedding[i] < 0) <> (embedding[i + 1] < 0) THEN 1 ELSE 0 END)) / 63.0, 9) AS zcr FROM embeddings")
def a1(t: Tables) -> DataFrame:
    x = F.col("signal")
    return _pcm(t).select("vec_id", F.round(FR.rms(x), 9).alias("rms"), F.round(FR.peak(x), 9).alias("peak"), F.round(FR.zero_crossings(x), 9).alias("zcr"))


@query("w1_framing", "SELECT vec_id, CAST(f AS INTEGER) AS frame_index, round(list_sum(list_transform(range(f * 16 + 1, least(64, f * 16 + 24) + 1), lambda i: CAST(embedding[i] AS DOUBLE))), 9) AS total FROM embeddings, range(4) r(f)")
def w1(t: Tables) -> DataFrame:
    f = FR.frame_signal(_pcm(t), 24, 16, ["vec_id"])
    return f.select("vec_id", "frame_index", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


@query("w3_spectral_centroid", """WITH x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63))) AS y FROM embeddings),
 m AS (SELECT vec_id, k, sqrt(pow(list_sum(list_transform(range(0, 64), lambda i: y[i + 1] * cos(i * k * (2 * pi() / 64)))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: y[i + 1] * sin(i * k * (2 * pi() / 64)))), 2)) AS a FROM x, range(33) r(k))
 SELECT vec_id, round(sum(k * a) / sum(a), 6) AS centroid FROM m GROUP BY 1""")
def w3(t: Tables) -> DataFrame:
    """Centroid, in bins, of every vector."""
    m = _pcm(t).select("vec_id", FR.magnitudes(F.col("signal"), 64).alias("m"))
    top = F.aggregate(F.transform("m", lambda a, k: a * k), F.lit(0.0), lambda a, v: a + v)
    return m.select("vec_id", F.round(top / F.aggregate("m", F.lit(0.0), lambda a, v: a + v), 6).alias("centroid"))


@query("a2_stem_globals", sql(" SELECT recording_id, count(*) AS frame_count, round(max(rms), 9) AS peak, round(avg(CASE WHEN is_silent THEN 1.0 ELSE 0.0 END), 9) AS silence_ratio, count(*) FILTER (onset_score > 1e-4) AS onset_count, round(max(end_sec), 9) AS duration_sec FROM frames GROUP BY 1", "frames"))
def a2(t: Tables) -> DataFrame:
    return t.frames.groupBy(*REC).agg(F.count(F.lit(1)).alias("frame_count"), F.round(F.max("rms"), 9).alias("peak"), F.round(F.avg(F.col("is_silent").cast("double")), 9).alias("silence_ratio"), F.count_if(F.col("onset_score") > 1e-4).alias("onset_count"), F.round(F.max("end_sec"), 9).alias("duration_sec"))


@query("w2_energy_flux", sql(" SELECT recording_id, frame_index, round(onset_score, 9) AS flux FROM frames", "frames"))
def w2(t: Tables) -> DataFrame:
    w = Window.partitionBy(*REC).orderBy("frame_index")
    return t.frames.select(*REC, "frame_index", F.round(F.greatest(F.lit(0.0), F.col("rms") * F.col("rms") - F.lag(F.col("rms") * F.col("rms"), 1, 0.0).over(w)), 9).alias("flux"))


@query("w5_w6_smooth_delta", sql(", s AS (SELECT recording_id, frame_index, sum(rms) OVER (PARTITION BY recording_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS m FROM frames) SELECT recording_id, frame_index, round(m, 9) AS rms_smooth, round(m - coalesce(lag(m) OVER (PARTITION BY recording_id ORDER BY frame_index), m), 9) AS rms_delta FROM s", "frames"))
def w5(t: Tables) -> DataFrame:
    s = FR.delta(FR.smooth(t.frames, "rms", REC, "frame_index", 5, "m"), "m", REC, "frame_index", "d")
    return s.select(*REC, "frame_index", F.round("m", 9).alias("rms_smooth"), F.round("d", 9).alias("rms_delta"))


_CLASS = """, s AS (SELECT recording_id, frame_index, onset_score AS o, sum(rms) OVER (PARTITION BY recording_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS m FROM frames),
 d AS (SELECT *, m - coalesce(lag(m) OVER (PARTITION BY recording_id ORDER BY frame_index), m) AS e FROM s),
 q AS (SELECT recording_id, quantile_cont(m, 0.2) FILTER (m > 0) AS qs, quantile_cont(o, 0.75) AS qo, quantile_cont(e, 0.6) FILTER (e > 0) AS qa, quantile_cont(e, 0.4) FILTER (e < 0) AS qt FROM d GROUP BY 1),
 c AS (SELECT d.*, CASE WHEN m <= greatest(1e-5, 0.35 * qs) THEN 'silence' WHEN o >= greatest(1e-7, 0.6 * qo) AND e >= qa THEN 'attack' WHEN e <= qt THEN 'tail' ELSE 'sustain' END AS frame_class FROM d JOIN q USING (recording_id))"""


def _classed(t: Tables) -> DataFrame:
    s = FR.delta(FR.smooth(t.frames, "rms", REC, "frame_index", 5, "rms_smooth"), "rms_smooth", REC, "frame_index", "envelope_delta")
    return FR.classify(s.withColumnRenamed("onset_score", "onset_strength"), REC)


@query("p10_frame_classes", sql(_CLASS + " SELECT recording_id, frame_index, frame_class FROM c", "frames"))
def p10(t: Tables) -> DataFrame:
    return _classed(t).select(*REC, "frame_index", "frame_class")


@query("a7_class_report", sql(_CLASS + " SELECT recording_id, count(*) FILTER (frame_class = 'attack') AS attack, count(*) FILTER (frame_class = 'tail') AS tail, count(*) FILTER (frame_class = 'sustain') AS sustain, count(*) FILTER (frame_class = 'silence') AS silence, round(avg(m), 9) AS mean_rms FROM c GROUP BY 1", "frames"))
def a7(t: Tables) -> DataFrame:
    k = F.col("frame_class")
    return _classed(t).groupBy(*REC).agg(*[F.count_if(k == x).alias(x) for x in ("attack", "tail", "sustain", "silence")], F.round(F.avg("rms_smooth"), 9).alias("mean_rms"))


_ACTIVE = """, th AS (SELECT recording_id, greatest(1e-6, 0.18 * max(rms), 0.6 * avg(rms)) AS th FROM frames GROUP BY 1),
 a AS (SELECT f.*, th, rms >= th AS act FROM frames f JOIN th USING (recording_id)),
 r AS (SELECT *, sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame_index) AS run FROM a),
 b AS (SELECT *, NOT act AND end_sec - min(CASE WHEN NOT act THEN start_sec END) OVER (PARTITION BY recording_id, run ORDER BY frame_index) >= 0.6 AS brk FROM r),
 i AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame_index) AS isl FROM b),
 l AS (SELECT * FROM (SELECT *, max(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, isl ORDER BY frame_index) AS seen FROM i WHERE NOT brk) WHERE seen = 1),
 g AS (SELECT recording_id, isl, min(start_sec) AS start_sec, max_by(end_sec, frame_index) AS end_sec, max(rms) AS peak, CAST(count(*) FILTER (onset_score > 0) AS BIGINT) AS onsets, least(1.0, greatest(0.0, avg(rms) / any_value(th) * 0.6 + 0.1 * count(*) FILTER (onset_score > 0))) AS conf FROM l GROUP BY recording_id, isl),
 k AS (SELECT * FROM g WHERE end_sec - start_sec >= 0.3 OR onsets > 0),
 n AS (SELECT *, CASE WHEN greatest(0.0, start_sec - max(end_sec) OVER (PARTITION BY recording_id ORDER BY start_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) > 0.4 THEN 1 ELSE 0 END AS nw FROM k),
 mg AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY start_sec) AS grp FROM n),
 regions AS (SELECT recording_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(peak) AS peak_energy, CAST(sum(onsets) AS BIGINT) AS onset_count, max(conf) AS confidence FROM mg GROUP BY recording_id, grp)"""


def _regions(t: Tables) -> DataFrame:
    f = t.frames.select(*REC, "frame_index", "start_sec", "end_sec", F.col("rms").alias("energy"), F.col("onset_score").alias("onset"))
    return IS.hysteresis_regions(f, REC, hold=0.6, min_region=0.3, merge_gap=0.4)


@query("w19_activity_regions", sql(_ACTIVE + " SELECT recording_id, round(start_sec, 9) AS start_sec, round(end_sec, 9) AS end_sec, round(peak_energy, 9) AS peak_energy, onset_count FROM regions", "frames"))
def w19(t: Tables) -> DataFrame:
    return _regions(t).select(*REC, *[F.round(c, 9).alias(c) for c in ("start_sec", "end_sec", "peak_energy")], "onset_count")


_SPANS = """, w AS (SELECT *, CASE WHEN start_sec > max(end_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS nw FROM notes),
 w2 AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS grp FROM w),
 spans AS (SELECT recording_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS members FROM w2 GROUP BY recording_id, grp)"""


@query("w20_note_regions", sql(_SPANS.format(gap=0.05) + " SELECT recording_id, round(start_sec, 9) AS start_sec, round(end_sec, 9) AS end_sec, members FROM spans", "notes"))
def w20(t: Tables) -> DataFrame:
    return IS.merge_spans(t.notes, REC, 0.05).select(*REC, F.round("start_sec", 9).alias("start_sec"), F.round("end_sec", 9).alias("end_sec"), "members")


@query("w21_interval_union", sql(_SPANS.format(gap=0.0) + " SELECT recording_id, count(*) AS spans, round(sum(end_sec - start_sec), 6) AS covered_sec FROM spans GROUP BY 1", "notes"))
def w21(t: Tables) -> DataFrame:
    return IS.merge_spans(t.notes, REC).groupBy(*REC).agg(F.count(F.lit(1)).alias("spans"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 6).alias("covered_sec"))


@query("a10_region_coverage", sql(_SPANS.format(gap=0.0) + _ACTIVE + " SELECT r.recording_id, round(r.start_sec, 9) AS start_sec, round(coalesce(sum(greatest(0.0, least(r.end_sec, s.end_sec) - greatest(r.start_sec, s.start_sec))) FILTER (s.start_sec IS NOT NULL), 0.0), 6) AS covered_sec FROM regions r LEFT JOIN spans s ON s.recording_id = r.recording_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec GROUP BY r.recording_id, r.start_sec", "frames", "notes"))
def a10(t: Tables) -> DataFrame:
    r = _regions(t).select(*REC, "start_sec", "end_sec")
    p = interval_join(r, IS.merge_spans(t.notes, REC).select(*REC, "start_sec", "end_sec"), REC, 4.0)
    c = p.groupBy(*REC, "start_sec").agg(F.sum(F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec")).alias("c"))
    return r.join(c, [*REC, "start_sec"], "left").select(*REC, F.round("start_sec", 9).alias("start_sec"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("covered_sec"))


_BEST = """, o AS (SELECT n.recording_id, n.note_id, r.start_sec AS region_start, row_number() OVER (PARTITION BY n.recording_id, n.note_id ORDER BY round(least(r.end_sec, n.end_sec) - greatest(r.start_sec, n.start_sec), 9) DESC, r.start_sec) AS rn
 FROM notes n JOIN regions r ON r.recording_id = n.recording_id AND r.end_sec > n.start_sec AND r.start_sec < n.end_sec)"""


@query("j14_best_region", sql(_ACTIVE + _BEST + " SELECT recording_id, note_id, round(region_start, 9) AS region_start FROM o WHERE rn = 1", "frames", "notes"))
def j14(t: Tables) -> DataFrame:
    p = interval_join(t.notes.select(*REC, "note_id", "start_sec", "end_sec"), _regions(t).select(*REC, "start_sec", "end_sec"), REC, 4.0)
    length = F.round(F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec"), 9)
    best = p.groupBy(*REC, "note_id").agg(F.min(F.struct((-length).alias("l"), F.col("r_start_sec").alias("s"))).alias("b"))
    return best.select(*REC, "note_id", F.round("b.s", 9).alias("region_start"))


@query("w12_silence_runs", sql(", r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_index) - row_number() OVER (PARTITION BY recording_id, is_silent ORDER BY frame_index) AS run FROM frames) SELECT recording_id, round(min(start_sec), 9) AS start_sec, round(max(end_sec) - min(start_sec), 9) AS length_sec, count(*) AS frames FROM r WHERE is_silent GROUP BY recording_id, run HAVING max(end_sec) - min(start_sec) >= 0.5", "frames"))
def w12(t: Tables) -> DataFrame:
    w = Window.partitionBy(*REC).orderBy("frame_index")
    r = t.frames.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*REC, "is_silent").orderBy("frame_index"))).where("is_silent")
    g = r.groupBy(*REC, "run").agg(F.min("start_sec").alias("s"), F.max("end_sec").alias("e"), F.count(F.lit(1)).alias("frames")).where("e - s >= 0.5")
    return g.select(*REC, F.round("s", 9).alias("start_sec"), F.round(F.col("e") - F.col("s"), 9).alias("length_sec"), "frames")


@query("w18_overlap_trim", sql(", x AS (SELECT *, lead(start_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id) AS nx FROM notes) SELECT recording_id, note_id, round(least(end_sec, coalesce(nx, end_sec)), 9) AS end_sec, coalesce(nx < end_sec, false) AS trimmed FROM x", "notes"))
def w18(t: Tables) -> DataFrame:
    nx = F.lead("start_sec").over(Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id"))
    n = t.notes.withColumn("nx", nx)
    return n.select(*REC, "note_id", F.round(F.least("end_sec", F.coalesce("nx", "end_sec")), 9).alias("end_sec"), F.coalesce(F.col("nx") < F.col("end_sec"), F.lit(False)).alias("trimmed"))


@query("w16_w17_next_note_caps", sql(", x AS (SELECT *, lead(start_sec) OVER w AS ns, lead(pitch_midi) OVER w AS np FROM notes WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id)), y AS (SELECT *, greatest(end_sec, least(start_sec + 0.3, coalesce(ns, start_sec + 0.3))) AS e FROM x) SELECT recording_id, note_id, round(CASE WHEN ns - e > 0 AND ns - e <= 0.1 AND abs(np - pitch_midi) <= 12 THEN ns ELSE e END, 9) AS end_sec FROM y", "notes"))
def w16(t: Tables) -> DataFrame:
    w = Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id")
    n = t.notes.withColumns({"ns": F.lead("start_sec").over(w), "np": F.lead("pitch_midi").over(w)})
    n = n.withColumn("e", F.greatest("end_sec", F.least(F.col("start_sec") + 0.3, F.coalesce("ns", F.col("start_sec") + 0.3))))
    gap = F.col("ns") - F.col("e")
    return n.select(*REC, "note_id", F.round(F.when((gap > 0) & (gap <= 0.1) & (F.abs(F.col("np") - F.col("pitch_midi")) <= 12), F.col("ns")).otherwise(F.col("e")), 9).alias("end_sec"))


@query("w23_envelope", sql(", a AS (SELECT recording_id, frame_index, rms, quantile_cont(rms, 0.05) OVER (PARTITION BY recording_id) AS p5 FROM frames), b AS (SELECT *, greatest(rms - p5, 0.0) AS x FROM a), c AS (SELECT *, quantile_cont(x, 0.95) OVER (PARTITION BY recording_id) AS p95 FROM b) SELECT recording_id, frame_index, round(least(2.5, x / p95), 9) AS env FROM c", "frames"))
def w23(t: Tables) -> DataFrame:
    return FR.normalise_envelope(t.frames, "rms", REC, "e").select(*REC, "frame_index", F.round("e", 9).alias("env"))


@query("j16_x6_prev_next_note", sql(", e AS (SELECT DISTINCT recording_id, end_sec FROM notes), s AS (SELECT DISTINCT recording_id, start_sec FROM notes) SELECT q.recording_id, q.frame_index, round(e.end_sec, 9) AS prev_end, round(s.start_sec, 9) AS next_start FROM frames q ASOF LEFT JOIN e ON e.recording_id = q.recording_id AND q.start_sec >= e.end_sec ASOF LEFT JOIN s ON s.recording_id = q.recording_id AND q.start_sec <= s.start_sec", "frames", "notes"))
def j16(t: Tables) -> DataFrame:
    """Backward and forward as-of with every frame as a probe."""
    q = t.frames.select(*REC, "frame_index", F.col("start_sec").alias("at"))
    ends = t.notes.select(*REC, F.col("end_sec").alias("at"), F.col("end_sec").alias("prev_end")).distinct()
    starts = t.notes.select(*REC, F.col("start_sec").alias("at"), F.col("start_sec").alias("next_start")).distinct()
    r = asof_join(asof_join(q, ends, REC, "at", ["prev_end"]), starts, REC, "at", ["next_start"], forward=True)
    return r.select(*REC, "frame_index", F.round("prev_end", 9).alias("prev_end"), F.round("next_start", 9).alias("next_start"))


@query("j17_closest_note", sql(", q AS (SELECT recording_id, frame_index, start_sec AS t FROM frames), c AS (SELECT q.recording_id, frame_index, note_id, row_number() OVER (PARTITION BY q.recording_id, frame_index ORDER BY round(least(abs(n.start_sec - t), abs(n.end_sec - t)), 9), n.start_sec, note_id) AS rn FROM q JOIN notes n ON n.recording_id = q.recording_id AND least(abs(n.start_sec - t), abs(n.end_sec - t)) <= 0.8) SELECT recording_id, frame_index, note_id FROM c WHERE rn = 1", "frames", "notes"))
def j17(t: Tables) -> DataFrame:
    edges = t.notes.select(*REC, "note_id", F.col("start_sec").alias("s"), F.explode(F.array("start_sec", "end_sec")).alias("start_sec"))
    return W.nearest_edge(t.frames, edges, REC, "frame_index", ["s", "note_id"], 0.8).select(*REC, "frame_index", "note_id")


_PW = """, pj AS (SELECT n.recording_id, n.note_id, p.voiced, p.confidence, CAST(round_even(69 + 12 * log2(p.f0_hz / 440), 0) AS INTEGER) AS pm, p.frame_index FROM notes n JOIN pitch_frames p ON p.recording_id = n.recording_id AND p.start_sec <= n.end_sec AND p.end_sec >= n.start_sec)"""


@query("j18_pitch_window", sql(_PW + " SELECT recording_id, note_id, count(*) AS frames, round(avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END), 9) AS voiced_ratio, round(avg(confidence), 9) AS mean_confidence FROM pj GROUP BY ALL", "notes", "pitch_frames"))
def j18(t: Tables) -> DataFrame:
    p = W.overlap_stats(t.notes, t.pitch_frames, REC, "note_id", ["voiced", "confidence"], closed=True)
    return p.select(*REC, "note_id", F.col("n").alias("frames"), F.round("avg_voiced", 9).alias("voiced_ratio"), F.round("avg_confidence", 9).alias("mean_confidence"))


@query("j19_best_pitch", sql(_PW + ", r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY confidence DESC, frame_index) AS rn FROM pj WHERE voiced AND confidence >= 0.5) SELECT recording_id, note_id, pm AS pitch_midi FROM r WHERE rn = 1", "notes", "pitch_frames"))
def j19(t: Tables) -> DataFrame:
    f = t.pitch_frames.where("voiced and confidence >= 0.5")
    b = W.overlap_best(t.notes, f, REC, "note_id", "confidence", closed=True).select(*REC, "note_id", "frame_index")
    return b.join(f.select(*REC, "frame_index", F.rint(E.hz_to_midi(F.col("f0_hz"))).cast("int").alias("pitch_midi")), [*REC, "frame_index"]).select(*REC, "note_id", "pitch_midi")


@query("j20_dominant_pitch", sql(_PW + ", s AS (SELECT recording_id, note_id, pm, round(sum(confidence), 9) AS c, min(frame_index) AS f FROM pj WHERE voiced GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY c DESC, f) AS rn FROM s) SELECT recording_id, note_id, pm AS pitch_midi FROM r WHERE rn = 1", "notes", "pitch_frames"))
def j20(t: Tables) -> DataFrame:
    return RP.dominant_pitch(t.notes, t.pitch_frames, 4.0).select(*REC, "note_id", F.col("expected").alias("pitch_midi"))


@query("a8_pitch_report", sql(" SELECT recording_id, round(avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END), 9) AS voiced_ratio, round(avg(confidence), 9) AS mean_confidence, round(min(f0_hz) FILTER (voiced), 6) AS min_hz, round(max(f0_hz) FILTER (voiced), 6) AS max_hz FROM pitch_frames GROUP BY 1", "pitch_frames"))
def a8(t: Tables) -> DataFrame:
    v = F.when(F.col("voiced"), F.col("f0_hz"))
    return t.pitch_frames.groupBy(*REC).agg(F.round(F.avg(F.col("voiced").cast("double")), 9).alias("voiced_ratio"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.round(F.min(v), 6).alias("min_hz"), F.round(F.max(v), 6).alias("max_hz"))


@query("f5_hz_to_midi", sql(" SELECT recording_id, frame_index, round(69 + 12 * log2(f0_hz / 440), 9) AS midi, CAST(round_even(69 + 12 * log2(f0_hz / 440), 0) AS INTEGER) AS midi_rounded FROM pitch_frames", "pitch_frames"))
def f5(t: Tables) -> DataFrame:
    m = E.hz_to_midi(F.col("f0_hz"))
    return t.pitch_frames.select(*REC, "frame_index", F.round(m, 9).alias("midi"), F.rint(m).cast("int").alias("midi_rounded"))


_ERR = _ACTIVE + _SPANS.format(gap=0.0) + """, cov AS (SELECT r.recording_id, r.start_sec, r.end_sec, coalesce(sum(greatest(0.0, least(r.end_sec, s.end_sec) - greatest(r.start_sec, s.start_sec))) FILTER (s.start_sec IS NOT NULL), 0.0) / (r.end_sec - r.start_sec) AS c FROM regions r LEFT JOIN spans s ON s.recording_id = r.recording_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec GROUP BY r.recording_id, r.start_sec, r.end_sec),
 ovh AS (SELECT s.recording_id, s.start_sec, s.end_sec, coalesce(sum(greatest(0.0, least(r.end_sec, s.end_sec) - greatest(r.start_sec, s.start_sec))) FILTER (r.start_sec IS NOT NULL), 0.0) / (s.end_sec - s.start_sec) AS c FROM spans s LEFT JOIN regions r ON s.recording_id = r.recording_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec GROUP BY s.recording_id, s.start_sec, s.end_sec),
 gp AS (SELECT recording_id, end_sec AS s, lead(start_sec) OVER (PARTITION BY recording_id ORDER BY start_sec) AS e FROM spans)"""


@query("a12_u5_error_regions", sql(_ERR + " SELECT recording_id, 'AUDIO_GAP' AS kind, round(start_sec, 9) AS start_sec FROM cov WHERE round(c, 9) < 0.9 UNION ALL SELECT recording_id, 'MIDI_OVERHANG', round(start_sec, 9) FROM ovh WHERE round(c, 9) < 0.85 UNION ALL SELECT recording_id, 'MICRO_GAP', round(s, 9) FROM gp WHERE e - s > 0 AND e - s <= 0.06", "frames", "notes"))
def a12(t: Tables) -> DataFrame:
    spans, regions = IS.merge_spans(t.notes, REC).select(*REC, "start_sec", "end_sec"), _regions(t).select(*REC, "start_sec", "end_sec")

    def covered(a: DataFrame, b: DataFrame) -> DataFrame:
        p = interval_join(a, b, REC, 4.0).groupBy(*REC, "start_sec").agg(F.sum(F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec")).alias("c"))
        return a.join(p, [*REC, "start_sec"], "left").withColumn("c", F.round(F.coalesce("c", F.lit(0.0)) / (F.col("end_sec") - F.col("start_sec")), 9))

    gap = F.lead("start_sec").over(Window.partitionBy(*REC).orderBy("start_sec")) - F.col("end_sec")
    micro = spans.withColumn("g", gap).where("g > 0 and g <= 0.06").select(*REC, F.lit("MICRO_GAP").alias("kind"), F.col("end_sec").alias("start_sec"))
    out = covered(regions, spans).where("c < 0.9").select(*REC, F.lit("AUDIO_GAP").alias("kind"), "start_sec").unionByName(covered(spans, regions).where("c < 0.85").select(*REC, F.lit("MIDI_OVERHANG").alias("kind"), "start_sec")).unionByName(micro)
    return out.select(*REC, "kind", F.round("start_sec", 9).alias("start_sec"))


@query("a26_pitch_sections", sql(", g AS (SELECT recording_id, CAST(unnest(range(0, CAST(ceil(max(end_sec)) AS BIGINT))) AS INTEGER) AS section FROM frames GROUP BY 1) SELECT g.recording_id, section, count(*) AS frames, round(avg(confidence), 9) AS mean_confidence FROM g JOIN pitch_frames p ON p.recording_id = g.recording_id AND p.end_sec > section AND p.start_sec < section + 1 GROUP BY ALL", "frames", "pitch_frames"))
def a26(t: Tables) -> DataFrame:
    """Per-second sections to the end of each recording by overlap: a frame can count in several."""
    p = t.pitch_frames.withColumn("section", F.explode(F.sequence(F.floor("start_sec").cast("int"), F.greatest(F.floor("start_sec"), F.ceil("end_sec") - 1).cast("int"))))
    return p.where("end_sec > section and start_sec < section + 1").groupBy(*REC, "section").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


@query("t7_top_regions", sql(_ACTIVE + ", r2 AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY peak_energy DESC, onset_count DESC, start_sec) AS rk FROM regions) SELECT recording_id, CAST(rk AS INTEGER) AS rank_no, round(start_sec, 9) AS start_sec FROM r2 WHERE rk <= 3", "frames"))
def t7(t: Tables) -> DataFrame:
    rk = F.row_number().over(Window.partitionBy(*REC).orderBy(F.col("peak_energy").desc(), F.col("onset_count").desc(), "start_sec"))
    return _regions(t).withColumn("rank_no", rk).where("rank_no <= 3").select(*REC, "rank_no", F.round("start_sec", 9).alias("start_sec"))
