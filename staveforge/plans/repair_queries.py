"""Activity repair, scores and passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.operators import repair as R
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import staged_by

from .frame_queries import _ACTIVE, _regions
from .registry import query, sql

REC = ["recording_id"]
# The fixture's time runs a thousand times faster than a stem's, so times are wider here.
P = R.Repair(missing_min=0.3, max_extend=1.0, max_insert=2.5, context=2.0, overhang_min=0.1, tail_padding=0.03, min_duration=0.08, sustain_ratio=0.5, sustain_hold=0.5, pitch_hold=0.5, legato_window=0.3, legato_silence=0.05, split_min=0.3, split_edge=0.03, split_back=0.3, contour_confidence=0.5, close_gap=0.1, near_pitch=12)

_SPAN = """, {out}_w AS (SELECT *, CASE WHEN start_sec > max(end_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS nw FROM {src}),
 {out}_g AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS grp FROM {out}_w),
 {out} AS (SELECT recording_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM {out}_g GROUP BY recording_id, grp)"""
_OV = "least({a}.end_sec, {b}.end_sec) - greatest({a}.start_sec, {b}.start_sec)"
_CLIP = "least(1.0, greatest(0.0, {}))"


def _phase1(n: str) -> str:
    over = _OV.format(a="r", b="s")
    return _SPAN.format(out="mr", gap=P.close_gap, src=n) + f""", open1 AS (SELECT r.recording_id, r.start_sec, r.end_sec, r.confidence FROM regions r LEFT JOIN mr s ON s.recording_id = r.recording_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec
   GROUP BY ALL HAVING round(r.end_sec - r.start_sec - coalesce(sum({over}) FILTER (s.start_sec IS NOT NULL), 0.0), 9) >= {P.missing_min}),
 in1 AS (SELECT r.recording_id, r.start_sec, n.note_id AS in_id, n.end_sec AS in_end, row_number() OVER (PARTITION BY r.recording_id, r.start_sec ORDER BY n.end_sec DESC, n.start_sec, n.note_id) AS k FROM open1 r JOIN {n} n ON n.recording_id = r.recording_id AND n.end_sec > r.start_sec AND n.start_sec < r.end_sec),
 be1 AS (SELECT r.recording_id, r.start_sec, n.note_id AS be_id, n.end_sec AS be_end, row_number() OVER (PARTITION BY r.recording_id, r.start_sec ORDER BY n.end_sec DESC, n.start_sec, n.note_id) AS k FROM open1 r JOIN {n} n ON n.recording_id = r.recording_id AND n.end_sec <= r.start_sec),
 nx1 AS (SELECT r.recording_id, r.start_sec, n.note_id AS nx_id, n.start_sec AS nx_start, row_number() OVER (PARTITION BY r.recording_id, r.start_sec ORDER BY n.start_sec, n.end_sec, n.note_id) AS k FROM open1 r JOIN {n} n ON n.recording_id = r.recording_id AND n.start_sec >= r.end_sec),
 ne1 AS (SELECT r.recording_id, r.start_sec, n.pitch_midi AS ne_pitch, row_number() OVER (PARTITION BY r.recording_id, r.start_sec ORDER BY round(least(abs(n.start_sec - (r.start_sec + r.end_sec) * 0.5), abs(n.end_sec - (r.start_sec + r.end_sec) * 0.5)), 9), n.start_sec, n.end_sec, n.note_id) AS k
   FROM open1 r JOIN {n} n ON n.recording_id = r.recording_id AND least(abs(n.start_sec - (r.start_sec + r.end_sec) * 0.5), abs(n.end_sec - (r.start_sec + r.end_sec) * 0.5)) <= {P.context}),
 co1 AS (SELECT r.recording_id, r.start_sec, CAST(round_even(69 + 12 * log2(p.f0_hz / 440), 0) AS INTEGER) AS co_pitch, row_number() OVER (PARTITION BY r.recording_id, r.start_sec ORDER BY p.confidence DESC, p.frame_index) AS k FROM open1 r JOIN pitch_frames p ON p.recording_id = r.recording_id AND p.start_sec <= r.end_sec AND p.end_sec >= r.start_sec AND p.voiced AND p.confidence >= {P.contour_confidence}),
 j1 AS (SELECT r.*, coalesce(in_end, be_end) AS pe, CASE WHEN in_end IS NOT NULL THEN in_id ELSE be_id END AS pid, nx_id, nx_start, ne_pitch, co_pitch, ne1.k IS NOT NULL AS has_ne, co1.k IS NOT NULL AS has_co, round(r.end_sec - r.start_sec, 9) <= {P.max_insert} AS short
   FROM open1 r LEFT JOIN in1 ON in1.recording_id = r.recording_id AND in1.start_sec = r.start_sec AND in1.k = 1 LEFT JOIN be1 ON be1.recording_id = r.recording_id AND be1.start_sec = r.start_sec AND be1.k = 1 LEFT JOIN nx1 ON nx1.recording_id = r.recording_id AND nx1.start_sec = r.start_sec AND nx1.k = 1
   LEFT JOIN ne1 ON ne1.recording_id = r.recording_id AND ne1.start_sec = r.start_sec AND ne1.k = 1 LEFT JOIN co1 ON co1.recording_id = r.recording_id AND co1.start_sec = r.start_sec AND co1.k = 1),
 k1 AS (SELECT *, round(CASE WHEN has_ne AND short THEN {_CLIP.format('0.55 + 0.4 * confidence')} WHEN has_co AND short THEN {_CLIP.format('0.50 + 0.35 * confidence')} END, 9) AS sure FROM j1),
 d1 AS (SELECT *, CASE WHEN round(end_sec - pe, 9) > 0 AND round(end_sec - pe, 9) <= {P.max_extend} THEN 'EXTEND_NOTE' WHEN round(nx_start - start_sec, 9) > 0 AND round(nx_start - start_sec, 9) <= {P.max_extend} THEN 'CLOSE_GAP' WHEN sure >= {P.insert_confidence} THEN 'INSERT_MISSING_NOTE' ELSE 'REVIEW_MANUAL' END AS action FROM k1),
 phase1 AS (SELECT recording_id, start_sec, end_sec, action, CASE action WHEN 'EXTEND_NOTE' THEN pid WHEN 'CLOSE_GAP' THEN nx_id END AS target_note_id, CASE WHEN action = 'INSERT_MISSING_NOTE' THEN coalesce(co_pitch, ne_pitch) END AS pitch_midi,
   round(CASE action WHEN 'EXTEND_NOTE' THEN {_CLIP.format('0.7 + 0.2 * confidence')} WHEN 'CLOSE_GAP' THEN {_CLIP.format('0.65 + 0.2 * confidence')} ELSE coalesce(sure, 0.4) END, 9) AS confidence FROM d1)"""


def _apply1(n: str) -> str:
    return f""", x1 AS (SELECT recording_id, target_note_id AS note_id, max(end_sec) FILTER (action = 'EXTEND_NOTE') AS e, min(start_sec) FILTER (action = 'CLOSE_GAP') AS s FROM phase1 WHERE target_note_id IS NOT NULL GROUP BY ALL),
 n1 AS (SELECT n.recording_id, n.note_id, n.pitch_midi, least(n.start_sec, coalesce(s, n.start_sec)) AS start_sec, greatest(n.end_sec, coalesce(e, n.end_sec)) AS end_sec, CASE WHEN e IS NOT NULL THEN 'EXTENDED' WHEN s IS NOT NULL THEN 'GAP_CLOSED' END AS phase_1 FROM {n} n LEFT JOIN x1 USING (recording_id, note_id)
   UNION ALL SELECT recording_id, printf('repair_missing_%06d', row_number() OVER (PARTITION BY recording_id ORDER BY start_sec)), pitch_midi, start_sec, end_sec, 'INSERTED' FROM phase1 WHERE action = 'INSERT_MISSING_NOTE')"""


def _phase2(n: str) -> str:
    return f""", b2 AS (SELECT n.recording_id, n.note_id, n.start_sec, n.end_sec, r.end_sec AS re, row_number() OVER (PARTITION BY n.recording_id, n.note_id ORDER BY round({_OV.format(a='n', b='r')}, 9) DESC, r.start_sec) AS k FROM {n} n JOIN regions r ON r.recording_id = n.recording_id AND r.end_sec > n.start_sec AND r.start_sec < n.end_sec),
 o2 AS (SELECT b.*, least(end_sec, re + {P.tail_padding}) AS cand, (SELECT min(start_sec) FROM {n} x WHERE x.recording_id = b.recording_id AND x.start_sec >= b.end_sec) AS ns FROM b2 b WHERE k = 1 AND round(end_sec - re, 9) >= {P.overhang_min}),
 g2 AS (SELECT o.*, round(ns - end_sec, 9) AS gap, EXISTS (SELECT 1 FROM regions r WHERE r.recording_id = o.recording_id AND r.end_sec > o.end_sec AND r.start_sec < o.ns AND round(o.ns - o.end_sec, 9) > 0) AS bridged,
   (SELECT avg(rms) FROM frames f WHERE f.recording_id = o.recording_id AND f.start_sec >= cand AND f.start_sec <= greatest(cand, least(o.end_sec, cand + {P.sustain_hold}))) AS am, (SELECT max(rms) FROM frames f WHERE f.recording_id = o.recording_id AND f.start_sec >= cand AND f.start_sec <= greatest(cand, least(o.end_sec, cand + {P.sustain_hold}))) AS ax,
   (SELECT max(rms) FROM frames f WHERE f.recording_id = o.recording_id AND f.start_sec >= o.start_sec AND f.start_sec <= o.end_sec) AS ox,
   (SELECT bool_or(voiced) FROM pitch_frames p WHERE p.recording_id = o.recording_id AND p.start_sec <= greatest(cand, least(o.end_sec, cand + {P.pitch_hold})) AND p.end_sec >= cand) AS vo, (SELECT avg(confidence) FROM pitch_frames p WHERE p.recording_id = o.recording_id AND p.start_sec <= greatest(cand, least(o.end_sec, cand + {P.pitch_hold})) AND p.end_sec >= cand) AS pc FROM o2 o),
 phase2 AS (SELECT recording_id, note_id, start_sec, end_sec, cand AS proposed_end, CASE WHEN gap <= {P.legato_window} AND (bridged OR gap < {P.legato_silence}) THEN 'LEGATO_PROTECTED' WHEN round(am / greatest(1e-6, coalesce(ox, ax)), 9) >= {P.sustain_ratio} THEN 'SUSTAIN_PROTECTED' WHEN vo AND round(pc, 9) >= 0.6 THEN 'PITCH_PROTECTED'
   WHEN round(cand - start_sec, 9) >= {P.min_duration} THEN 'SHORTENED' ELSE 'MINIMUM_DURATION' END AS decision FROM g2)"""


_APPLY2 = """, n2 AS (SELECT n.recording_id, n.note_id, n.pitch_midi, n.start_sec, CASE WHEN decision = 'SHORTENED' THEN proposed_end ELSE n.end_sec END AS end_sec, phase_1, decision AS phase_2 FROM n1 n LEFT JOIN phase2 d ON d.recording_id = n.recording_id AND d.note_id = n.note_id)"""


def _phase3(n: str) -> str:
    def dom(a: str, b: str, out: str) -> str:
        return f"""{out}_c AS (SELECT s.recording_id, s.note_id, CAST(round_even(69 + 12 * log2(p.f0_hz / 440), 0) AS INTEGER) AS pm, count(*) AS c, min(p.frame_index) AS f FROM v3 s JOIN pitch_frames p ON p.recording_id = s.recording_id AND p.start_sec <= {b} AND p.end_sec >= {a} AND p.voiced GROUP BY ALL),
 {out} AS (SELECT recording_id, note_id, pm AS {out} FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY c DESC, f) AS k FROM {out}_c) WHERE k = 1)"""

    return f""", s3 AS (SELECT recording_id, note_id, start_sec AS s, end_sec AS e, start_sec + {P.split_edge} AS a, end_sec - {P.split_edge} AS b FROM {n} WHERE round(end_sec - start_sec, 9) >= {P.split_min} AND end_sec - {P.split_edge} > start_sec + {P.split_edge}),
 pk3 AS (SELECT s3.*, f.start_sec AS t, f.onset_score AS onset, avg(f.onset_score) OVER (PARTITION BY s3.recording_id, s3.note_id) AS mean, row_number() OVER (PARTITION BY s3.recording_id, s3.note_id ORDER BY f.onset_score DESC, f.frame_index) AS k FROM s3 JOIN frames f ON f.recording_id = s3.recording_id AND f.start_sec >= a AND f.start_sec <= b),
 va3 AS (SELECT p.*, coalesce((SELECT avg(onset_score) FROM frames f WHERE f.recording_id = p.recording_id AND f.start_sec >= greatest(s, t - {P.split_back}) AND f.start_sec <= t), 0.0) AS valley FROM pk3 p WHERE k = 1 AND onset >= greatest(1e-6, mean * {P.split_onset_ratio})),
 v3 AS (SELECT * FROM va3 WHERE round(valley, 9) <= greatest(1e-6, round(onset * {P.split_valley}, 9))),
 {dom('s.a', 'greatest(s.a, s.t - 0.04)', 'p0')}, {dom('least(s.b, s.t + 0.04)', 's.b', 'p1')},
 c3 AS (SELECT v3.*, coalesce(CAST(abs(p1 - p0) AS DOUBLE), 0.0) AS change FROM v3 LEFT JOIN p0 USING (recording_id, note_id) LEFT JOIN p1 USING (recording_id, note_id)),
 f3 AS (SELECT *, change < {P.split_pitch} AND round(valley, 9) >= greatest(1e-6, round(onset * 0.02, 9)) AS flat, least(1.0, least(1.0, 0.65 + onset / greatest(1e-6, mean) * 0.1) + CASE WHEN change >= {P.split_pitch} THEN 0.12 ELSE 0.0 END) AS sure FROM c3),
 phase3 AS (SELECT recording_id, note_id, t AS split_sec, change AS pitch_change, round(CASE WHEN flat THEN 0.5 ELSE sure END, 9) AS confidence, CASE WHEN flat OR round(sure, 9) < {P.split_confidence} THEN 'REVIEW_MANUAL' ELSE 'SPLIT_NOTE' END AS action FROM f3)"""


_APPLY3 = """, m3 AS (SELECT n.*, split_sec, coalesce(split_sec > n.start_sec AND split_sec < n.end_sec, false) AND coalesce(phase_1, '') NOT IN ('INSERTED', 'EXTENDED') AND coalesce(phase_2, '') <> 'SUSTAIN_PROTECTED' AS cut FROM n2 n LEFT JOIN (SELECT * FROM phase3 WHERE action = 'SPLIT_NOTE') s ON s.recording_id = n.recording_id AND s.note_id = n.note_id),
 n3 AS (SELECT recording_id, note_id, pitch_midi, start_sec, CASE WHEN cut THEN split_sec ELSE end_sec END AS end_sec, phase_1, phase_2, cut FROM m3
  UNION ALL SELECT recording_id, printf('repair_split_%06d', row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id)), pitch_midi, split_sec, end_sec, phase_1, phase_2, true FROM m3 WHERE cut)"""


def _phase5(n: str) -> str:
    return f""", l5 AS (SELECT *, lead(start_sec) OVER w AS ns, lead(pitch_midi) OVER w AS np FROM {n} WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id)),
 c5 AS (SELECT *, coalesce(round(ns - end_sec, 9) > 0 AND round(ns - end_sec, 9) <= {P.close_gap} AND abs(np - pitch_midi) <= {P.near_pitch}, false) AND EXISTS (SELECT 1 FROM regions r WHERE r.recording_id = l5.recording_id AND r.end_sec > l5.end_sec AND r.start_sec < l5.ns) AS closes FROM l5),
 n5 AS (SELECT recording_id, note_id, pitch_midi, start_sec, greatest(start_sec, least(CASE WHEN closes THEN ns ELSE end_sec END, coalesce(ns, CASE WHEN closes THEN ns ELSE end_sec END))) AS end_sec, phase_1, phase_2, cut, closes AS phase_5 FROM c5)"""


def _views() -> tuple[str, str, str]:
    return "frames", "notes", "pitch_frames"


_M1 = _ACTIVE + _phase1("notes") + _apply1("notes")
_M2 = _M1 + _phase2("n1") + _APPLY2
_M3 = _M2 + _phase3("n2") + _APPLY3
_M5 = _M3 + _phase5("n3")
_TIMES = "round(start_sec, 9) AS start_sec, round(end_sec, 9) AS end_sec"


def _inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Notes, regions, frames and pitch frames, staged because every phase reads them."""
    frames = staged_frames(t)
    return R.staged(t.notes.select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec")), R.staged(_regions(t)), frames, t.pitch_frames


def staged_frames(t: Tables) -> DataFrame:
    """The frames, staged by recording in place of t's own, so that one exchange and one sort of the events serve regions, pitch frames and all windows."""
    t.frames = staged_by(t.frames, REC)
    return t.frames


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("m5_phase1_missing_coverage", sql(_ACTIVE + _phase1("notes") + f" SELECT recording_id, {_TIMES}, action, target_note_id, pitch_midi, confidence FROM phase1", *_views()))
def m5a(t: Tables) -> DataFrame:
    notes, regions, _, pitch = _inputs(t)
    return _rounded(R.missing_coverage(regions, notes, pitch, P), "start_sec", "end_sec")


@query("m5_phase2_w40_w41_w42_overhang", sql(_M1 + _phase2("n1") + f" SELECT recording_id, note_id, {_TIMES}, decision, round(proposed_end, 9) AS proposed_end FROM phase2", *_views()))
def m5b(t: Tables) -> DataFrame:
    notes, regions, frames, pitch = _inputs(t)
    n = R.staged(R.apply_coverage(notes, R.missing_coverage(regions, notes, pitch, P)))
    return _rounded(R.overhangs(n, regions, frames, pitch, P), "start_sec", "end_sec", "proposed_end")


@query("m5_phase3_split_candidates", sql(_ACTIVE + _phase3("notes") + " SELECT recording_id, note_id, round(split_sec, 9) AS split_sec, pitch_change, confidence, action FROM phase3", *_views()))
def m5c(t: Tables) -> DataFrame:
    notes, _, frames, pitch = _inputs(t)
    return _rounded(R.splits(notes, frames, pitch, P), "split_sec")


@query("m5_activity_repair", sql(_M5 + f" SELECT recording_id, note_id, pitch_midi, {_TIMES}, phase_1, phase_2, cut, phase_5 FROM n5", *_views()))
def m5(t: Tables) -> DataFrame:
    return _rounded(R.repair(*_inputs(t), P), "start_sec", "end_sec").select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec", "phase_1", "phase_2", "cut", "phase_5")


def _errors(n: str, k: str = "") -> str:
    return _SPAN.format(out=f"au{k}", gap=0.0, src="regions") + _SPAN.format(out=f"mi{k}", gap=0.0, src=n) + f""", dp{k}_c AS (SELECT n.recording_id, n.note_id, CAST(round_even(69 + 12 * log2(p.f0_hz / 440), 0) AS INTEGER) AS pm, round(sum(p.confidence), 9) AS c, min(p.frame_index) AS f FROM {n} n JOIN pitch_frames p ON p.recording_id = n.recording_id AND p.start_sec <= n.end_sec AND p.end_sec >= n.start_sec AND p.voiced GROUP BY ALL),
 dp{k} AS (SELECT recording_id, note_id, pm AS expected FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, note_id ORDER BY c DESC, f) AS k FROM dp{k}_c) WHERE k = 1),
 cg{k} AS (SELECT r.recording_id, r.start_sec, r.end_sec, round(coalesce(sum({_OV.format(a='r', b='s')}) FILTER (s.start_sec IS NOT NULL), 0.0) / greatest(1e-9, r.end_sec - r.start_sec), 9) AS c FROM regions r LEFT JOIN mi{k} s ON s.recording_id = r.recording_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec GROUP BY r.recording_id, r.start_sec, r.end_sec),
 co{k} AS (SELECT r.recording_id, r.note_id, r.start_sec, r.end_sec, round(coalesce(sum({_OV.format(a='r', b='s')}) FILTER (s.start_sec IS NOT NULL), 0.0) / greatest(1e-9, r.end_sec - r.start_sec), 9) AS c FROM {n} r LEFT JOIN au{k} s ON s.recording_id = r.recording_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec WHERE r.recording_id IN (SELECT recording_id FROM regions) GROUP BY r.recording_id, r.note_id, r.start_sec, r.end_sec),
 mgp{k} AS (SELECT recording_id, note_id, end_sec AS start_sec, ns AS end_sec, round(ns - end_sec, 9) AS g FROM (SELECT *, lead(start_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id) AS ns FROM {n}) WHERE round(ns - end_sec, 9) > 0 AND round(ns - end_sec, 9) <= 0.06),
 er{k} AS (SELECT recording_id, 'AUDIO_GAP' AS kind, start_sec, end_sec, 1 - c AS severity, CAST(NULL AS VARCHAR) AS note_id FROM cg{k} WHERE c < 0.9 UNION ALL SELECT recording_id, 'MIDI_OVERHANG', start_sec, end_sec, 1 - c, note_id FROM co{k} WHERE c < 0.85
  UNION ALL SELECT recording_id, 'MICRO_GAP', start_sec, end_sec, least(1.0, g / 0.06), note_id FROM mgp{k} UNION ALL SELECT n.recording_id, 'PITCH_MISMATCH', n.start_sec, n.end_sec, 0.6, n.note_id FROM {n} n JOIN dp{k} USING (recording_id, note_id) WHERE abs(n.pitch_midi - expected) > 1)"""


def _score(n: str, k: str = "") -> str:
    return f""", sa{k} AS (SELECT recording_id, sum(l) AS audio, sum(o) AS both_ FROM (SELECT a.recording_id, a.end_sec - a.start_sec AS l, coalesce(sum({_OV.format(a='a', b='m')}) FILTER (m.start_sec IS NOT NULL), 0.0) AS o FROM au{k} a LEFT JOIN mi{k} m ON m.recording_id = a.recording_id AND m.end_sec > a.start_sec AND m.start_sec < a.end_sec GROUP BY a.recording_id, a.start_sec, a.end_sec) GROUP BY 1),
 sm{k} AS (SELECT recording_id, sum(end_sec - start_sec) AS midi FROM mi{k} GROUP BY 1), se{k} AS (SELECT recording_id, count(*) AS errors, count(*) FILTER (kind = 'MICRO_GAP') AS micro FROM er{k} GROUP BY 1), sp{k} AS (SELECT n.recording_id, avg(CASE WHEN abs(n.pitch_midi - expected) <= 1 THEN 1.0 ELSE 0.0 END) AS pitch FROM {n} n JOIN dp{k} USING (recording_id, note_id) GROUP BY 1),
 sc{k} AS (SELECT recording_id, CASE WHEN coalesce(audio, 0) <= 1e-9 THEN 1.0 ELSE least(1.0, greatest(0.0, both_ / audio)) END AS coverage, 1 - CASE WHEN coalesce(midi, 0) <= 1e-9 THEN 0.0 ELSE least(1.0, greatest(0.0, midi - coalesce(both_, 0)) / midi) END AS overhang,
  greatest(0.0, 1 - least(1.0, coalesce(micro, 0) * 0.06)) AS continuity, coalesce(pitch, 0.9) AS pitch_consistency, coalesce(errors, 0) AS errors FROM sa{k} FULL JOIN sm{k} USING (recording_id) LEFT JOIN se{k} USING (recording_id) LEFT JOIN sp{k} USING (recording_id))"""


@query("a12_error_regions_whole", sql(_ACTIVE + _errors("notes") + f" SELECT recording_id, kind, {_TIMES}, round(severity, 9) AS severity, note_id FROM er", *_views()))
def a12(t: Tables) -> DataFrame:
    """All four kinds, overhang by note, with severities."""
    notes, regions, _, pitch = _inputs(t)
    return _rounded(R.error_regions(notes, regions, pitch), "start_sec", "end_sec", "severity")


_TOTAL = "SELECT recording_id, round(coverage, 9) AS coverage, round(overhang, 9) AS overhang, round(continuity, 9) AS continuity, round(pitch_consistency, 9) AS pitch_consistency, errors, round(0.35 * coverage + 0.20 * overhang + 0.30 * continuity + 0.15 * pitch_consistency, 9) AS total FROM"


@query("a11_x12_candidate_score", sql(_ACTIVE + _errors("notes") + _score("notes") + f" {_TOTAL} sc", *_views()))
def a11(t: Tables) -> DataFrame:
    notes, regions, _, pitch = _inputs(t)
    return _rounded(R.score(notes, regions, pitch), "coverage", "overhang", "continuity", "pitch_consistency", "total")


@query("a13_iteration_summary", sql(_M5 + _errors("notes", "b") + _score("notes", "b") + _errors("n5", "a") + _score("n5", "a") + """, tb AS (SELECT recording_id, 0.35 * coverage + 0.20 * overhang + 0.30 * continuity + 0.15 * pitch_consistency AS total FROM scb), ta AS (SELECT recording_id, errors, 0.35 * coverage + 0.20 * overhang + 0.30 * continuity + 0.15 * pitch_consistency AS total FROM sca),
 n_in AS (SELECT recording_id, count(*) AS input_notes FROM notes GROUP BY 1), n_out AS (SELECT recording_id, count(*) AS output_notes, count(*) FILTER (phase_1 = 'EXTENDED') AS extended, count(*) FILTER (phase_1 = 'INSERTED') AS inserted, count(*) FILTER (phase_2 = 'SHORTENED') AS shortened, count(*) FILTER (phase_2 LIKE '%PROTECTED') AS protected, count(*) FILTER (phase_5) AS gaps_closed FROM n5 GROUP BY 1)
 SELECT recording_id, input_notes, output_notes, extended, inserted, shortened, protected, gaps_closed, errors, round(tb.total, 9) AS score_before, round(ta.total, 9) AS score_after, round(ta.total, 9) > round(tb.total, 9) AS accepted FROM n_in JOIN n_out USING (recording_id) JOIN tb USING (recording_id) JOIN ta USING (recording_id)""", *_views()))
def a13(t: Tables) -> DataFrame:
    """What one pass did to each recording and whether its score rose."""
    notes, regions, frames, pitch = _inputs(t)
    out = R.staged(R.repair(notes, regions, frames, pitch, P))
    n = out.groupBy(*REC).agg(
        F.count(F.lit(1)).alias("output_notes"), F.count_if(F.col("phase_1") == "EXTENDED").alias("extended"), F.count_if(F.col("phase_1") == "INSERTED").alias("inserted"),
        F.count_if(F.col("phase_2") == "SHORTENED").alias("shortened"), F.count_if(F.col("phase_2").endswith("PROTECTED")).alias("protected"), F.count_if("phase_5").alias("gaps_closed"),
    )
    before = R.score(notes, regions, pitch).select(*REC, F.round("total", 9).alias("score_before"))
    after = R.score(out, regions, pitch).select(*REC, "errors", F.round("total", 9).alias("score_after"))
    j = notes.groupBy(*REC).agg(F.count(F.lit(1)).alias("input_notes")).join(n, REC).join(before, REC).join(after, REC)
    return j.withColumn("accepted", F.col("score_after") > F.col("score_before"))


_CHANGES = """, ch AS (SELECT a.recording_id, a.note_id, a.start_sec, a.end_sec, b.start_sec AS os, b.end_sec AS oe, CASE WHEN b.note_id IS NULL THEN 'NEW' WHEN round_even(a.start_sec * 1000, 0) = round_even(b.start_sec * 1000, 0) AND round_even(a.end_sec * 1000, 0) = round_even(b.end_sec * 1000, 0) THEN 'SAME' ELSE 'CHANGED' END AS kind FROM n5 a LEFT JOIN notes b ON b.recording_id = a.recording_id AND b.note_id = a.note_id)"""


@query("u11_f22_change_tags", sql(_M5 + _CHANGES + " SELECT recording_id, note_id, kind, CAST(round_even(start_sec * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(end_sec * 1000, 0) AS BIGINT) AS end_ms FROM ch", *_views()))
def u11(t: Tables) -> DataFrame:
    notes, regions, frames, pitch = _inputs(t)
    c = R.changes(notes, R.repair(notes, regions, frames, pitch, P))
    return c.select(*REC, "note_id", "kind", R.fingerprint(F.col("start_sec"), F.col("end_sec")).alias("f")).select(*REC, "note_id", "kind", "f.*")


@query("u10_restrict_to_errors", sql(_M5 + _CHANGES + _errors("notes", "b") + f""", pe AS (SELECT * FROM erb WHERE round(severity, 9) >= 0.2), ot AS (SELECT *, recording_id IN (SELECT recording_id FROM pe) AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.recording_id = ch.recording_id AND pe.end_sec > ch.start_sec AND pe.start_sec < ch.end_sec) AS outside FROM ch)
 SELECT recording_id, note_id, round(CASE WHEN outside AND kind = 'CHANGED' THEN os ELSE start_sec END, 9) AS start_sec, round(CASE WHEN outside AND kind = 'CHANGED' THEN oe ELSE end_sec END, 9) AS end_sec FROM ot WHERE NOT (outside AND kind = 'NEW')""", *_views()))
def u10(t: Tables) -> DataFrame:
    notes, regions, frames, pitch = _inputs(t)
    out = R.restrict(notes, R.repair(notes, regions, frames, pitch, P), R.error_regions(notes, regions, pitch))
    return _rounded(out, "start_sec", "end_sec").select(*REC, "note_id", "start_sec", "end_sec")


_STABLE = _M5 + _CHANGES + _errors("n5", "a") + """, st AS (SELECT recording_id, note_id FROM ch WHERE kind <> 'NEW' AND abs(round_even(start_sec * 1000, 0) - round_even(os * 1000, 0)) <= 20 AND abs(round_even(end_sec * 1000, 0) - round_even(oe * 1000, 0)) <= 20
 AND NOT EXISTS (SELECT 1 FROM era e WHERE e.recording_id = ch.recording_id AND (e.note_id = ch.note_id OR (e.note_id IS NULL AND e.end_sec > ch.start_sec AND e.start_sec < ch.end_sec))))"""


def _stable(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    notes, regions, frames, pitch = _inputs(t)
    out = R.staged(R.repair(notes, regions, frames, pitch, P))
    return notes, out, R.stable_notes(notes, out, R.error_regions(out, regions, pitch))


@query("w37_stable_notes", sql(_STABLE + " SELECT recording_id, note_id FROM st", *_views()))
def w37(t: Tables) -> DataFrame:
    return _stable(t)[2]


@query("u9_freeze_stable", sql(_STABLE + " SELECT ch.recording_id, ch.note_id, round(CASE WHEN st.note_id IS NOT NULL THEN os ELSE start_sec END, 9) AS start_sec, round(CASE WHEN st.note_id IS NOT NULL THEN oe ELSE end_sec END, 9) AS end_sec, st.note_id IS NOT NULL AS frozen FROM ch LEFT JOIN st ON st.recording_id = ch.recording_id AND st.note_id = ch.note_id", *_views()))
def u9(t: Tables) -> DataFrame:
    return _rounded(R.freeze(*_stable(t)), "start_sec", "end_sec").select(*REC, "note_id", "start_sec", "end_sec", "frozen")


@query("p14_x11_profiles", """SELECT CAST(i AS INTEGER) AS iteration, name AS profile, missing_min, overhang_min, close_gap, insert_confidence, split_confidence, split_pitch FROM (VALUES
 (1, 'balanced', 0.08, 0.22, 0.05, 0.8, 0.75, 0.75), (2, 'sustain_legato', 0.08, 0.26, 0.06, 0.84, 0.82, 0.9), (3, 'conservative', 0.09, 0.32, 0.055, 0.95, 0.95, 1.4)) AS v(i, name, missing_min, overhang_min, close_gap, insert_confidence, split_confidence, split_pitch)""")
def p14(t: Tables) -> DataFrame:
    rows = []
    for i in (1, 2, 3):
        p = R.profile(R.pass_profile(i), R.Repair())
        rows.append((i, R.pass_profile(i), p.missing_min, p.overhang_min, p.close_gap, *[round(x, 9) for x in (p.insert_confidence, p.split_confidence, p.split_pitch)]))
    return t.spark.createDataFrame(rows, "iteration int, profile string, missing_min double, overhang_min double, close_gap double, insert_confidence double, split_confidence double, split_pitch double")


@query("m6_iterative_repair")
def m6(t: Tables) -> DataFrame:
    """Notes after three passes; a test holds scores and stops against what the summary says."""
    return _rounded(R.iterate(*_inputs(t), P)[0], "start_sec", "end_sec")
