"""Pattern completion on the phrase tables (M11 to M17, A22, A38, P24, P25, P34, W35, W36, X45 to X48); notes of lineitem on bars of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.operators import completion as C
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import staged_by

from .registry import query, sql

REC = ["recording_id"]

_PLACED = """, pl AS (SELECT p.*, greatest(1, beats_per_bar) AS beats, beat_sec, CAST(floor((start_beat + 1e-9) / beats_per_bar) AS INTEGER) AS bar FROM phrases p JOIN phrase_timing t USING (recording_id)),
 pg AS (SELECT *, CAST(greatest(0, least(beats * 16 - 1, round_even(greatest(0.0, start_beat - bar * beats) * 16, 0))) AS INTEGER) AS slot, CAST(greatest(1, round_even(greatest(1e-6, end_beat - start_beat) * 16, 0)) AS INTEGER) AS len FROM pl),
 mono AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, bar, slot ORDER BY pitch_midi, len DESC, velocity DESC, start_beat, end_beat, start_sec, note_id) AS v FROM pg) WHERE v = 1),
 cnt AS (SELECT recording_id, bar, CAST(count(*) AS INTEGER) AS n FROM pg GROUP BY ALL),
 voice AS (SELECT recording_id, bar, list(slot ORDER BY slot) AS slots, list(len ORDER BY slot) AS lens, list(pitch_midi ORDER BY slot) AS pitches FROM mono GROUP BY ALL),
 lastbar AS (SELECT recording_id, max(end_beat) AS e, any_value(beats) AS beats FROM pg GROUP BY 1), every AS (SELECT recording_id, beats, CAST(unnest(range(0, CAST(ceil(e / beats) AS BIGINT))) AS INTEGER) AS bar FROM lastbar),
 bars AS (SELECT recording_id, bar, coalesce(n, 0) AS n, coalesce(slots, []) AS slots, coalesce(lens, []) AS lens, coalesce(pitches, []) AS pitches FROM every LEFT JOIN cnt USING (recording_id, bar) LEFT JOIN voice USING (recording_id, bar))"""
_FAMILIES = _PLACED + """, hist AS (SELECT recording_id, n, count(*) AS c FROM bars WHERE n > 0 GROUP BY ALL), usual AS (SELECT recording_id, n AS usual FROM hist QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, n DESC) = 1),
 able AS (SELECT bars.* FROM bars JOIN usual USING (recording_id) WHERE n >= greatest(2, usual)), fam0 AS (SELECT recording_id, slots, lens, pitches, CAST(count(*) AS INTEGER) AS size, min(bar) AS first_bar FROM able GROUP BY ALL),
 fam1 AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY size DESC, first_bar) AS no FROM fam0), fams AS (SELECT *, CASE WHEN no <= 26 THEN 'pattern_' || chr(CAST(no + 64 AS INTEGER)) ELSE printf('pattern_%03d', no) END AS family_id FROM fam1)"""


def _bars(t: Tables) -> DataFrame:
    return C.bars(C.on_bars(t.phrases, t.phrase_timing))


@query("m12_tempo_bars", sql(_PLACED + " SELECT recording_id, bar, n, array_to_string(slots, ',') AS slots, array_to_string(lens, ',') AS lens, array_to_string(pitches, ',') AS pitches FROM bars", "phrases"))
def m12(t: Tables) -> DataFrame:
    """Bars by tempo and meter, 16 slots a beat, in one voice."""
    return _bars(t).select(*REC, "bar", "n", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("slots", "lens", "pitches")])


@query("p34_phrase_thresholds", sql(", m AS (SELECT recording_id, median(greatest(1e-6, end_sec - start_sec)) AS d, CAST(round_even(median(velocity), 0) AS INTEGER) AS v FROM phrases GROUP BY 1) SELECT recording_id, round(greatest(0.10, least(0.15, d * 0.45)), 6) AS min_duration, CAST(greatest(35, round_even(v * 0.45, 0)) AS INTEGER) AS min_velocity, v AS median_velocity FROM m", "phrases"))
def p34(t: Tables) -> DataFrame:
    return C.local_thresholds(t.phrases)


@query("a22_bar_families", sql(_FAMILIES + " SELECT recording_id, family_id, size, first_bar, array_to_string(pitches, ',') AS pitches FROM fams", "phrases"))
def a22(t: Tables) -> DataFrame:
    """Families of whole bars, with the exemplar's bar."""
    return C.families(_bars(t)).select(*REC, "family_id", "size", "first_bar", F.array_join(F.col("pitches").cast("array<string>"), ",").alias("pitches"))


@query("a38_due_bars", sql(_FAMILIES + """, occ AS (SELECT able.recording_id, family_id, size, fams.slots AS due, bar FROM able JOIN fams USING (recording_id, slots, lens, pitches) WHERE size > 1),
 og AS (SELECT *, lag(bar) OVER (PARTITION BY recording_id, family_id ORDER BY bar) AS bf FROM occ), gp AS (SELECT *, bar - bf AS gap FROM og WHERE bf IS NOT NULL),
 st AS (SELECT *, greatest(1.0, median(gap) OVER w) AS per, stddev_pop(gap) OVER w AS va FROM gp WINDOW w AS (PARTITION BY recording_id, family_id)),
 ok AS (SELECT *, greatest(1, CAST(floor(len(due) * 0.35) AS INTEGER)) AS sparse, greatest(0.0, least(1.0, 1 - va / greatest(1.0, per))) AS steady FROM st WHERE gap > 1 AND abs(gap - greatest(1, round_even(gap / per, 0)) * per) <= greatest(1.0, per * 0.35)),
 mb AS (SELECT ok.*, CAST(unnest(range(bf + 1, ok.bar)) AS INTEGER) AS mbar FROM ok), mc AS (SELECT mb.recording_id, mbar, family_id, size, due, sparse, steady, gap, per, bars.n, len(list_filter(due, lambda x: NOT list_contains(bars.slots, x))) AS miss FROM mb JOIN bars ON bars.recording_id = mb.recording_id AND bars.bar = mbar WHERE bars.n <= sparse)
 SELECT recording_id, mbar AS bar, family_id, CAST(miss AS INTEGER) AS missing, round(greatest(0.0, least(1.0, 0.45 + 0.20 * least(1.0, size / 4.0) + 0.15 * steady + 0.15 * (miss / CAST(greatest(1, len(due)) AS DOUBLE)) + 0.10 * (1.0 - least(1.0, n / CAST(sparse + 1 AS DOUBLE)))
   + 0.10 * least(1.0, CAST(greatest(0, gap - 1) AS DOUBLE) / greatest(1.0, per)) + CASE WHEN n = 0 THEN 0.10 ELSE 0.0 END)), 6) AS score FROM mc WHERE miss >= greatest(1, ceil(len(due) * 0.5))""", "phrases"))
def a38(t: Tables) -> DataFrame:
    """Sparse bars in which a family is due."""
    b = staged_by(_bars(t), REC)
    return C.missing_expected(b, C.families(b)).select(*REC, "bar", "family_id", F.size("missing").alias("missing"), "score")


@query("m13_bar_status")
def m13(t: Tables) -> DataFrame:
    """Every bar as complete, incomplete, unknown or empty, with its family."""
    return C.Completion(t.phrases, t.phrase_timing).status


@query("m14_m15_incomplete_bars")
def m14(t: Tables) -> DataFrame:
    """A report of every incomplete bar: family, score, reason, confidence, notes proposed and accepted."""
    return C.Completion(t.phrases, t.phrase_timing).incomplete


@query("m16_m17_missing_bars")
def m16(t: Tables) -> DataFrame:
    """A report of every bar in which a family is due."""
    return C.Completion(t.phrases, t.phrase_timing).missing


@query("p24_p25_proposals")
def p24(t: Tables) -> DataFrame:
    """Every proposed note with the first rule that it breaks, or null."""
    return C.Completion(t.phrases, t.phrase_timing).checked


@query("w36_inserted_notes")
def w36(t: Tables) -> DataFrame:
    """The accepted notes without repeats and in one voice."""
    return C.Completion(t.phrases, t.phrase_timing).inserted


@query("m11_pattern_completion")
def m11(t: Tables) -> DataFrame:
    """The whole pass: counts by recording."""
    return C.summary(C.Completion(t.phrases, t.phrase_timing))
