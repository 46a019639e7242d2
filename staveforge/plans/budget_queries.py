"""Request budgets (T10, X53, M20's limits) on the notes, runs and tone sections of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.operators import budget as B
from staveforge.operators import pack as K
from staveforge.sources.adapters import Tables

from .pack_queries import _runs, _sections_sql, _tones, _TONES
from .registry import query, sql

REC = ["recording_id"]
NOTES, SECTIONS = 180, 24


@query("t10_note_budget")
def t10(t: Tables) -> DataFrame:
    """The notes that a request keeps, with their worth; recordings of no more than the limit keep all."""
    out = B.select_notes(t.notes.select(*REC, "note_id", "start_sec", "end_sec"), _runs(t), K.pitch_changes(_tones(t), max(8, NOTES // 8)), NOTES)
    return out.select(*REC, "note_id", "index", "worth")


@query("x53_pitch_section_budget", sql(_sections_sql(1.0, 60) + _TONES + f""", ix AS (SELECT recording_id, start_sec, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec) - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM tones),
 pk AS (SELECT DISTINCT recording_id, CAST(round_even(k / CAST({SECTIONS - 1} AS DOUBLE) * (n - 1), 0) AS BIGINT) AS i FROM ix, range({SECTIONS}) r(k) WHERE n > {SECTIONS})
 SELECT ix.recording_id, round(start_sec, 6) AS start_sec, ix.i AS index FROM ix LEFT JOIN pk ON pk.recording_id = ix.recording_id AND pk.i = ix.i WHERE n <= {SECTIONS} OR pk.i IS NOT NULL""", "frames", "pitch_frames"))
def x53(t: Tables) -> DataFrame:
    rows = B.indexed(_tones(t), ["start_sec"])
    return B.even(rows, SECTIONS).select(*REC, F.round("start_sec", 6).alias("start_sec"), "index")
