"""Every registered query of the engine, by the inventory id it answers."""

from __future__ import annotations

from . import admission_queries, budget_queries, chain_queries, completion_queries, drum_queries, dsp_queries, edit_queries, frame_queries, history_queries, midi_queries, note_queries, pack_queries, pattern_queries, repair_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
