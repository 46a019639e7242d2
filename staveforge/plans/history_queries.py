"""Undo and redo (D12) on the notes of events: a recording is a session, its events in time the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.operators import history as H
from staveforge.sources.adapters import Tables

from .registry import query

REC = ["recording_id"]


def log(t: Tables) -> DataFrame:
    """Every event is an entry: a refund or signup takes back, a click with an odd value brings back, all others edit the note of their user."""
    e = t.base_events
    no = F.row_number().over(Window.partitionBy(*REC).orderBy("us", "event_id")).cast("long")
    kind = F.when(F.col("k") % 5 == 0, "undo").when(F.col("k") % 5 == 1, "redo").otherwise("edit")
    return e.select(*REC, no.alias("entry"), kind.alias("kind"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("note_id"), (F.col("k") % 7 == 3).alias("gone"), F.col("k").alias("pitch_midi"), (F.col("us") / F.lit(1e9)).alias("start_sec"))


def base(t: Tables) -> DataFrame:
    """Fifty notes of every recording, from its users."""
    u = t.base_events.select(*REC, F.concat(F.lit("u"), F.col("user_id") % 50).alias("note_id")).distinct()
    return u.select(*REC, "note_id", F.lit(60).alias("pitch_midi"), F.lit(0.0).alias("start_sec"))


@query("d12_undo_redo")
def d12(t: Tables) -> DataFrame:
    """The edit that every entry carries out, takes back or brings back."""
    return H.resolve(log(t).select(*REC, "entry", "kind"), REC)


@query("d12_notes_after")
def d12_notes(t: Tables) -> DataFrame:
    """The notes of every session after its whole log."""
    entries = log(t)
    live = H.live_edits(H.resolve(entries.select(*REC, "entry", "kind"), REC), REC)
    changes = entries.where("kind = 'edit'").withColumnRenamed("entry", "edit").drop("kind")
    return H.notes_at(base(t), changes, live, REC)
