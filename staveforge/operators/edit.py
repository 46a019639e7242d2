"""Edits of note tables: every edit is a keyed update, a union or an anti-join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .windows import by_bucket

REC = ["recording_id"]


def update(notes: DataFrame, chosen: Column, values: dict[str, Column]) -> DataFrame:
    return notes.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in values.items()})


def lowest_free_track(notes: DataFrame, limit: int) -> DataFrame:
    """(recording_id, free_track); recordings with all tracks in use have no row."""
    every = notes.select(*REC).distinct().withColumn("track_index", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    return every.join(notes.select(*REC, "track_index").distinct(), [*REC, "track_index"], "left_anti").groupBy(*REC).agg(F.min("track_index").alias("free_track"))


def merge_tracks(notes: DataFrame, tracks: list[int]) -> DataFrame:
    """D4."""
    return update(notes, F.col("track_index").isin(tracks), {"track_index": F.lit(min(tracks))})


def move_group(notes: DataFrame, chosen: Column, ticks: int, pitch: int) -> DataFrame:
    """The whole selection of a recording moves by one step, as far as its first tick and its outer pitches allow."""
    sel = notes.where(chosen).groupBy(*REC).agg(F.min("start_tick").alias("__a"), F.min("pitch_midi").alias("__lo"), F.max("pitch_midi").alias("__hi"))
    n = notes.join(sel, REC, "left")
    dt = F.greatest(F.lit(ticks), -F.col("__a"))
    dp = F.greatest(F.least(F.lit(pitch), 127 - F.col("__hi")), -F.col("__lo"))
    return update(n, chosen, {"start_tick": F.col("start_tick") + dt, "end_tick": F.col("end_tick") + dt, "pitch_midi": (F.col("pitch_midi") + dp).cast("int")}).drop("__a", "__lo", "__hi")


def resize_right(notes: DataFrame, chosen: Column, target: Column, least: int) -> DataFrame:
    """The right edge, never nearer to the start than least."""
    n = update(notes, chosen, {"end_tick": target})
    return n.withColumn("end_tick", F.greatest("end_tick", F.col("start_tick") + least))


def draw(notes: DataFrame, start: int, end: int) -> DataFrame:
    """One new note a recording; a reversed range is turned. Ids go on from the highest drawn one."""
    a, b = min(start, end), max(start, end)
    no = F.coalesce(F.max(F.regexp_extract("note_id", r"^drawn_(\d{6})$", 1).try_cast("int")), F.lit(0)) + 1
    new = notes.groupBy(*REC).agg(F.format_string("drawn_%06d", no).alias("note_id")).withColumns({"start_tick": F.lit(a).cast("long"), "end_tick": F.lit(max(b, a + 1)).cast("long")})
    return notes.unionByName(new)


def merge_notes(chosen: DataFrame, by: list[str]) -> DataFrame:
    """Notes of one pitch, track and channel become one span under the first note's id; single notes have no row."""
    g = chosen.groupBy(*by).agg(F.min_by("note_id", F.struct("start_tick", "note_id")).alias("first"), F.min("start_tick").alias("start_tick"), F.max("end_tick").alias("end_tick"), F.count(F.lit(1)).alias("merged"))
    return g.where("merged >= 2").select(*by, F.concat("first", F.lit("_merged")).alias("note_id"), "start_tick", "end_tick", "merged")


def toggle_mute(notes: DataFrame, chosen: Column) -> DataFrame:
    """If all of a recording's selection is muted it is unmuted, else it is muted."""
    every = notes.where(chosen).groupBy(*REC).agg(F.every("muted").alias("__all"))
    return update(notes.join(every, REC, "left"), chosen, {"muted": ~F.col("__all")}).drop("__all")


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of base with the same keys; the others are added."""
    return base.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def loop(chosen: DataFrame, copies: int) -> DataFrame:
    """Copies 1..n of a recording's selection, each later by the selection's length (at least 1)."""
    if not 1 <= copies <= 64:
        raise ValueError("copies must be in 1..64")
    length = chosen.groupBy(*REC).agg(F.greatest(F.max("end_tick") - F.min("start_tick"), F.lit(1)).alias("__len"))
    c = chosen.join(length, REC).withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    move = F.col("__i") * F.col("__len")
    return c.withColumns({"start_tick": F.col("start_tick") + move, "end_tick": F.col("end_tick") + move, "note_id": F.concat("note_id", F.lit("_c"), F.col("__i").cast("string"))}).drop("__i", "__len")


def cap_changes(old: DataFrame, new: DataFrame, keys: list[str], col: str, by: list[str], limit: int) -> DataFrame:
    """Of the rows that changed, the limit largest changes of each by stay (ties: the lower key); the others are reverted."""
    o = old.select(*keys, F.col(col).alias("__old"))
    n = new.join(o, keys, "left").withColumn("__m", F.abs(F.col(col) - F.coalesce("__old", F.col(col))))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__m").desc(), *keys))
    return n.withColumn("__r", rank).withColumn(col, F.when((F.col("__m") > 0) & (F.col("__r") > limit), F.col("__old")).otherwise(F.col(col))).drop("__old", "__m", "__r")


def strongest(action: Column) -> Column:
    """The highest action of a group."""
    rank = F.when(action == "KEEP", 4).when(action == "REVIEW", 3).when(action == "MUTE", 2).otherwise(1)
    return F.max_by(action, rank)


def bar_beat(df: DataFrame, signatures: DataFrame, ticks_per_beat: int) -> DataFrame:
    """Bar and beat, from 1, under time signatures (tick, numerator, denominator); a new signature starts a new bar.

    signatures is a small table of one piece: its rows are numbered in one window and broadcast.
    """
    beat = F.lit(4 * ticks_per_beat) / F.col("denominator")
    w = Window.orderBy("tick")
    s = signatures.withColumns({"__beat": beat.cast("long"), "__bar": (beat * F.col("numerator")).cast("long"), "__next": F.lead("tick").over(w)})
    bars = F.ceil((F.lag("__next").over(w) - F.lag("tick").over(w)) / F.lag("__bar").over(w))
    s = s.withColumn("__d", F.coalesce(bars, F.lit(0))).withColumn("__first", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = df.join(F.broadcast(s.withColumnRenamed("tick", "__tick")), (F.col("start_tick") >= F.col("__tick")) & (F.col("__next").isNull() | (F.col("start_tick") < F.col("__next"))))
    at = F.col("start_tick") - F.col("__tick")
    return j.withColumns({"bar": (F.col("__first") + F.floor(at / F.col("__bar")) + 1).cast("long"), "beat": (F.floor((at % F.col("__bar")) / F.col("__beat")) + 1).cast("long")}).select(*df.columns, "bar", "beat")


def first_clash(notes: DataFrame, base: DataFrame, near: float = 0.02, share: float = 0.65, width: float = 4.0) -> DataFrame:
    """(recording_id, note_id, reason) of notes that the base repeats or covers, by the first base note, by start and id, that does.

    duplicate: the pitches are equal and the starts at most near apart; collision: at least share of the shorter note is
    shared. Both need an overlap. A note looks at the base notes around it in order, some at a time, until one clashes.
    """

    def run(n: pd.DataFrame, f: pd.DataFrame, bucket: int) -> pd.DataFrame:
        f = f.sort_values(["start_sec", "note_id"])
        s, e, p = (f[c].to_numpy() for c in ("start_sec", "end_sec", "pitch_midi"))
        t0, t1, q = (n[c].to_numpy() for c in ("start_sec", "end_sec", "pitch_midi"))
        at, stop = np.searchsorted(s, t0 - (e - s).max() - 1e-6), np.searchsorted(s, t1)
        hit, twin, row, block = np.full(len(n), -1), np.zeros(len(n), bool), np.flatnonzero(at < stop), np.arange(16)
        while len(row):
            j = at[row][:, None] + block
            inside, j = j < stop[row][:, None], np.minimum(j, len(f) - 1)
            a, b = t0[row][:, None], t1[row][:, None]
            inside &= (e[j] > a) & (s[j] < b)
            same = inside & (p[j] == q[row][:, None]) & (np.abs(a - s[j]) <= near)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = same | (inside & ((np.minimum(b, e[j]) - np.maximum(a, s[j])) / np.minimum(b - a, e[j] - s[j]) >= share))
            k, some = found.argmax(axis=1), found.any(axis=1)
            hit[row[some]], twin[row[some]] = j[some, k[some]], same[some, k[some]]
            at[row] += len(block)
            row = row[~some & (at[row] < stop[row])]
        i = np.flatnonzero(hit >= 0)
        return pd.DataFrame({"note_id": n["note_id"].to_numpy()[i], "s": s[hit[i]], "id": f["note_id"].to_numpy()[hit[i]], "reason": np.where(twin[i], "duplicate", "collision")})

    cols = ["recording_id", "note_id", "pitch_midi", "start_sec", "end_sec"]
    part = by_bucket(notes.select(*cols), base.select(*cols), ["recording_id"], run, "note_id string, s double, id string, reason string", width)
    return part.groupBy("recording_id", "note_id").agg(F.min_by("reason", F.struct("s", "id")).alias("reason"))
