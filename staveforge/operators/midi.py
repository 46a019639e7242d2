"""Event-table algebra of MIDI: pairing, tempo maps, serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .timejoin import asof_join


def tempo_seconds(tempo: DataFrame, ticks_per_beat: int, by: list[str] | None = None) -> DataFrame:
    """(by, tick, tempo, sec): the last tempo of a tick wins, tick 0 is 500000 unless given, seconds add up."""
    by = by or []
    t = tempo.groupBy(*by, "tick").agg(F.max_by("tempo", F.col("ord") if "ord" in tempo.columns else F.col("tempo")).alias("tempo"))
    keys = t.select(*by).distinct() if by else tempo.sparkSession.range(1).select()
    zero = keys.withColumns({"tick": F.lit(0).cast("long"), "tempo": F.lit(500_000)}).join(t.where("tick = 0").select(*by).distinct() if by else t.where("tick = 0").limit(1).select("tick"), by if by else "tick", "left_anti")
    w = Window.partitionBy(*by).orderBy("tick") if by else Window.partitionBy(F.lit(0)).orderBy("tick")  # one row a tempo change
    t = t.unionByName(zero)
    step = (F.col("tick") - F.lag("tick").over(w)) * F.lag("tempo").over(w) / F.lit(ticks_per_beat * 1e6)
    return t.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("sec", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def tick_to_seconds(df: DataFrame, tick: str, tempo: DataFrame, ticks_per_beat: int, by: list[str], out: str) -> DataFrame:
    """Seconds of a tick under tempo_seconds(): the last change at or before it."""
    m = tempo.select(*by, F.col("tick").alias(tick), F.col("tick").alias("__t"), F.col("tempo").alias("__m"), F.col("sec").alias("__s"))
    j = asof_join(df, m, by, tick, ["__t", "__m", "__s"])
    return j.withColumn(out, F.col("__s") + (F.col(tick) - F.col("__t")) * F.col("__m") / F.lit(ticks_per_beat * 1e6)).drop("__t", "__m", "__s")


def seconds_to_tick(df: DataFrame, sec: str, tempo: DataFrame, ticks_per_beat: int, by: list[str], out: str) -> DataFrame:
    """The tick, half to even, at least 0."""
    m = tempo.select(*by, F.col("sec").alias(sec), F.col("tick").alias("__t"), F.col("tempo").alias("__m"), F.col("sec").alias("__s"))
    j = asof_join(df, m, by, sec, ["__t", "__m", "__s"])
    return j.withColumn(out, F.greatest(F.lit(0), F.rint(F.col("__t") + (F.col(sec) - F.col("__s")) * (ticks_per_beat * 1e6) / F.col("__m")).cast("long"))).drop("__t", "__m", "__s")


def pair_notes(msgs: DataFrame, by: list[str], order: list[str], on: str = "is_on") -> DataFrame:
    """First-in first-out pairs (by, on_ord, off_ord) of note-ons and note-offs; msgs has ord, a total order.

    An off without an open on is passed over; that is a queue depth that stops at zero: depth = running sum minus the
    least running sum so far (or 0). Ons that never close have no row.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(on), 1).otherwise(-1)
    m = msgs.withColumn("__sum", F.sum(step).over(w))
    floor = F.least(F.lit(0), F.min("__sum").over(w))
    m = m.withColumn("__floor", floor).withColumn("__was", F.coalesce(F.lag("__floor").over(Window.partitionBy(*by).orderBy(*order)), F.lit(0)))
    m = m.where(F.col(on) | (F.col("__floor") == F.col("__was")))  # an off that lowers the floor found no open note
    n = m.withColumn("__n", F.row_number().over(Window.partitionBy(*by, on).orderBy(*order)))
    a = n.where(F.col(on)).select(*by, "__n", F.col("ord").alias("on_ord"))
    b = n.where(~F.col(on)).select(*by, "__n", F.col("ord").alias("off_ord"))
    return a.join(b, [*by, "__n"]).drop("__n")


def note_events(notes: DataFrame, keep: list[str]) -> DataFrame:
    """On and off rows of each note (event_tick, event_order: 0 off, 1 on); a missing channel is 0, an end before the start is the start."""
    end = F.greatest("end_tick", "start_tick")
    pair = F.array(F.struct(F.col("start_tick").alias("event_tick"), F.lit(1).alias("event_order")), F.struct(end.alias("event_tick"), F.lit(0).alias("event_order")))
    return notes.select(*keep, F.coalesce("channel", F.lit(0)).alias("channel"), F.explode(pair).alias("__e")).select(*keep, "channel", "__e.*")


def delta_encode(events: DataFrame, by: list[str], order: list[str], out: str = "delta") -> DataFrame:
    """Ticks since the event before, in offs-before-ons order."""
    w = Window.partitionBy(*by).orderBy("event_tick", "event_order", *order)
    return events.withColumn(out, F.col("event_tick") - F.lag("event_tick", 1, 0).over(w))


def absolute(events: DataFrame, by: list[str], order: str, delta: str = "delta", out: str = "tick") -> DataFrame:
    """X37."""
    return events.withColumn(out, F.sum(delta).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def message_priority(kind: Column) -> Column:
    """T3."""
    return F.when(kind == "meta_tempo", 1).when(kind == "meta", 2).when(kind == "control", 3).when(kind == "note_off", 4).otherwise(5)
