"""Band envelopes of onset strength and picked onsets from chunks of samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .drums import keep_spaced, peaks

# Bands of the envelopes in Hz, from the first to below the second; full takes all.
BANDS: dict[str, tuple[float, float]] = {
    "full": (0.0, float("inf")),
    "low": (20.0, 180.0),
    "mid": (180.0, 3000.0),
    "upper": (3500.0, 9000.0),
    "high": (5000.0, 12000.0),
    "kick": (30.0, 180.0),
    "snare": (180.0, 9000.0),
    "hat": (5000.0, 12000.0),
    "cymbal": (4500.0, 12000.0),
    "tom": (120.0, 2200.0),
}

#: Frames in a task's segment.
SEGMENT = 256


def placed(chunks: DataFrame, by: list[str]) -> DataFrame:
    """chunks (by, chunk, samples) with first, the number of the chunk's first sample, and total, the signal's length; only lengths are ordered by signal."""
    n = chunks.select(*by, "chunk", F.size("samples").cast("long").alias("n"))
    w = Window.partitionBy(*by).orderBy("chunk")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = n.select(*by, "chunk", before.alias("first"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    return chunks.join(at, [*by, "chunk"])


def band_flux(chunks: DataFrame, by: list[str], rate: float, size: int = 1024, hop: int = 256, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(by, band, frame_index, raw): the sum over a band of what each bin's magnitude gains on the frame before; 0 for the first frame.

    Frames of size samples in a periodic Hann window, hop apart, the last the first to reach the end, padded with zeros.
    A segment of SEGMENT frames is one task's unit, with the chunks that it touches and those of the frame before; a long
    signal is many segments. Signals of no samples have no frames.
    """
    ranges = bands or BANDS
    keys = T.StructType([chunks.schema[c] for c in by])
    c = placed(chunks.where(F.size("samples") > 0), by)
    frames = F.when(F.col("total") <= size, 1).otherwise(F.ceil((F.col("total") - size) / hop).cast("long") + 1)
    # A frame reads samples from hop * (index - 1), for the frame before, to hop * index + size.
    lowest = F.greatest(F.lit(0), F.floor((F.col("first") - size) / hop).cast("long"))
    highest = F.least(frames - 1, F.floor((F.col("first") + F.size("samples") - 1) / hop).cast("long") + 1)
    c = c.withColumn("frames", frames).withColumn("segment", F.explode(F.sequence(F.floor(lowest / SEGMENT), F.greatest(F.floor(lowest / SEGMENT), F.floor(highest / SEGMENT)))))
    names = list(ranges)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        start = int(key[-1]) * SEGMENT
        stop = min(start + SEGMENT, int(rows["frames"].iloc[0]))
        head = max(0, start - 1)
        x = np.zeros((stop - 1 - head) * hop + size) if stop > start else np.zeros(0)
        for first, samples in zip(rows["first"], rows["samples"], strict=True):
            a = int(first) - head * hop
            lo, hi = max(0, a), min(len(x), a + len(samples))
            if hi > lo:
                x[lo:hi] = np.asarray(samples, float)[lo - a : hi - a]
        if stop <= start:
            return pd.DataFrame(columns=[*by, "band", "frame_index", "raw"])
        view = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        mag = np.abs(np.fft.rfft(view * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)), axis=1))
        hz = np.fft.rfftfreq(size, 1 / rate)
        gain = np.maximum(0.0, np.diff(mag, axis=0))
        if start == 0:
            gain = np.concatenate([np.zeros((1, len(hz))), gain])
        out = {b: gain[:, (hz >= lo) & (hz < hi)].sum(axis=1) for b, (lo, hi) in ranges.items()}
        n = stop - start
        made = pd.DataFrame({"band": np.repeat(names, n), "frame_index": np.tile(np.arange(start, stop), len(names)), "raw": np.concatenate([out[b] for b in names])})
        return made.assign(**dict(zip(by, key[:-1], strict=True)))[[*by, "band", "frame_index", "raw"]]

    schema = T.StructType([*keys.fields, *T.StructType.fromDDL("band string, frame_index long, raw double").fields])
    return c.groupBy(*by, "segment").applyInPandas(run, schema)


def normalised(flux: DataFrame, by: list[str]) -> DataFrame:
    """(by, band, frame_index, strength): what is above the 5th percentile of a band, over the 95th of that, within 0 to 2.5; 0 where a band never rises."""
    key = [*by, "band"]
    low = flux.groupBy(*key).agg(F.percentile("raw", 0.05).alias("low"), F.max("raw").alias("top"))
    over = flux.join(low, key).withColumn("over", F.greatest(F.lit(0.0), F.col("raw") - F.col("low")))
    scale = over.groupBy(*key).agg(F.greatest(F.lit(1e-9), F.percentile("over", 0.95)).alias("scale"))
    s = F.when(F.col("top") > 0, F.least(F.lit(2.5), F.col("over") / F.col("scale"))).otherwise(0.0)
    return over.join(scale, key).select(*key, "frame_index", s.alias("strength"))


@dataclass(frozen=True)
class Picking:
    """Frames on each side of the maximum and of the mean, least excess over the mean, frames to wait, least strength."""

    pre_max: int = 3
    post_max: int = 3
    pre_avg: int = 6
    post_avg: int = 6
    delta: float = 0.06
    wait: int = 2
    minimum: float = 0.1

    def relaxed(self) -> Picking:
        return Picking(self.pre_max, self.post_max, self.pre_avg, self.post_avg, max(0.0, self.delta * 0.85), self.wait, max(0.03, self.minimum * 0.75))


def pick(env: DataFrame, by: list[str], p: Picking, value: str = "strength", least: Column | None = None) -> DataFrame:
    """Local maxima far enough above their surroundings; of two at most wait frames apart the higher stays, of equal ones the first.

    least, where given, is the least strength of a row in place of p's own.
    """
    found = peaks(env, by, "frame_index", value, p.pre_max, p.post_max, p.pre_avg, p.post_avg, p.delta, p.minimum if least is None else least)
    return keep_spaced(found, by, "frame_index", value, F.lit(p.wait + 1), "frame_index")


def detect_onsets(env: DataFrame, by: list[str], p: Picking, rate: float, hop: int = 256, least: Column | None = None) -> DataFrame:
    """(by, frame_index, onset_sec, strength, relaxed) of env (by, frame_index, strength).

    Keys that come out without any onset, and only those, are picked again with looser thresholds. least, an expression
    over by, sets the least strength of each key in place of p's own.
    """
    columns = [*by, "frame_index", "strength"]
    looser = None if least is None else F.greatest(F.lit(0.03), least * 0.75)
    first = pick(env.select(*columns), by, p, least=least)
    second = pick(env.select(*columns).join(first.select(*by).distinct(), by, "left_anti"), by, p.relaxed(), least=looser)

    def timed(df: DataFrame, relaxed: bool) -> DataFrame:
        sec: Column = F.col("frame_index") * F.lit(hop / rate)
        return df.select(*by, "frame_index", sec.alias("onset_sec"), "strength", F.lit(relaxed).alias("relaxed"))

    return timed(first, False).unionByName(timed(second, True))
