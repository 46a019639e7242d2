"""Chained groups and refractory suppression on streams: our extension, the batch forms are in operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transient_sessions(hits: DataFrame, key: str, gap_us: int, watermark: str = "1 minute") -> DataFrame:
    """W28 online: (key, start, end, n). session_window leaves out a gap of exactly its length, so it gets one microsecond more."""
    s = hits.withWatermark("ts", watermark).groupBy(F.col(key), F.session_window("ts", f"{gap_us + 1} microseconds"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).select(key, F.col("session_window.start").alias("start"), "last_ts", "n")


def refractory(hits: DataFrame, key: str, gap_sec: float, watermark: str = "1 minute") -> DataFrame:
    """W31 online: (key, t, strength) of hits that stand, t in seconds. hits: key, ts, strength, in any order within the watermark.

    State holds a key's pending hit and the hits that the watermark has not passed. Hits are taken in event time, and the
    pending one is given out once no hit can replace it any more, so the result does not depend on when batches run.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, waiting = None, []
        if state.exists:
            t, v, at, strength = state.get
            held, waiting = (None if t is None else (t, v)), list(zip(at, strength))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip(f.t.astype(float), f.strength.astype(float))
        passed, out = state.getCurrentWatermarkMs() / 1000, []
        for t, v in sorted(x for x in waiting if x[0] < passed):
            if held is None or t - held[0] >= gap_sec:
                if held is not None:
                    out.append((*name, *held))
                held = (t, v)
            elif v > held[1]:
                held = (t, v)
        waiting = [x for x in waiting if x[0] >= passed]
        if held is not None and passed - held[0] >= gap_sec:
            out.append((*name, *held))
            held = None
        if held is None and not waiting:
            state.remove()
        else:
            state.update((*(held or (None, None)), [x[0] for x in waiting], [x[1] for x in waiting]))
            due = min(x[0] for x in waiting) if waiting else held[0] + gap_sec
            state.setTimeoutTimestamp(max(int(due * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "t", "strength"])

    kind = hits.schema[key].dataType.simpleString()
    rows = hits.withWatermark("ts", watermark).select(key, "ts", F.col("ts").cast("double").alias("t"), "strength")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t double, strength double", "t double, strength double, at array<double>, strengths array<double>", "append", "EventTimeTimeout")
