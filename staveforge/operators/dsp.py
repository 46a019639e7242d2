"""Signals in chunks: zero-phase band-pass (W9) and linear resampling.

A chunk is a row (keys, chunk, samples). A recursive filter is a linear map of its state and the samples, so a segment of
chunks is first run from a zero state; what that leaves, carried over the segments of a signal, gives each segment's true
starting state, and all segments are then run at once. A task holds one segment; a signal is never in one task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staveforge.sources.shared import staged

#: Samples that the filter's matrices take at once, chunks in a segment, samples by which each end is extended, longest signal that is left as it is.
BLOCK, SEGMENT, SHORT = 64, 64, 64


def butterworth(low_hz: float, high_hz: float, rate: float, order: int = 4) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of the Butterworth band-pass, by the bilinear transform of the analogue prototype."""
    w1, w2 = (4 * np.tan(np.pi * f / rate) for f in (low_hz, high_hz))
    m = np.arange(-order + 1, order, 2)
    narrow = -np.exp(1j * np.pi * m / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(narrow**2 - w1 * w2)
    analogue = np.concatenate([narrow + root, narrow - root])
    poles = (4 + analogue) / (4 - analogue)
    gain = ((w2 - w1) ** order * 4.0**order / np.prod(4 - analogue)).real
    upper = sorted(poles[poles.imag > 0], key=abs)
    if len(upper) < order:  # a very wide band has real poles, in pairs
        real = np.sort(poles[np.abs(poles.imag) <= 1e-14].real)
        pairs = [(p, p.conjugate()) for p in upper] + list(zip(real[::2], real[1::2], strict=True))
    else:
        pairs = [(p, p.conjugate()) for p in upper]
    out = np.array([[1.0, 0.0, -1.0, 1.0, -(p + q).real, (p * q).real] for p, q in pairs])
    out[0, :3] *= gain
    return out


class Filter:
    """A cascade of sections as a state space, and as matrices over blocks of samples."""

    def __init__(self, sos: np.ndarray):
        k = 2 * len(sos)

        def step(state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
            new = np.empty(k)
            for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
                y = b0 * x + state[2 * i]
                new[2 * i], new[2 * i + 1] = b1 * x - a1 * y + state[2 * i + 1], b2 * x - a2 * y
                x = y
            return new, x

        unit = [step(e, 0.0) for e in np.eye(k)]
        self.a, self.c = np.array([s for s, _ in unit]).T, np.array([y for _, y in unit])
        self.b, self.d = step(np.zeros(k), 1.0)
        #: The state in which a constant input of 1 leaves the filter.
        self.rest = np.linalg.solve(np.eye(k) - self.a, self.b)

    @lru_cache(maxsize=BLOCK)
    def block(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(of state to samples, of samples to samples, of state to state, of samples to state) over n samples."""
        power = [np.eye(len(self.b))]
        for _ in range(n):
            power.append(self.a @ power[-1])
        pulse = np.array([self.d, *[self.c @ power[i] @ self.b for i in range(n - 1)]])
        gap = np.subtract.outer(np.arange(n), np.arange(n))
        return np.array([self.c @ power[i] for i in range(n)]), np.where(gap >= 0, pulse[np.abs(gap)], 0.0), power[n], np.array([power[n - 1 - i] @ self.b for i in range(n)]).T

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            seen, mixed, kept, left = self.block(len(part))
            out[at : at + BLOCK] = seen @ state + mixed @ part
            state = kept @ state + left @ part
        return out, state

    def over(self, n: int, state: np.ndarray) -> np.ndarray:
        """The state after n samples of zero."""
        return np.linalg.matrix_power(self.a, n) @ state


@lru_cache(maxsize=8)
def _band(low_hz: float, high_hz: float, rate: float) -> Filter:
    return Filter(butterworth(low_hz, high_hz, rate))


def _one_way(chunks: DataFrame, by: list[str], band: tuple[float, float, float], sign: int, starts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(filtered chunks, ends) of one pass, forward (sign 1) or backward (-1).

    ends: a row for each signal, the state in which the other pass starts. starts: those of this pass, if it is the
    second; the first pass starts at rest on the extended signal. Only a segment's length, final state and outer samples
    are folded by signal.
    """
    edge = 3 * 9  # three times the taps of the four sections
    keys = T.StructType([chunks.schema[c] for c in by])
    names, first = chunks.columns, starts is None
    cut = chunks.withColumn("segment", F.floor(F.col("chunk") / SEGMENT).cast("long"))

    def joined(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        rows = rows.sort_values("chunk", ascending=sign > 0)
        return rows, np.concatenate([np.asarray(x, float)[::sign] for x in rows["samples"]] or [np.empty(0)])

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, x = joined(rows)
        f = _band(*band)
        return pd.DataFrame([(*key, len(x), f.run(x, np.zeros(len(f.b)))[1], x[: edge + 1], x[-edge - 1 :])], columns=[*by, "segment", "n", "state", "head", "tail"])

    parts = cut.groupBy(*by, "segment").applyInPandas(measure, T.StructType([*keys.fields, *T.StructType.fromDDL("segment long, n long, state array<double>, head array<double>, tail array<double>").fields]))
    if starts is not None:
        parts = parts.join(starts, by)

    def carry(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment", ascending=sign > 0)
        f, total = _band(*band), int(rows["n"].sum())
        out = []
        if first:
            head, tail = np.concatenate([*rows["head"]])[: edge + 1], np.concatenate([*rows["tail"]])[-edge - 1 :]
        if total <= SHORT:
            state = np.zeros(len(f.b))
        elif first:
            before = 2 * head[0] - head[:0:-1]
            _, state = f.run(before, f.rest * before[0])
        else:
            state = np.asarray(rows["start"].iloc[0])
        for segment, n, own in zip(rows["segment"], rows["n"], rows["state"], strict=True):
            out.append((*key, segment, total, state, None))
            state = f.over(int(n), state) + np.asarray(own)
        if first and total > SHORT:
            after, _ = f.run(2 * tail[-1] - tail[-2::-1], state)
            _, back = f.run(after[::-1], f.rest * after[-1])
            out[0] = (*out[0][:-1], back)
        return pd.DataFrame(out, columns=[*by, "segment", "total", "state", "start"])

    carried = staged(parts.groupBy(*by).applyInPandas(carry, T.StructType([*keys.fields, *T.StructType.fromDDL("segment long, total long, state array<double>, start array<double>").fields])))

    def apply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, x = joined(rows)
        if rows["total"].iloc[0] > SHORT:
            x, _ = _band(*band).run(x, np.asarray(rows["state"].iloc[0]))
        ends = np.cumsum([len(s) for s in rows["samples"]])[:-1]
        rows["samples"] = [p[::sign] for p in np.split(x, ends)]
        return rows[names]

    out = cut.join(carried.select(*by, "segment", "total", "state"), [*by, "segment"]).groupBy(*by, "segment").applyInPandas(apply, chunks.schema)
    return out, carried.where("start is not null").select(*by, "start")


def band_pass(chunks: DataFrame, by: list[str], rate: float, low_hz: float, high_hz: float) -> DataFrame:
    """Chunks (by, chunk, samples array<double>) filtered forward and backward by a fourth-order Butterworth band-pass.

    Each end is extended by 27 samples, turned about the outermost one. Edges are kept within 1 Hz and 98 % of half the rate; if none
    is left between them, and for signals of SHORT samples or fewer, samples stay as they are. Chunks number the parts
    of a signal from 0 and may differ in length; by and chunk are not null. The result has the columns by, chunk, samples.
    """
    c = chunks.select(*by, F.col("chunk").cast("long").alias("chunk"), F.col("samples").cast("array<double>").alias("samples"))
    low, high = max(1.0, low_hz), min(high_hz, max(1.0, rate * 0.5) * 0.98)
    if high <= low:
        return c
    ahead, ends = _one_way(c, by, (low, high, rate), 1, None)
    ahead = staged(ahead)
    # Signals that are too short have no end; they are taken as they are.
    back, _ = _one_way(ahead.join(ends.select(*by), by, "left_semi"), by, (low, high, rate), -1, ends)
    return back.unionByName(ahead.join(ends.select(*by), by, "left_anti"))


def fit_length(values: DataFrame, by: list[str], at: str, value: str, lengths: DataFrame) -> DataFrame:
    """(by, at, value): value at lengths.m evenly spread places from the first to the last, linear between neighbours.

    at numbers the values of a key from 0 without gaps. A key of lengths without values gets zeros; equal lengths keep
    the values. Places find their two neighbours by equality on their number, so a long key is spread over tasks.
    """
    n = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    want = lengths.where("m > 0").select(*by, "m").join(n, by, "left").select(*by, "m", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("j"))
    x = F.when((F.col("m") == 1) | (F.col("n") < 2), 0.0).otherwise(F.col("j") * (F.col("n") - 1) / (F.col("m") - 1).cast("double"))
    low = F.greatest(F.lit(0), F.least(F.floor(x), F.col("n") - 2)).cast("int")
    want = want.select(*by, "j", x.alias("x"), low.alias("low"))
    left = values.select(*by, F.col(at).cast("int").alias("low"), F.col(value).cast("double").alias("a"))
    right = values.select(*by, (F.col(at) - 1).cast("int").alias("low"), F.col(value).cast("double").alias("b"))
    j = want.join(left, [*by, "low"], "left").join(right, [*by, "low"], "left")
    a = F.coalesce("a", F.lit(0.0))
    return j.select(*by, F.col("j").alias(at), (a + (F.coalesce("b", a) - a) * (F.col("x") - F.col("low"))).alias(value))
