"""Band-pass, resampling, band envelopes, onsets, detectors and hits (W8, W9, W24 to W27, P18, P19, X18, X19) over the vectors of embeddings as chunks of longer signals, and over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.operators import detectors, dsp, onsets
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import staged

from .registry import query, sql

REC = ["recording_id"]
RATE, LOW, HIGH = 8000.0, 300.0, 1200.0


def signals(t: Tables) -> DataFrame:
    """(signal_id, chunk, samples): 100 vectors in a row are one signal."""
    v = F.col("vec_id")
    return t.read("embeddings").select(F.floor(v / 100).cast("long").alias("signal_id"), (v % 100).alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))


@query("w9_band_pass")
def w9(t: Tables) -> DataFrame:
    """Sum, power and ends of every filtered chunk."""
    x = F.col("samples")
    out = dsp.band_pass(signals(t), ["signal_id"], RATE, LOW, HIGH)
    power = F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)
    return out.select("signal_id", "chunk", F.size(x).alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), 6).alias("total"), F.round(power, 6).alias("power"), F.round(F.get(x, F.lit(0)), 6).alias("first"), F.round(F.element_at(x, -1), 6).alias("last"))


@query("w8_fit_length", sql(""", n AS (SELECT recording_id, count(*) AS n, count(*) * 2 // 3 + 5 AS m FROM frames GROUP BY 1), w AS (SELECT recording_id, n, m, unnest(range(0, m)) AS j FROM n),
 p AS (SELECT *, CASE WHEN m = 1 OR n < 2 THEN 0.0 ELSE j * (n - 1) / CAST(m - 1 AS DOUBLE) END AS x FROM w), q AS (SELECT *, CAST(greatest(0, least(floor(x), n - 2)) AS INTEGER) AS lo FROM p)
 SELECT q.recording_id, CAST(j AS INTEGER) AS frame_index, round(a.rms + (coalesce(b.rms, a.rms) - a.rms) * (x - lo), 9) AS rms FROM q JOIN frames a ON a.recording_id = q.recording_id AND a.frame_index = lo LEFT JOIN frames b ON b.recording_id = q.recording_id AND b.frame_index = lo + 1""", "frames"))
def w8(t: Tables) -> DataFrame:
    """The levels of every recording at two thirds of its frames and five."""
    m = t.frames.groupBy(*REC).agg(F.expr("count(1) * 2 div 3 + 5").alias("m"))
    return dsp.fit_length(t.frames.select(*REC, "frame_index", "rms"), REC, "frame_index", "rms", m).select(*REC, "frame_index", F.round("rms", 9).alias("rms"))


ONSET_RATE = 22050.0
PICKING = onsets.Picking(minimum=0.9, delta=0.55)


def envelopes(t: Tables) -> DataFrame:
    return staged(onsets.normalised(onsets.band_flux(signals(t), ["signal_id"], ONSET_RATE), ["signal_id"]))


@query("w24_band_envelopes")
def w24(t: Tables) -> DataFrame:
    """Onset strength of ten bands in every frame of every signal."""
    return envelopes(t).withColumn("strength", F.round("strength", 6))


@query("w26_band_onsets")
def w26(t: Tables) -> DataFrame:
    """Onsets of every signal and band, with the looser retry."""
    found = onsets.detect_onsets(envelopes(t), ["signal_id", "band"], PICKING, ONSET_RATE)
    return found.withColumns({"onset_sec": F.round("onset_sec", 9), "strength": F.round("strength", 6)})


SIG = ["signal_id"]
_ROUND = ("strength", "low", "mid", "upper", "high", "attack", "decay", "low_ratio", "mid_ratio", "high_ratio", "dominance", "confidence", "rival_score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({**{c: F.round(c, 6) for c in _ROUND}, "centroid": F.round("centroid", 3), "onset_sec": F.round("onset_sec", 9)})


def hits(t: Tables) -> DataFrame:
    p = detectors.profile("balanced")
    return detectors.to_hits(detectors.detector_candidates(envelopes(t), SIG, p, ONSET_RATE), SIG, p)


@query("p18_x18_detector_candidates")
def p18(t: Tables) -> DataFrame:
    """Candidates of five detectors in every signal."""
    return _rounded(detectors.detector_candidates(envelopes(t), SIG, detectors.profile("balanced"), ONSET_RATE))


@query("p19_global_candidates")
def p19(t: Tables) -> DataFrame:
    """Onsets of the full band with the class of the largest score."""
    return _rounded(detectors.global_candidates(envelopes(t), SIG, detectors.profile("sensitive"), ONSET_RATE))


@query("x19_m10_audio_hits")
def x19(t: Tables) -> DataFrame:
    """From samples to hits: envelopes, detectors, rejection, transients, spacing and refractory, with the reason of each hit that goes."""
    return _rounded(hits(t)).withColumns({"bpm": F.round("bpm", 6), "score": F.round("score", 6)})


@query("x18_detector_counters")
def x18(t: Tables) -> DataFrame:
    """Candidates, accepted and rejected hits of each signal and detector."""
    return detectors.counters(hits(t), SIG)
