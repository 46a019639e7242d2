"""Band envelopes and onsets against NumPy over whole signals."""

import numpy as np
import pytest

from staveforge.operators import onsets
from staveforge.plans import catalog, dsp_queries
from staveforge.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def plain_envelopes(x, rate, size=1024, hop=256):
    n = 1 if len(x) <= size else -(-(len(x) - size) // hop) + 1
    x = np.concatenate([x, np.zeros((n - 1) * hop + size - len(x))]) if (n - 1) * hop + size > len(x) else x
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    mag = np.array([np.abs(np.fft.rfft(x[i * hop : i * hop + size] * hann)) for i in range(n)])
    hz = np.arange(size // 2 + 1) * rate / size
    out = {}
    for band, (lo, hi) in onsets.BANDS.items():
        raw = np.array([0.0] + [np.maximum(0, mag[i] - mag[i - 1])[(hz >= lo) & (hz < hi)].sum() for i in range(1, n)])
        over = np.maximum(0, raw - np.percentile(raw, 5))
        out[band] = np.clip(over / max(np.percentile(over, 95), 1e-9), 0, 2.5) if (raw > 0).any() else np.zeros(n)
    return out


def plain_peaks(v, p):
    kept = []
    for i, x in enumerate(v):
        if x < p.minimum or x < max(v[max(0, i - p.pre_max) : i + p.post_max + 1]) or x < np.mean(v[max(0, i - p.pre_avg) : i + p.post_avg + 1]) + p.delta:
            continue
        if kept and i - kept[-1] <= p.wait:
            kept[-1] = i if x > v[kept[-1]] else kept[-1]
        else:
            kept.append(i)
    return kept


@pytest.fixture(scope="module")
def whole(spark):
    out = {}
    for r in sorted(dsp_queries.signals(Tables(spark, SF)).collect()):
        out.setdefault(r.signal_id, []).append(r.samples)
    return {k: np.concatenate(v) for k, v in out.items()}


def test_queries(spark, whole):
    want = {(k, b, i): x for k, s in whole.items() for b, v in plain_envelopes(s, dsp_queries.ONSET_RATE).items() for i, x in enumerate(v)}
    env = dsp_queries.envelopes(Tables(spark, SF)).collect()
    got = {(r.signal_id, r.band, r.frame_index): r.strength for r in env}
    assert got.keys() == want.keys() and len(env) == len(want)
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-7)
    found: dict = {}
    for r in catalog.QUERIES["w26_band_onsets"](spark, SF).collect():
        found.setdefault((r.signal_id, r.band), []).append((r.frame_index, r.relaxed))
    relaxed = set()
    for k in whole:
        for b in onsets.BANDS:
            v = [got[k, b, i] for i in range(sum((k, b, i) in got for i in range(10**3)))]
            first, p = plain_peaks(v, dsp_queries.PICKING), dsp_queries.PICKING
            pairs = [(i, False) for i in first] or [(i, True) for i in plain_peaks(v, p.relaxed())]
            assert sorted(found.get((k, b), [])) == pairs
            relaxed |= {x[1] for x in pairs}
    assert False in relaxed


def test_segments_and_odd_chunks(spark, monkeypatch):
    monkeypatch.setattr(onsets, "SEGMENT", 4)
    r = np.random.default_rng(2)
    signals = {"long": r.normal(size=9000), "one": r.normal(size=1024), "less": r.normal(size=10), "more": r.normal(size=1025), "still": np.zeros(4000)}
    rows = []
    for name, x in signals.items():
        at = k = 0
        while at < len(x):
            n = int(r.integers(1, 900))
            rows.append((name, k, x[at : at + n].tolist()))
            at, k = at + n, k + 1
    df = spark.createDataFrame([*rows, ("none", 0, [])], "name string, chunk int, samples array<double>").repartition(3)
    got = {(x["name"], x["band"], x["frame_index"]): x["strength"] for x in onsets.normalised(onsets.band_flux(df, ["name"], 22050.0), ["name"]).collect()}
    want = {(k, b, i): x for k, s in signals.items() for b, v in plain_envelopes(s, 22050.0).items() for i, x in enumerate(v)}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-7)


def test_retry_is_for_empty_keys_only(spark):
    p = onsets.Picking(minimum=1.0, delta=0.5)
    rows = [(k, i, float(x)) for k, v in {"loud": [0, 0, 2.0, 0, 0, 0, 0, 0, 0.8, 0, 0], "soft": [0, 0, 0.8, 0, 0, 0, 0, 0, 0.76, 0, 0], "flat": [0.1] * 11}.items() for i, x in enumerate(v)]
    got = onsets.detect_onsets(spark.createDataFrame(rows, "band string, frame_index long, strength double"), ["band"], p, 256.0).collect()
    assert sorted((r.band, r.frame_index, r.onset_sec, r.relaxed) for r in got) == [("loud", 2, 2.0, False), ("soft", 2, 2.0, True), ("soft", 8, 8.0, True)]
