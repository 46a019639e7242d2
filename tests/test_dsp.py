"""The band-pass against a sample-by-sample recursion over whole signals, and linear resampling."""

import numpy as np
import pytest

from staveforge.operators import dsp
from staveforge.plans import catalog, dsp_queries
from staveforge.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def recursion(sos, x, level):
    """Direct form by section, from the state that a constant level leaves."""
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = (b2 - a2 * gain) * level
        s1 = (b1 - a1 * gain) * level + s2
        y = np.empty(len(x))
        for i, v in enumerate(x):
            y[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * y[i] + s2, b2 * v - a2 * y[i]
        x, level = y, gain * level
    return x


def both_ways(sos, x):
    if len(x) <= 64:
        return x
    e = np.concatenate([2 * x[0] - x[27:0:-1], x, 2 * x[-1] - x[-2:-29:-1]])
    y = recursion(sos, e, e[0])
    return recursion(sos, y[::-1], y[-1])[::-1][27:-27]


@pytest.mark.parametrize(("low", "high", "rate"), [(300.0, 1200.0, 8000.0), (35.0, 400.0, 44100.0), (1.0, 3900.0, 8000.0)])
def test_response_of_the_design(low, high, rate):
    sos = dsp.butterworth(low, high, rate)
    assert sos.shape == (4, 6)

    def gain(f):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))

    assert gain(low) == pytest.approx(0.5**0.5, rel=1e-4) and gain(high) == pytest.approx(0.5**0.5, rel=1e-4)
    middle = rate / np.pi * np.arctan(np.sqrt(np.tan(np.pi * low / rate) * np.tan(np.pi * high / rate)))
    assert gain(middle) == pytest.approx(1.0, rel=1e-6) and gain(rate / 2) < 1e-9


def test_chunks_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(dsp, "SEGMENT", 3)
    r = np.random.default_rng(1)
    signals = {"long": r.normal(size=3000), "short": r.normal(size=64), "small": r.normal(size=65), "level": np.full(500, 3.0)}
    rows = []
    for name, x in signals.items():
        at = k = 0
        while at < len(x):
            n = int(r.integers(1, 200))
            rows.append((name, k, x[at : at + n].tolist()))
            at, k = at + n, k + 1
    df = spark.createDataFrame(rows, "name string, chunk int, samples array<double>").repartition(4)
    got = {}
    for row in sorted(dsp.band_pass(df, ["name"], 8000.0, 300.0, 1200.0).collect()):
        got.setdefault(row.name, []).append(row.samples)
    sos = dsp.butterworth(300.0, 1200.0, 8000.0)
    for name, x in signals.items():
        assert [len(s) for s in got[name]] == [len(s) for n, _, s in rows if n == name]
        np.testing.assert_allclose(np.concatenate(got[name]), both_ways(sos, x), atol=1e-9)
    assert sorted(map(tuple, [(r.name, r.chunk) for r in dsp.band_pass(df, ["name"], 8000.0, 900.0, 800.0).collect()])) == sorted((n, k) for n, k, _ in rows)
    assert dsp.band_pass(df.limit(0), ["name"], 8000.0, 300.0, 1200.0).count() == 0


def test_query(spark):
    whole = {}
    for r in sorted(dsp_queries.signals(Tables(spark, SF)).collect()):
        whole.setdefault(r.signal_id, []).append(r.samples)
    sos = dsp.butterworth(dsp_queries.LOW, dsp_queries.HIGH, dsp_queries.RATE)
    want = {}
    for s, parts in whole.items():
        y = both_ways(sos, np.concatenate(parts))
        at = 0
        for k, p in enumerate(parts):
            want[s, k] = y[at : at + len(p)]
            at += len(p)
    got = catalog.QUERIES["w9_band_pass"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        y = want[r.signal_id, r.chunk]
        np.testing.assert_allclose((r.total, r.power, r.first, r.last), (y.sum(), (y * y).sum(), y[0], y[-1]), atol=2e-6)


def test_fit_length(spark):
    v = {"a": [1.0, 3.0, 2.0, 8.0], "b": [5.0], "c": []}
    df = spark.createDataFrame([(k, i, x) for k, xs in v.items() for i, x in enumerate(xs)], "k string, i int, v double")
    for m in (1, 2, 4, 7):
        got = dsp.fit_length(df, ["k"], "i", "v", spark.createDataFrame([(k, m) for k in v], "k string, m int")).collect()
        for k, xs in v.items():
            want = np.interp(np.linspace(0, 1, m), np.linspace(0, 1, len(xs)), xs) if xs else np.zeros(m)
            np.testing.assert_allclose([r.v for r in sorted(got) if r.k == k], want)
