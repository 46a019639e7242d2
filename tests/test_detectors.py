"""Detectors and the way to hits against plain loops over NumPy envelopes."""

import random

import numpy as np
import pytest

from staveforge.operators import detectors, onsets
from staveforge.plans import catalog, dsp_queries
from staveforge.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
CLASS = {"kick": "kick", "snare": "snare_or_clap", "hat": "hat", "cymbal": "cymbal", "tom": "tom_or_perc"}
LEAST = {"kick": 0.24, "snare": 0.22, "hat": 0.22, "cymbal": 0.28, "tom": 0.24}


def clip(x, top=1.0):
    return min(top, max(0.0, x))


def plain_pick(v, p, minimum):
    def once(delta, minimum):
        kept = []
        for i, x in enumerate(v):
            near, wide = v[max(0, i - p.onset_pre_max) : i + p.onset_post_max + 1], v[max(0, i - p.onset_pre_avg) : i + p.onset_post_avg + 1]
            if x < minimum or x < max(near) or x < np.mean(wide) + delta:
                continue
            if kept and i - kept[-1] <= p.onset_wait:
                kept[-1] = i if x > v[kept[-1]] else kept[-1]
            else:
                kept.append(i)
        return kept

    return once(p.onset_delta, minimum) or once(max(0.0, p.onset_delta * 0.85), max(0.03, minimum * 0.75))


def shape(v, i):
    pre, short, long = np.mean(v[max(0, i - 3) : i + 1]), np.mean(v[i : i + 3]), np.mean(v[i : i + 10])
    return clip((short - pre) / (short + 1e-9)), clip(long / (short + 1e-9))


def plain_detectors(env, p):
    out = []
    for d in CLASS:
        for i in plain_pick(env[d], p, max(p.onset_delta, LEAST[d], 0.04)):
            s, low, mid, upper, high = (float(env[b][i]) for b in (d, "low", "mid", "upper", "high"))
            attack, decay = shape(env[d], i)
            total = low + mid + high + 1e-9
            if d == "kick":
                dom, rival = low / total, ("tom_or_perc", mid * 0.65)
                conf = 0.48 * s + 0.34 * dom + 0.18 * attack - (0.1 * decay if decay > 0.92 else 0)
            elif d == "snare":
                band = min(1.5, mid + 0.7 * upper)
                dom, rival = band / max(band + low + 0.5 * high, 1e-9), ("cymbal", 0.55 * high)
                conf = 0.46 * s + 0.30 * dom + 0.24 * attack - (0.09 if high > 0.85 and mid < 0.3 else 0)
            elif d == "hat":
                dom, rival = high / (mid + high + 1e-9), ("cymbal", 0.55 * high + 0.25 * decay)
                conf = 0.44 * s + 0.32 * dom + 0.24 * attack
            elif d == "cymbal":
                dom, rival = (high + 0.4 * upper) / total, ("hat", 0.55 * high + 0.25 * attack)
                conf = 0.42 * s + 0.28 * dom + 0.30 * decay - (0.12 if attack > 0.7 and decay < 0.35 else 0)
            else:
                dom, rival = (0.6 * low + mid) / total, ("kick", 0.65 * low)
                conf = 0.44 * s + 0.34 * dom + 0.22 * attack - (0.12 if high > 0.7 else 0)
            out.append({"detector": d, "frame_index": i, "class_name": CLASS[d], "strength": s, "attack": attack, "decay": decay, "dominance": clip(dom), "confidence": clip(conf, 0.99), "rival": rival[0], "rival_score": clip(rival[1]), "centroid": (low * 120 + mid * 1600 + high * 7000) / total, "candidate_id": len(out)})
    return out


def plain_global(env, p, minimum=0.2):
    out = []
    for i in plain_pick(env["full"], p, minimum):
        s, low, mid, high = (float(env[b][i]) for b in ("full", "low", "mid", "high"))
        scores = [0.55 * low + 0.25 * s + 0.2 * low / (mid + 1e-9), 0.45 * mid + 0.28 * s + 0.27 * min(1, mid + 0.6 * high), 0.46 * high + 0.24 * s + 0.3 * min(1, high / (mid + 1e-9)), 0.38 * high + 0.2 * s + 0.42 * min(1, high + 0.35 * mid), 0.42 * mid + 0.3 * low + 0.28 * s]
        best = sorted(zip([-clip(x, 1.25) for x in scores], range(5), CLASS.values(), strict=True))
        attack, decay = shape(env["full"], i)
        out.append({"detector": "global", "frame_index": i, "class_name": best[0][2], "strength": s, "attack": attack, "decay": decay, "dominance": max(low, mid, high) / (low + mid + high + 1e-9), "confidence": clip(-best[0][0] + 0.35 * best[1][0], 0.98), "rival": best[1][2], "rival_score": clip(-best[1][0]), "candidate_id": len(out)})
    return out


def plain_hits(cands, p, sec):
    hits = sorted(cands, key=lambda c: (c["frame_index"], -c["confidence"], c["candidate_id"]))
    gap = {"kick": p.kick_refractory_ms, "snare_or_clap": p.snare_refractory_ms, "hat": p.hat_refractory_ms, "cymbal": p.cymbal_refractory_ms, "tom_or_perc": p.tom_refractory_ms}
    for n, h in enumerate(hits):
        h.update(hit_id=n, at=h["frame_index"] * sec, reason=None, score=0.52 * h["strength"] + 0.26 * h["confidence"] + 0.1 * h["attack"] + 0.12 * h["dominance"])
        if h["confidence"] < p.min_class_confidence:
            h["reason"] = "low_confidence"
        elif h["class_name"] == "tom_or_perc" and h["rival"] in ("kick", "snare_or_clap") and h["rival_score"] >= 0.92 * h["confidence"]:
            h["reason"] = "tom_not_clear"
    for name in gap:
        live = [h for h in hits if h["class_name"] == name and not h["reason"]]
        groups = []
        for h in live:
            if groups and h["at"] - groups[-1][-1]["at"] <= p.same_transient_window_ms / 1000:
                groups[-1].append(h)
            else:
                groups.append([h])
        for g in groups:
            best = max(g, key=lambda h: h["score"])
            for h in g:
                h["reason"] = None if h is best else "same_transient_group"
        for reason, least in (("global_min_spacing", p.min_hit_spacing_ms / 1000), ("class_refractory", gap[name] / 1000)):
            last = None
            for h in live:
                if h["reason"]:
                    continue
                if last is not None and h["at"] - last["at"] < least:
                    worse = last if h["score"] > last["score"] else h
                    worse["reason"] = reason
                    last = h if worse is last else last
                else:
                    last = h
    return hits


def plain_bpm(cands, sec):
    at = np.sort([c["frame_index"] * sec for c in cands])
    d = np.diff(at)
    d = d[(d >= 0.06) & (d <= 1.5)]
    if not len(d):
        return 120.0
    b = 60 / np.median(d)
    while b < 70:
        b *= 2
    while b > 190:
        b /= 2
    return b


def same(got, want, names, text):
    assert [[g[c] for c in text] for g in got] == [[w[c] for c in text] for w in want]
    for c in names:
        np.testing.assert_allclose([g[c] for g in got], [w[c] for w in want], atol=2e-6, err_msg=c)


NAMES = ("strength", "attack", "decay", "dominance", "confidence", "rival_score")
TEXT = ("candidate_id", "detector", "frame_index", "class_name", "rival")
RATE = 22050.0
SEC = 256 / RATE


@pytest.fixture(scope="module")
def made():
    """Envelopes with sharp and slow decays in chosen bands: one long signal with most frames, a short one, one of a single frame, a still one."""
    r = np.random.default_rng(11)
    out = {}
    for name, n in (("long", 1500), ("short", 90), ("one", 1), ("still", 60)):
        env = {b: r.uniform(0, 0.12, n) if name != "still" else np.zeros(n) for b in onsets.BANDS}
        for i in range(3, n if name != "still" else 0, 7):
            for b in r.choice(list(onsets.BANDS), 5, replace=False):
                tail = r.choice([0.2, 0.6, 0.97])
                for k in range(min(8, n - i)):
                    env[b][i + k] = min(2.5, env[b][i + k] + r.uniform(0.2, 1.6) * tail**k)
        out[name] = env
    return out


@pytest.fixture(scope="module")
def env(spark, made):
    rows = [(n, b, i, float(x)) for n, e in made.items() for b, v in e.items() for i, x in enumerate(v)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "name string, band string, frame_index long, strength double").repartition(4).cache()


def of(rows, name, key):
    return sorted((r.asDict() for r in rows if r["name"] == name), key=lambda r: r[key])


@pytest.mark.parametrize("which", ["balanced", "sensitive", "conservative"])
def test_candidates_and_hits(spark, env, made, which, monkeypatch):
    monkeypatch.setattr(detectors, "PART", 64)
    p = detectors.profile(which)
    c = detectors.detector_candidates(env, ["name"], p, RATE)
    got, hits = c.collect(), detectors.to_hits(c, ["name"], p).collect()
    reasons = set()
    for name, e in made.items():
        want = plain_detectors(e, p)
        same(of(got, name, "candidate_id"), want, (*NAMES, "centroid"), TEXT)
        mine = of(hits, name, "hit_id")
        bpm = plain_bpm(want, SEC)
        full = plain_hits(want, p, SEC)
        same(mine, full, (*NAMES, "score"), ("hit_id", *TEXT, "reason"))
        reasons |= {h["reason"] for h in full}
        assert [h["tick"] for h in mine] == [int(round(h["at"] * bpm * 8)) for h in full]
    assert {None, "low_confidence", "same_transient_group", "class_refractory"} <= reasons
    assert {(r["name"], r["detector"]): (r.candidates, r.accepted, r.rejected) for r in detectors.counters(detectors.to_hits(c, ["name"], p, bpm=100), ["name"]).collect()} == {
        (n, d): (len(k), sum(h.reason is None for h in k), sum(h.reason is not None for h in k)) for n in made for d in CLASS if (k := [h for h in hits if h["name"] == n and h.detector == d])
    }


def test_global_candidates(env, made):
    p = detectors.profile("balanced")
    got = detectors.global_candidates(env, ["name"], p, RATE).collect()
    for name, e in made.items():
        same(of(got, name, "candidate_id"), plain_global(e, p), NAMES, TEXT)
    assert len({r.class_name for r in got}) >= 4


def test_equal_scores_take_the_first_class(spark):
    rows = [("a", b, i, 2.5 if i == 4 and b in ("full", "low", "mid", "high") else 0.0) for b in onsets.BANDS for i in range(9)]
    df = spark.createDataFrame(rows, "name string, band string, frame_index long, strength double")
    got = detectors.global_candidates(df, ["name"], detectors.profile(), RATE).collect()
    assert [(r.frame_index, r.class_name, r.rival, round(r.confidence, 9)) for r in got] == [(4, "kick", "snare_or_clap", 0.8125)]


def test_queries(spark):
    env = {}
    for r in dsp_queries.envelopes(Tables(spark, SF)).orderBy("frame_index").collect():
        env.setdefault(r.signal_id, {}).setdefault(r.band, []).append(r.strength)
    p, loose = detectors.profile("balanced"), detectors.profile("sensitive")
    found = {q: catalog.QUERIES[q](spark, SF).collect() for q in ("p18_x18_detector_candidates", "p19_global_candidates", "x19_m10_audio_hits", "x18_detector_counters")}
    for k, e in env.items():
        mine = {q: [r.asDict() for r in rows if r.signal_id == k] for q, rows in found.items()}
        want = plain_detectors(e, p)
        same(sorted(mine["p18_x18_detector_candidates"], key=lambda r: r["candidate_id"]), want, NAMES, TEXT)
        same(sorted(mine["p19_global_candidates"], key=lambda r: r["candidate_id"]), plain_global(e, loose), NAMES, TEXT)
        hits = plain_hits(want, p, SEC)
        same(sorted(mine["x19_m10_audio_hits"], key=lambda r: r["hit_id"]), hits, NAMES, ("hit_id", *TEXT, "reason"))
        assert {r["detector"]: r["accepted"] for r in mine["x18_detector_counters"]} == {d: sum(h["reason"] is None for h in hits if h["detector"] == d) for d in {h["detector"] for h in hits}}
    assert all(found.values())


def test_profiles():
    assert detectors.profile("balanced", hat_refractory_ms=None) == detectors.Profile()
    assert detectors.profile("sensitive", onset_wait=4) == detectors.Profile(1, 1, 4, 4, 0.05, 4, 45.0, 110.0, 95.0, 40.0, 180.0, 80.0, 30.0, 0.5)
    for bad in ({"name": "loud"}, {"onset_delta": -0.1}, {"volume": 3}):
        with pytest.raises(ValueError):
            detectors.profile(**bad)
