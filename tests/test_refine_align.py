"""Scenarios on 10 ms frames: alignment, refinement and activity regions."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from staveforge.operators import align as AL
from staveforge.operators import islands as IS
from staveforge.operators import refine as R
from staveforge.plans import note_queries


def frames(spark, rms, seconds=4.0, step=0.01, onset=lambda t: 0.0):
    n = int(seconds / step)
    return spark.createDataFrame([("r", i, i * step, (i + 1) * step, float(rms(i * step)), float(onset(i * step))) for i in range(n)], "recording_id string, frame_index int, start_sec double, end_sec double, rms double, onset_score double")


def notes(spark, *rows):
    return spark.createDataFrame([("r", f"n{i}", p, a, b, 0.8) for i, (p, a, b) in enumerate(rows)], "recording_id string, note_id string, pitch_midi int, start_sec double, end_sec double, confidence double")


def span(*parts):
    return lambda t: next((v for a, b, v in parts if a <= t + 1e-9 < b), 0.0)


# name: (level over time, notes as (pitch, start, end)); all run in one pass, a recording each.
SCENARIOS = {
    "attack": (lambda t: min(1.0, max(0.0, (t - 0.95) / 0.05)) * 0.08 if t < 1.2 else 0.0, [(45, 1.0, 1.2)]),
    "merge": (span((0.95, 1.45, 0.08)), [(45, 1.0, 1.2), (45, 1.24, 1.4)]),
    "silence": (span((0.95, 1.2, 0.08), (1.35, 1.6, 0.08)), [(45, 1.0, 1.2), (45, 1.35, 1.5)]),
    "tail": (span((1.0, 1.6, 0.09)), [(45, 1.0, 1.2)]),
    "cap": (span((1.0, 3.5, 0.09)), [(45, 1.0, 1.2)]),
    "short": (span((0.9, 1.04, 0.08)), [(45, 1.0, 1.03)]),
    "overlap": (span((0.9, 1.6, 0.08)), [(45, 1.0, 1.3), (47, 1.2, 1.5)]),
}


def test_refinement_scenarios(spark):
    fr = [(k, i, i * 0.01, (i + 1) * 0.01, float(level(i * 0.01)), 0.0) for k, (level, _) in SCENARIOS.items() for i in range(400)]
    ns = [(k, f"{k}{i}", p, a, b, 0.8) for k, (_, rows) in SCENARIOS.items() for i, (p, a, b) in enumerate(rows)]
    f = spark.createDataFrame(fr, "recording_id string, frame_index int, start_sec double, end_sec double, rms double, onset_score double")
    n = spark.createDataFrame(ns, "recording_id string, note_id string, pitch_midi int, start_sec double, end_sec double, confidence double")
    r = {x.note_id: x for x in R.refine(n, f).collect()}
    assert 0.92 <= r["attack0"].start_sec <= 0.96 and "ATTACK_START_ADJUSTED" in r["attack0"].actions
    assert "merge1" not in r and r["merge0"].merged == ["merge1"] and "FALSE_RETRIGGER_MERGED" in r["merge0"].actions
    assert {"silence0", "silence1"} <= set(r)
    assert 1.5 <= r["tail0"].end_sec <= 1.6 + 1e-9 and "SUSTAIN_TAIL_EXTENDED" in r["tail0"].actions
    assert r["cap0"].end_sec <= 2.1 + 1e-9
    assert r["short0"].end_sec - r["short0"].start_sec >= 0.08 - 1e-9
    assert r["overlap0"].end_sec <= r["overlap1"].start_sec + 1e-9 and "MONOPHONIC_OVERLAP_RESOLVED" in r["overlap0"].actions


def test_alignment_snaps_to_the_pulse(spark):
    f = frames(spark, span((1.0, 1.3, 0.2)), onset=span((1.0, 1.01, 0.5)))
    p = AL.Parameters(onset_window=0.6, max_start_correction=0.6)
    a = AL.align(notes(spark, (40, 1.5, 1.8)), f, p).first()
    assert a.alignment_action == "ALIGNED" and abs(a.aligned_start_sec - 1.0) < 0.04
    a = AL.align(notes(spark, (40, 0.5, 0.7)), frames(spark, lambda t: 0.0, 1.5), AL.Parameters()).first()
    assert a.alignment_action == "NO_AUDIO_EVIDENCE" and a.aligned_start_sec == 0.5


def test_global_offset(spark):
    f = frames(spark, span((1.0, 1.3, 0.2)), onset=span((1.0, 1.01, 0.5)))
    n = notes(spark, (40, 3.0, 3.25))
    o = AL.global_offset(n, AL.onset_evidence(f, 0.005, 0.001), 3.0, 0.02)
    r = o.first()
    assert abs(r.offset_sec + 2.0) <= 0.12
    a = AL.align(n, f, AL.Parameters(), o).first()
    assert a.alignment_action == "ALIGNED" and abs(a.aligned_start_sec - 1.0) < 0.05


def plain_offset(onsets, evidence):
    """The reference's search in plain steps, on its production grid."""
    top, best = max(w for _, w in evidence), (-1.0, 0)
    for i in range(301):
        score = met = 0
        for x in onsets:
            d, _, w = min((abs(t - (x + (-3.0 + 0.02 * i))), -t, w) for t, w in evidence)
            if d <= 0.08:
                score, met = score + w / top * (1 - d / 0.08), met + 1
        c = round((0.7 * score + 0.3 * met) / len(onsets), 9)
        best = max(best, (c, -i))
    return -best[1], best[0]


def test_offset_search_on_the_whole_grid(spark):
    r, fr, ns, want = random.Random(6), [], [], {}
    for k, shift in enumerate((-2.34, -1.5, 0.06, 1.28, 2.9)):
        peaks = sorted(r.sample(range(320, 900, 7), 12))
        rms = [0.4 + 0.03 * (peaks.index(i) + 1) if i in peaks else 0.0 for i in range(1000)]
        fr += [(f"r{k}", i, i * 0.01, (i + 1) * 0.01, v, v) for i, v in enumerate(rms)]
        on = [i * 0.01 - shift for i in peaks]
        ns += [(f"r{k}", f"n{i}", 40, x, x + 0.05, 0.8) for i, x in enumerate(on)]
        want[f"r{k}"] = (*plain_offset(on, [(i * 0.01, 3 * rms[i]) for i in peaks]), shift)
    f = spark.createDataFrame(fr, "recording_id string, frame_index int, start_sec double, end_sec double, rms double, onset_score double")
    n = spark.createDataFrame(ns, "recording_id string, note_id string, pitch_midi int, start_sec double, end_sec double, confidence double")
    t = SimpleNamespace(notes=n, frames=f)
    got = {x.recording_id: x for x in note_queries.j11_search(t).collect()}
    assert got.keys() == want.keys()
    for k, (step, confidence, shift) in want.items():
        assert got[k].step_no == step and got[k].confidence == pytest.approx(confidence, abs=2e-6) and abs(got[k].offset_sec - shift) < 0.011
    starts = {(x.recording_id, x.note_id): x.start_sec for x in n.collect()}
    for x in note_queries.m1(t).collect():
        assert x.alignment_action in ("ALIGNED", "REVIEW_TIMING") and abs(x.aligned_start_sec - starts[x.recording_id, x.note_id] - want[x.recording_id][2]) < 0.45


def plain_regions(fr, hold, least, gap, ratio=0.18):
    """The state machine in plain steps."""
    th = max(1e-6, ratio * max(f[2] for f in fr), 0.6 * sum(f[2] for f in fr) / len(fr))
    out, cur, quiet = [], None, None
    for s, e, v, o in fr:
        if v >= th:
            cur = cur or [s, e, v, [], 0]
            cur[1], cur[2], quiet = e, max(cur[2], v), None
        elif cur is None:
            continue
        else:
            quiet = s if quiet is None else quiet
            if e - quiet >= hold:
                out.append(cur)
                cur = quiet = None
                continue
            cur[1] = e
        cur[3].append(v)
        cur[4] += o > 0
    out += [cur] if cur else []
    got = []
    for r in (r for r in out if r[1] - r[0] >= least or r[4] > 0):
        mean = sum(r[3]) / len(r[3])
        if got and max(0.0, r[0] - got[-1][1]) <= gap:
            p = got[-1]
            d = max(1e-6, p[1] - p[0] + r[1] - r[0])
            got[-1] = [p[0], max(p[1], r[1]), max(p[2], r[2]), (p[3] * (p[1] - p[0]) + mean * (r[1] - r[0])) / d, p[4] + r[4]]
        else:
            got.append([r[0], r[1], r[2], mean, r[4]])
    return got


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_regions_equal_the_state_machine(spark, seed):
    r = random.Random(seed)
    rows, plain = [], {}
    for k in range(30):
        t, fr = 0.0, []
        for i in range(60):
            e = t + r.choice([0.02, 0.05, 0.1])
            v, o = r.choice([0.0, 0.01, 0.3, 0.5]), r.choice([0.0, 0.0, 1.0])
            fr.append((t, e, v, o))
            rows.append((f"r{k}", i, t, e, v, o))
            t = e
        plain[f"r{k}"] = plain_regions(fr, 0.12, 0.05, 0.06)
    df = spark.createDataFrame(rows, "recording_id string, frame_index int, start_sec double, end_sec double, energy double, onset double")
    got: dict = {}
    for x in IS.hysteresis_regions(df, ["recording_id"], 0.12, 0.05, 0.06).orderBy("recording_id", "start_sec").collect():
        got.setdefault(x.recording_id, []).append([x.start_sec, x.end_sec, x.peak_energy, x.mean_energy, x.onset_count])
    assert got.keys() == {k for k in plain if plain[k]}
    for k in got:
        assert [[pytest.approx(v) for v in x] for x in plain[k]] == got[k]


def test_regions_of_the_fixture_scenarios(spark):
    def count(silent):
        vals = [0.5] * 5 + [0.0] * silent + [0.5] * 5
        df = spark.createDataFrame([("r", i, i * 0.02, (i + 1) * 0.02, v, 0.0) for i, v in enumerate(vals)], "recording_id string, frame_index int, start_sec double, end_sec double, energy double, onset double")
        return IS.hysteresis_regions(df, ["recording_id"], 0.0, 0.05, 0.06).count()

    assert count(2) == 1 and count(10) == 2
    assert IS.merge_spans(notes(spark, (1, 0.0, 1.0), (1, 0.5, 2.0), (1, 2.0, 3.0)), ["recording_id"]).count() == 1
    assert F is not None


def test_dense_recording_is_refined_without_pairs(spark):
    """20,000 notes and frames inside a second: each attack would meet all frames before it, and all notes are near in time."""
    f = spark.range(20000).selectExpr("'a' AS recording_id", "id / 20000 AS start_sec", "(id + 1) / 20000 AS end_sec", "(id * 7919 % 20000) / 20000D AS rms")
    n = spark.range(20000).selectExpr("'a' AS recording_id", "concat('n', id) AS note_id", "cast(id % 100 AS int) AS pitch_midi", "id / 20000 AS start_sec", "id / 20000 + 0.05 AS end_sec", "0.5D AS confidence")
    began = time.time()
    assert R.attack_starts(n.selectExpr("*", "cast(array() AS array<string>) AS actions"), f, R.Parameters(attack_lookback=1.0)).count() == 20000
    r = R.refine(n, f).selectExpr("count(*) AS c", "sum(1 + size(merged)) AS m", "min(end_sec - start_sec) AS d").first()
    assert r.m == 20000 and 0 < r.c < 20000 and r.d >= 0
    assert time.time() - began < 100


@pytest.mark.parametrize("seed", [3, 4])
def test_attacks_equal_a_plain_loop(spark, seed):
    r, p = random.Random(seed), R.Parameters(attack_lookback=0.5, max_attack_advance=0.4, attack_ratio=0.5, min_attack_rise=0.05)
    starts = sorted({r.randrange(160) / 16 for _ in range(90)})
    for overlapping in (False, True):
        fr = [("a", s, s + r.randrange(20) / 16 if overlapping else e, r.choice([0.0, 0.1, 0.2, 0.3, 0.5])) for s, e in zip(starts, [*starts[1:], 11.0])]
        ns = [("a", f"n{i}", s, s + 0.1, []) for i in range(60) for s in [r.randrange(170) / 16]]
        f = spark.createDataFrame(fr, "recording_id string, start_sec double, end_sec double, rms double")
        n = spark.createDataFrame(ns, "recording_id string, note_id string, start_sec double, end_sec double, actions array<string>")
        got = {x.note_id: x.start_sec for x in R.attack_starts(n, f, p).collect()}
        for _, k, s, _, _ in ns:
            c = [x for x in fr if x[2] > max(0.0, s - p.attack_lookback) and x[1] <= s]
            th = min(fr, key=lambda x: (abs(x[1] - s), x[1]))[3] * p.attack_ratio
            on = max((i for i, x in enumerate(c) if x[3] > th), default=len(c) - 1)
            first, seen = 0, False
            for i in range(on):
                if c[i + 1][3] - c[i][3] < p.min_attack_rise:
                    first, seen = i + 1, False
                elif c[i + 1][3] > th:
                    seen = True
            want = max(s - p.max_attack_advance, c[first][1]) if seen else s
            assert got[k] == min(s, want)
