"""Completion regions against a plain loop over the notes of a recording."""

import math
import random
import statistics
from collections import Counter

import pytest

from staveforge.operators import regions
from staveforge.operators.timejoin import preceding
from staveforge.plans import catalog, pack_queries
from staveforge.sources.adapters import Tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def evidence(a, b, runs, tones):
    parts = [(max(a, r["start_sec"]), min(b, r["end_sec"]), r["onset_count"]) for r in runs if r["start_sec"] < b and r["end_sec"] > a]
    hits = sum(t["start_sec"] < b and t["end_sec"] > a and t["dominant_pitch"] is not None and t["voiced_ratio"] >= 0.2 for t in tones)
    ratio, onsets = sum(e - s for s, e, _ in parts) / max(1e-6, b - a), sum(p[2] for p in parts)
    if ratio < 0.18 and onsets < 1 and hits < 2:
        return None
    why = "strong_audio_activity" if ratio >= 0.4 and onsets else "onset_evidence" if onsets else "pitch_contour_evidence" if hits >= 2 else "activity_evidence"
    return min((p[0] for p in parts), default=a), max((p[1] for p in parts), default=b), onsets, f"long_gap_with_{why}"


def key_of(pitches):
    if len(pitches) < 3:
        return "unknown"
    classes = [p % 12 for p in pitches]
    root = Counter(classes).most_common(1)[0][0]
    major, minor = (len({(root + s) % 12 for s in steps} & set(classes)) for steps in ((0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)))
    return f"{NAMES[root]} {'minor' if minor > major else 'major' if major > minor else 'modal'} (estimated)"


def steps_of(notes):
    return [round(y["start_sec"] - x["start_sec"], 6) for x, y in zip(notes, notes[1:]) if y["start_sec"] > x["start_sec"]]


def plain(notes, runs, tones, duration):
    order = lambda n: (n["start_sec"], n["end_sec"], n["pitch_midi"], n["note_id"])
    notes = sorted(notes, key=order)
    if len(notes) < 2:
        return []
    usual = statistics.median([d for n in notes if (d := n["end_sec"] - n["start_sec"]) > 0] or [0.25])
    onset = statistics.median([d for x, y in zip(notes, notes[1:]) if (d := y["start_sec"] - x["start_sec"]) > 0] or [usual])
    least, longest = max(0.14, usual * 0.75, onset * 0.9), max(0.75, min(10.0, onset * 12))
    merged = []
    for a, b in [*((x["end_sec"], y["start_sec"]) for x, y in zip(notes, notes[1:])), (notes[-1]["end_sec"], duration)]:
        if b - a < least or not (e := evidence(a, b, runs, tones)):
            continue
        s, t = max(a, e[0]), min(b, e[1])
        s, t = (a, b) if t <= s + 0.04 else (s, t)
        t = min(t, s + longest)
        if t <= s + 0.08:
            continue
        if merged and round(s - merged[-1][1], 9) <= 0.1:  # binary rounding aside, as writable() states
            m = merged[-1]
            m[1], m[2] = max(m[1], t), m[2] + e[2]
            m[3] = e[3] if "strong" in e[3] and "strong" not in m[3] else m[3]
        else:
            merged.append([s, t, e[2], e[3]])
    out = []
    for k, (s, t, heard, why) in enumerate(merged, 1):
        s, t = max(0.0, s), min(duration, t)
        if t <= s + 0.08:
            continue
        before = sorted((n for n in notes if max(0.0, s - 5) <= n["end_sec"] <= s), key=lambda n: n["end_sec"])[-24:]
        after = [n for n in notes if t <= n["start_sec"] <= min(duration, t + 5)][:24]
        local = before + after or sorted(notes, key=lambda n: min(abs(n["start_sec"] - s), abs(n["end_sec"] - t)))[:24]
        pitches, b = [n["pitch_midi"] for n in local], sorted(before, key=order)
        motif = (b[-4:] + after[:4]) if b and after else b[-6:] if b else after[:6]
        intervals = steps_of(sorted(before + after, key=order))[:24]
        mp, rhythm = [n["pitch_midi"] for n in motif], steps_of(motif) or intervals[:8]
        mi = [y - x for x, y in zip(mp, mp[1:])]
        sure = (0.35 if len(b) >= 4 else 0.2 if len(b) >= 2 else 0) + (0.35 if len(after) >= 3 else 0.2 if after else 0)
        sure += (0.2 if Counter(mi).most_common(1)[0][1] >= 2 else 0.1) if mi else 0
        sure += (0.1 if statistics.pstdev(rhythm) <= 0.25 else 0) if len(rhythm) >= 2 else 0.05 if rhythm else 0
        sure = min(1.0, round(sure, 3))
        optional = sure < 0.45 or len(b) < 2 or not after
        middle = statistics.median([d for n in local if (d := n["end_sec"] - n["start_sec"]) > 0] or [usual])
        lo, hi = max(0.05, min(0.5, middle * 0.45)), min(max(1.2, t - s), max(0.3, middle * 3.2))
        w0, w1 = max(0.0, s - 3), min(duration, t + 3)
        density = sum(n["start_sec"] < w1 and n["end_sec"] > w0 for n in notes) / max(0.25, w1 - w0)
        size = max(0.1, t - s)
        centre = max(density * size, min(8.0, heard)) if heard else density * size
        fewest = 0 if optional else 1 if centre >= 1 and math.floor(centre * 0.4) == 0 else math.floor(centre * 0.4)
        most = max(fewest, min(24, math.ceil(centre * 1.8) + 1))
        beat = statistics.median(intervals) if intervals else 0
        limit = max(0.35, min(8.0, max(density * 1.7, 1.2 / max(0.05, beat) if beat > 0 else 0, most / size)))
        low, high = max(0, min(pitches)), min(127, max(pitches))
        ordered = sorted(local, key=order)
        onsets = [round(n["start_sec"], 6) for n in ordered[:24]]
        out.append(
            {
                "region_id": f"acr_{k:04d}", "reason": why, "before": [n["note_id"] for n in before], "after": [n["note_id"] for n in after], "pitch_set": sorted(set(pitches)), "lowest": low, "highest": high,
                "preferred": [p for p, _ in Counter(pitches).most_common(8)], "forbidden": ([low - 1] if low > 0 else []) + ([high + 1] if high < 127 else []), "key_name": key_of(pitches), "motif_pitches": mp, "motif_intervals": mi, "optional": optional,
                "least_notes": fewest, "most_notes": most, "start_sec": s, "end_sec": t, "context_start_sec": max(0.0, s - 5), "context_end_sec": min(duration, t + 5), "motif_confidence": sure, "density_limit": limit, "min_duration": lo, "max_duration": lo + 0.1 if hi <= lo else hi,
                "intervals": intervals, "motif_rhythm": rhythm, "onsets": onsets, "onset_gaps": [y - x for x, y in zip(onsets, onsets[1:])],
            }
        )
    return out


def check(found, notes, runs, tones, lengths):
    rec = lambda rows: {k: [r.asDict() for r in rows if r.recording_id == k] for k in {r.recording_id for r in rows}}
    got, n, r, t = rec(found), rec(notes), rec(runs), rec(tones)
    total = 0
    for x in lengths:
        want = plain(n.get(x.recording_id, []), r.get(x.recording_id, []), t.get(x.recording_id, []), x.duration_sec)
        mine = sorted(got.get(x.recording_id, []), key=lambda g: g["region_id"])
        assert len(mine) == len(want), x.recording_id
        total += len(want)
        for g, w in zip(mine, want):
            for c, v in w.items():
                if isinstance(v, float) or c in ("intervals", "motif_rhythm", "onsets", "onset_gaps"):
                    assert g[c] == pytest.approx(v, abs=2.1e-6), (x.recording_id, w["region_id"], c)
                else:
                    assert g[c] == v, (x.recording_id, w["region_id"], c)
    assert total == len(found)
    return total


def test_fixture(spark):
    t = Tables(spark, SF)
    parts = [df.cache() for df in (t.notes.select("recording_id", "note_id", "start_sec", "end_sec", "pitch_midi"), pack_queries._runs(t), pack_queries._tones(t), pack_queries._lengths(t))]
    assert check(regions.completion_regions(*parts).collect(), *[df.collect() for df in parts]) > 3
    assert len(catalog.QUERIES["m18_completion_regions"](spark, SF).collect()) == regions.writable(*parts).count()


def test_random_notes_with_ties_chords_and_lonely_gaps(spark):
    r = random.Random(5)
    notes, runs, tones, lengths = [], [], [], []
    for rec, n in (("hot", 400), ("b", 60), ("pair", 2), ("single", 1), ("far", 40)):
        at = 0.0
        for k in range(n):
            at += r.choice([0.0, 0.25, 0.25, 0.5, 1.0, 2.5] if rec != "far" else [0.25] * 12 + [14.0])
            for twin in range(r.choice([1, 1, 2])):
                notes.append((rec, f"n{k:04d}{twin}", at, at + r.choice([0.1, 0.2, 0.4, 0.8]), r.choice([0, 40, 43, 45, 47, 127])))
        end = at + r.choice([0.0, 3.0, 16.0]) + 1.0
        lengths.append((rec, end))
        for k in range(int(end * 2)):
            if r.random() < 0.5:
                runs.append((rec, k / 2 + 0.05, k / 2 + r.choice([0.1, 0.3, 0.5]), r.choice([0, 0, 1, 2])))
            if k % 2 == 0:
                tones.append((rec, k / 2, k / 2 + 1, r.choice([None, 40, 41]), r.choice([0.1, 0.9])))
    # A gap of 30 s with evidence in its middle alone: nothing within 5 s of the region.
    for k in range(30):
        notes.append(("lonely", f"n{k:04d}0", k * 0.1 + (40.0 if k > 12 else 0.0), k * 0.1 + 0.05 + (40.0 if k > 12 else 0.0), 50 + k % 5))
    runs.append(("lonely", 20.0, 20.5, 3))
    lengths.append(("lonely", 43.0))
    parts = [
        spark.createDataFrame(notes, "recording_id string, note_id string, start_sec double, end_sec double, pitch_midi int").repartition(4),
        spark.createDataFrame(runs, "recording_id string, start_sec double, end_sec double, onset_count long"),
        spark.createDataFrame(tones, "recording_id string, start_sec double, end_sec double, dominant_pitch int, voiced_ratio double"),
        spark.createDataFrame(lengths, "recording_id string, duration_sec double"),
    ]
    found = regions.completion_regions(*parts).collect()
    assert check(found, *[df.collect() for df in parts]) > 20
    lonely = [x for x in found if x.recording_id == "lonely" and not x.before and not x.after]
    assert len(lonely) == 1 and len(lonely[0].pitch_set) == 5
    assert {x.optional for x in found} == {True, False}


def test_preceding_carries_over_buckets(spark):
    r = random.Random(9)
    rows = [(k % 3, round(r.uniform(-50, 900), 1), i) for i, k in enumerate(r.choices(range(3), [8, 1, 1], k=300))]
    got = preceding(spark.createDataFrame(rows, "k int, at double, i int").repartition(5), ["k"], "at", ["at", "i"], F.col("i"), "prev", 7.0).collect()
    for k in range(3):
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        assert sorted((x.at, x.i, x.prev) for x in got if x.k == k) == [(a, i, own[n - 1][2] if n else None) for n, (_, a, i) in enumerate(own)]
