"""Admission of notes against a plain loop that counts as it goes."""

import random
from collections import Counter, defaultdict

from staveforge.operators import admission as A
from staveforge.plans import admission_queries as Q
from staveforge.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def loop(notes, base, regions, limit):
    """Verdicts by note id, one note after the other."""
    regions = sorted(regions, key=lambda r: r["region_no"])
    counts, total, out = Counter(), 0, {}

    def rule(n):
        s, e = n["start_sec"], n["end_sec"]
        if not regions:
            return A.OUTSIDE, None
        home = next((r for r in regions if s >= r["write_start_sec"] and e <= r["write_end_sec"]), None)
        if s < 0 or e < 0:
            return "negative_time", home
        if e <= s:
            return "end_before_or_equal_start", home
        if max(s, e) > limit["duration_sec"]:
            return "outside_project_duration", home
        if e - s < 0.025:
            return "note_too_short", home
        if e - s > 8 and n["confidence"] < 0.9:
            return "note_too_long_low_confidence", home
        if not min(r["low"] for r in regions) <= n["pitch_midi"] <= max(r["high"] for r in regions):
            return "pitch_outside_allowed_range", home
        for b in sorted(base, key=lambda b: (b["start_sec"], b["end_sec"], b["pitch_midi"], b["note_id"])):
            over = min(e, b["end_sec"]) - max(s, b["start_sec"])
            if abs(b["pitch_midi"] - n["pitch_midi"]) <= 1 and over > 0:
                if abs(s - b["start_sec"]) <= 0.03:
                    return "duplicate_base_note_onset", home
                if over / max(1e-6, min(e - s, b["end_sec"] - b["start_sec"])) >= 0.7:
                    return "duplicate_base_note_overlap", home
        if home is None:
            return A.OUTSIDE, None
        if n["pitch_midi"] < home["low"]:
            return "pitch_below_region_range", home
        if n["pitch_midi"] > home["high"]:
            return "pitch_above_region_range", home
        if home["pitches"] and n["pitch_midi"] not in home["pitches"] and not home["any_pitch"]:
            return "pitch_not_in_local_pitch_set", home
        if e - s < home["min_duration"]:
            return "note_too_short", home
        after = counts[home["region_no"]] + 1
        if after > home["most"]:
            return "region_expected_count_exceeded", home
        if after / max(1e-6, home["end_sec"] - home["start_sec"]) > home["density"]:
            return "region_note_density_too_high", home
        return ("max_completion_notes_exceeded" if total >= limit["most_notes"] else None), home

    for n in sorted(notes, key=lambda n: (n["start_sec"], n["end_sec"], n["note_id"])):
        why, home = rule(n)
        if why is None:
            counts[home["region_no"]] += 1
            total += 1
        out[n["note_id"]] = why
    return out


def by_recording(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.recording_id].append(r.asDict())
    return out


def check(got, notes, base, regions, limits):
    want = {(rec, i): why for rec, ns in notes.items() for i, why in loop(ns, base[rec], regions[rec], limits[rec][0]).items()}
    assert {(r.recording_id, r.note_id): r.reason for r in got} == want
    return Counter(want.values())


def test_query_equals_loop(spark):
    t = Tables(spark, SF)
    regions = Q.regions(t).cache()
    rows = A.admit(Q.proposed(t), t.phrases, regions, Q.limits(t)).collect()
    reasons = check(rows, by_recording(Q.proposed(t)), by_recording(t.phrases), by_recording(regions), by_recording(Q.limits(t)))
    assert len(reasons) >= 12 and reasons[None] > 20
    report = {(r.recording_id, r.region_no): r for r in Q.a39(t).collect()}
    assert sum(r.accepted for r in report.values()) == reasons[None] and all((r.accepted > 0) == (r.reason_if_zero is None) for r in report.values())


def test_random_quotas_and_a_hot_recording(spark):
    r = random.Random(7)
    base = [("hot" if k % 2 else "b", f"x{k}", k * 40.0, k * 40.0 + 0.5, 40) for k in range(8)]
    regions = [(rec, k, k * 10.0, k * 10.0 + 9, k * 10.0, k * 10.0 + 9, 38, 50, [], True, 0.03, r.randint(0, 6), r.choice([0.1, 0.3, 2.0])) for rec in ("hot", "b") for k in range(20)]
    notes = [("hot" if r.random() < 0.8 else r.choice("bc"), f"n{k:04d}", s := round(r.uniform(0, 210), 1), round(s + r.choice([0.5, 1.0, 3.0]), 1), 44, 0.5) for k in range(500)]
    limits = spark.createDataFrame([("hot", 215.0, 25), ("b", 215.0, 1000), ("c", 215.0, 5)], "recording_id string, duration_sec double, most_notes long")
    b = spark.createDataFrame([*base, ("c", "x", 0.0, 1.0, 40)], "recording_id string, note_id string, start_sec double, end_sec double, pitch_midi int")
    g = spark.createDataFrame(regions, "recording_id string, region_no int, start_sec double, end_sec double, write_start_sec double, write_end_sec double, low int, high int, pitches array<int>, any_pitch boolean, min_duration double, most int, density double")
    n = spark.createDataFrame(notes, "recording_id string, note_id string, start_sec double, end_sec double, pitch_midi int, confidence double").repartition(3)
    reasons = check(A.admit(n, b, g, limits, bucket=7.0).collect(), by_recording(n), by_recording(b), by_recording(g), by_recording(limits))
    assert reasons["max_completion_notes_exceeded"] and reasons["region_expected_count_exceeded"] and reasons["region_note_density_too_high"] and reasons[A.OUTSIDE]
    assert A.admit(n.limit(0), b, g, limits).count() == 0
