"""Selection under budgets against plain lists."""

import random
from collections import defaultdict

import pytest

from staveforge.operators import budget as B


def places(size, limit):
    return range(size) if size <= limit else [0] if limit == 1 else sorted({round(k / (limit - 1) * (size - 1)) for k in range(limit)})


def plain(notes, regions, changes, limit):
    """{index: worth} of what stays; notes in order."""
    n, worth = len(notes), {}
    if n <= limit:
        return dict.fromkeys(range(n))

    def mark(i, x):
        if 0 <= i < n:
            worth[i] = max(worth.get(i, 0), x)

    def near(sec):
        return min(range(n), key=lambda i: (abs(notes[i][0] - sec), i))

    for i in range(n):
        if i < 24 or i >= n - 24:
            mark(i, 1000)
    for s, e, _, _ in sorted(regions, key=lambda r: (-r[2], -r[3], r[0]))[: max(6, min(len(regions), max(1, limit // 6)))]:
        own = [i for i in range(n) if notes[i][0] < e and notes[i][1] > s]
        if own:
            mark(own[0], 900), mark(own[-1], 900), mark(own[len(own) // 2], 920)
        else:
            i = near((s + e) / 2)
            mark(i, 880), mark(i - 1, 820), mark(i + 1, 820)
    for sec in changes:
        i = near(sec)
        mark(i, 860), mark(i - 1, 810), mark(i + 1, 810)
    for i in places(n, limit):
        mark(i, 600)
    return {i: worth[i] for i in sorted(worth, key=lambda i: (-worth[i], i))[:limit]}


@pytest.mark.parametrize("limit", [1, 70, 180])
def test_notes_of_a_hot_and_a_small_recording(spark, limit):
    r = random.Random(limit)
    notes, regions, changes = defaultdict(list), defaultdict(list), defaultdict(list)
    for rec, size in (("hot", 900), ("mid", 200), ("small", 60), ("one", 1)):
        for k in range(size):
            s = round(float(r.choice([r.uniform(0, 300), r.randint(0, 250)])), 2)
            notes[rec].append((s, round(s + r.choice([0.1, 0.5, 20.0]), 2), f"n{k:04d}"))
        for k in range(60 if size > 1 else 2):
            s = round(r.uniform(0, 400), 3)
            regions[rec].append((s, round(s + r.choice([0.01, 0.3, 4.0]), 3), round(r.random(), 1), r.randint(0, 2)))
            changes[rec] += [round(r.uniform(0, 320), 3)] if k < 20 else []
    make = lambda d, schema: spark.createDataFrame([(k, *(x if isinstance(x, tuple) else (x,))) for k, v in d.items() for x in v], "recording_id string, " + schema).repartition(3)
    got = defaultdict(dict)
    for x in B.select_notes(make(notes, "start_sec double, end_sec double, note_id string"), make(regions, "start_sec double, end_sec double, rms_peak double, onset_count int"), make(changes, "start_sec double"), limit).collect():
        got[x.recording_id][x["index"]] = (x.note_id, x.worth)
    for rec, ns in notes.items():
        ns = sorted(ns)
        want = plain(ns, regions[rec], changes[rec], limit)
        assert {i: w for i, (_, w) in got[rec].items()} == want, rec
        assert all(ns[i][2] == name for i, (name, _) in got[rec].items())


@pytest.mark.parametrize("limit", [1, 2, 7, 50])
def test_even_places(spark, limit):
    rows = spark.createDataFrame([(f"r{n}", float(k)) for n in (1, 2, 3, 7, 8, 13, 50, 51, 333) for k in range(n)], "recording_id string, start_sec double")
    got = defaultdict(list)
    for x in B.even(B.indexed(rows, ["start_sec"], 9.0), limit).collect():
        got[x.recording_id].append(x["index"])
    assert {k: sorted(v) for k, v in got.items()} == {f"r{n}": list(places(n, limit)) for n in (1, 2, 3, 7, 8, 13, 50, 51, 333)}
