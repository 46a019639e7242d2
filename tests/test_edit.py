"""Note edits over whole recordings, against plain loops."""

from collections import defaultdict

from staveforge.plans import catalog
from staveforge.sources.adapters import Tables

from conftest import SF


def test_edits_read_every_note(spark):
    rows, groups, recs = Tables(spark, SF).notes.collect(), defaultdict(list), defaultdict(list)
    for n in rows:
        groups[n.recording_id, n.track_index, n.channel, n.pitch_midi].append(n)
        recs[n.recording_id].append(n)
    assert any(n.pitch_midi % 10 for n in rows)
    want = {(*k, min((n.start_tick, n.note_id) for n in g)[1] + "_merged", min(n.start_tick for n in g), max(n.end_tick for n in g), len(g)) for k, g in groups.items() if len(g) > 1}
    got = catalog.QUERIES["d9_merge_all_notes"](spark, SF).select("recording_id", "track_index", "channel", "pitch_midi", "note_id", "start_tick", "end_tick", "merged")
    assert {tuple(r) for r in got.collect()} == want
    want = set()
    for k, g in recs.items():
        length = max(1, max(n.end_tick for n in g) - min(n.start_tick for n in g))
        want |= {(k, f"{n.note_id}_c{i}", n.start_tick + i * length) for n in g for i in (1, 2, 3)}
    assert {tuple(r) for r in catalog.QUERIES["d15_d17_loop_recordings"](spark, SF).collect()} == want
    want = {(k, len(g), min(n.velocity for n in g), round(sum(n.velocity for n in g) / len(g)), max(n.velocity for n in g)) for k, g in recs.items()}
    assert {tuple(r) for r in catalog.QUERIES["a32_recording_velocity"](spark, SF).collect()} == want


def test_first_clash_equals_a_plain_loop_and_makes_no_pairs(spark):
    import random

    from staveforge.operators import edit as ED

    r = random.Random(5)
    note = lambda k, i: ("a", f"{k}{i:04d}", r.randrange(3), *((t := r.randrange(400) / 64), t + r.choice([0.05, 0.2, 0.5, 3.0])))
    a, b = [note("n", i) for i in range(150)], [note("b", i) for i in range(150)]
    schema = "recording_id string, note_id string, pitch_midi int, start_sec double, end_sec double"
    out = ED.first_clash(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    want = {}
    for _, i, p, s, e in a:
        for _, _, q, x, y in sorted(b, key=lambda z: (z[3], z[1])):
            if y > s and x < e:
                reason = "duplicate" if p == q and abs(s - x) <= 0.02 else "collision" if (min(e, y) - max(s, x)) / min(e - s, y - x) >= 0.65 else None
                if reason:
                    want[i] = reason
                    break
    assert {x.note_id: x.reason for x in out.collect()} == want and len(set(want.values())) == 2
    assert "Join" not in catalog.QUERIES["j23_collision"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
