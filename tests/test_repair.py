"""Passes of repair: scores never fall, and a recording that gains little stops."""

from staveforge.operators import repair as R

REC = "recording_id string"


def tables(spark):
    notes = spark.createDataFrame([("a", "n1", 60, 0.0, 1.0), ("a", "n2", 60, 2.4, 3.0), ("b", "m1", 64, 0.0, 2.0), ("b", "m2", 64, 2.02, 3.0)], f"{REC}, note_id string, pitch_midi int, start_sec double, end_sec double")
    regions = spark.createDataFrame([("a", 0.0, 1.3, 0.9), ("a", 2.0, 2.3, 0.9), ("a", 4.0, 4.5, 1.0), ("b", 0.0, 3.0, 0.9)], f"{REC}, start_sec double, end_sec double, confidence double")
    frames = [(r, i, i * 0.1, i * 0.1 + 0.1, 0.5 if i < 45 else 0.0, 0.0) for r in "ab" for i in range(60)]
    frames = spark.createDataFrame(frames, f"{REC}, frame_index int, start_sec double, end_sec double, rms double, onset_score double")
    pitch = spark.createDataFrame([(r, i, i * 0.1, i * 0.1 + 0.1, 261.6256 if r == "a" else 329.6276, 0.9, i < 45) for r in "ab" for i in range(60)], f"{REC}, frame_index int, start_sec double, end_sec double, f0_hz double, confidence double, voiced boolean")
    return notes, regions, frames, pitch


def test_phases(spark):
    notes, regions, frames, pitch = tables(spark)
    got = {(r.recording_id, r.start_sec): (r.action, r.target_note_id, r.pitch_midi) for r in R.missing_coverage(regions, notes, pitch, R.Repair()).collect()}
    assert got == {("a", 0.0): ("EXTEND_NOTE", "n1", None), ("a", 2.0): ("CLOSE_GAP", "n2", None), ("a", 4.0): ("INSERT_MISSING_NOTE", None, 60)}
    out = {(r.recording_id, r.note_id): (round(r.start_sec, 6), round(r.end_sec, 6)) for r in R.repair(notes, regions, frames, pitch, R.Repair()).collect()}
    assert out[("a", "n1")] == (0.0, 1.3) and out[("a", "n2")] == (2.0, 3.0) and out[("a", "repair_missing_000001")] == (4.0, 4.5)
    assert out[("b", "m1")] == (0.0, 2.02)  # the gap of 20 ms closes under active audio
    empty = R.repair(notes.where("false"), regions.where("false"), frames, pitch, R.Repair())
    assert empty.count() == 0


def test_passes(spark):
    notes, regions, frames, pitch = tables(spark)
    out, summary = R.iterate(notes, regions, frames, pitch, R.Repair())
    rows = sorted((r.recording_id, r.iteration, r.was, r.now, r.accepted, r.errors) for r in summary.collect())
    before, after = ({r.recording_id: r.total for r in R.score(x, regions, pitch).collect()} for x in (notes, out))
    for rec in "ab":
        total, stopped = before[rec], False
        for _, _, was, now, accepted, errors in (x for x in rows if x[0] == rec):
            assert not stopped and abs(was - total) < 1e-9 and accepted == (now > was)
            total = now if accepted else was
            stopped = accepted and (now - was < 0.005 or errors == 0)
        assert total > before[rec] and abs(after[rec] - total) < 1e-9


def test_a_score_searches_dominant_pitches_once(spark, monkeypatch):
    notes, regions, _, pitch = tables(spark)
    calls, search = [], R.dominant_pitch
    monkeypatch.setattr(R, "dominant_pitch", lambda *a: calls.append(1) or search(*a))
    assert R.score(notes, regions, pitch).count() == 2 and len(calls) == 1


def test_inputs_order_the_events_once(spark):
    """Regions and pitch frames come from the staged frames, not from windows over all events of their own."""
    from staveforge.plans import repair_queries as RQ
    from staveforge.sources.adapters import Tables

    _, regions, frames, pitch = RQ._inputs(Tables(spark, "/root/testdata/sf0.001"))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (regions, frames, pitch)]
    assert not any("Window" in p or "events" in p for p in plans)
    assert pitch.count() == frames.count() > 0


def test_best_row_comes_with_the_average_of_all(spark):
    from staveforge.operators.windows import overlap_best

    f = spark.createDataFrame([("a", i, i * 1.0, i * 1.0, v) for i, v in enumerate([0.25, 1.0, 0.25, 0.5, 9.0, None])], f"{REC}, frame_index int, start_sec double, end_sec double, v double")
    n = spark.createDataFrame([("a", "n", 0.0, 3.5)], f"{REC}, note_id string, start_sec double, end_sec double")
    r = overlap_best(n, f.where("v is not null"), ["recording_id"], "note_id", "v", True, 2.0).collect()
    assert [(x.v, x.frame_index, x.at, x.avg_v) for x in r] == [(1.0, 1, 1.0, 0.5)]
