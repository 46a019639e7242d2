"""Aggregates over time windows against plain loops, and on a recording so dense that its pairs would not fit."""

import random
import time

import pytest

from staveforge.operators import align as A
from staveforge.operators import validate as V
from staveforge.operators import windows as W

NOTE, FRAME = "recording_id string, note_id string, start_sec double, end_sec double, anchor double", "recording_id string, frame_index int, start_sec double, end_sec double, onset_score double, rms double, is_silent boolean, rise double"


def tables(spark, seed, n, m, overlapping):
    r = random.Random(seed)
    t = lambda hi: r.randrange(hi) / 16
    notes = [("a", f"n{i}", s, s + r.choice([0, 1, 3, 90, 200]) / 16, s) for i in range(n) for s in [t(160)]]
    starts = sorted(t(160) for _ in range(m))
    frames = [("a", i, s, s + t(40) if overlapping else (starts[i + 1] if i + 1 < m else s + 0.25), r.choice([0.0, 0.1, 0.2]), r.choice([0.1, 0.2, 0.5]), r.random() < 0.3, r.choice([-0.1, 0.1, 0.3])) for i, s in enumerate(starts)]
    return notes, frames, spark.createDataFrame(notes, NOTE), spark.createDataFrame(frames, FRAME)


@pytest.mark.parametrize("seed, overlapping", [(1, False), (2, True)])
def test_evidence_and_onsets_equal_plain_loops(spark, seed, overlapping):
    notes, frames, n, f = tables(spark, seed, 60, 80, overlapping)
    ev = {r.note_id: r for r in V.note_evidence(n, f).collect()}
    top = {r.note_id: r.onset_frame for r in V.onset_top1(n, f, 0.5).collect()}
    best = {r.note_id: (r.strong and r.strong.frame_index, r.weak.frame_index) for r in A.best_onsets(n.select("recording_id", "note_id", "anchor"), f, 0.5, 0.1, 0.2).collect()}
    for _, k, s, e, _ in notes:
        over = [x for x in frames if x[3] > s and x[2] < e]
        assert ev[k].n_frames == len(over)
        assert ev[k].max_rms == max((x[5] for x in over), default=0.0)
        assert ev[k].mean_rms == pytest.approx(sum(x[5] for x in over) / max(1, len(over)))
        assert ev[k].sustained == pytest.approx(sum(not x[6] for x in over) / max(1, len(over)))
        near = [x for x in frames if abs(x[2] - s) <= 0.5]
        weak = min(near, key=lambda x: (-x[4], abs(x[2] - s), x[1]))[1] if near else None
        strong = min((x for x in near if x[4] >= 0.1 and x[5] >= 0.2 and x[7] > 0), key=lambda x: (-x[4], -x[7], abs(x[2] - s), x[1]), default=(0, None))[1]
        assert top.get(k) == weak
        assert best.get(k) == ((strong, weak) if near else None)


def test_dense_recording_is_not_paired(spark):
    """30,000 notes and frames inside half a second: 900 million pairs, each of which a join would make."""
    n = spark.range(30000).selectExpr("'a' AS recording_id", "concat('n', id) AS note_id", "id / 60000 AS start_sec", "id / 60000 + 0.5 AS end_sec")
    f = spark.range(30000).selectExpr("'a' AS recording_id", "cast(id AS int) AS frame_index", "id / 60000 AS start_sec", "(id + 1) / 60000 AS end_sec", "(id * 7919 % 30000) / 30000D AS onset_score", "0.5D AS rms", "false AS is_silent")
    began = time.time()
    assert V.onset_top1(n, f, 0.5).selectExpr("count(*) AS c", "max(onset_score) AS m").first() == (30000, 29999 / 30000)
    assert V.note_evidence(n, f).where("mean_rms = 0.5 and n_frames > 0").count() == 30000
    assert time.time() - began < 60


@pytest.mark.parametrize("seed, overlapping", [(3, False), (4, True)])
def test_overlap_and_edges_equal_plain_loops(spark, seed, overlapping):
    notes, frames, n, f = tables(spark, seed, 50, 70, overlapping)
    f = f.selectExpr("*", "frame_index % 5 AS pm")
    by = ["recording_id"]
    stats = {r.note_id: r for r in W.overlap_stats(n, f, by, "note_id", ["rms"], True).collect()}
    best = {r.note_id: r.frame_index for r in W.overlap_best(n, f, by, "note_id", "onset_score", True).collect()}
    mode = {r.note_id: r.pm for r in W.overlap_mode(n, f, by, "note_id", "pm", "rms").collect()}
    count = {r.note_id: r.n for r in W.band_counts(n, f, by, "note_id", 0.4).collect()}
    edge = {r.frame_index: r.id for r in W.nearest_edge(f, n.selectExpr("recording_id", "note_id AS id", "start_sec"), by, "frame_index", ["id"], 0.8).collect()}
    for _, k, s, e, _ in notes:
        over = [x for x in frames if x[3] >= s and x[2] <= e]
        assert (k in stats) == bool(over)
        if over:
            assert (stats[k].n, stats[k].max_rms) == (len(over), max(x[5] for x in over))
            assert stats[k].avg_rms == pytest.approx(sum(x[5] for x in over) / len(over))
            groups = {x[1] % 5 for x in over}
            assert mode[k] == min(groups, key=lambda p: (-round(sum(x[5] for x in over if x[1] % 5 == p), 9), min(x[1] for x in over if x[1] % 5 == p)))
        assert best.get(k) == min(over, key=lambda x: (-x[4], x[1]), default=(0, None))[1]
        assert count.get(k, 0) == sum(abs(x[2] - s) <= 0.4 for x in frames)
    for x in frames:
        near = [(abs(m[2] - x[2]), m[1]) for m in notes if abs(m[2] - x[2]) <= 0.8]
        assert edge.get(x[1]) == min(near, default=(0, None))[1]


@pytest.mark.parametrize("seed", [7, 8])
def test_note_ends_equal_plain_loops(spark, seed):
    r = random.Random(seed)
    starts = sorted(r.randrange(160) / 16 for _ in range(90))
    frames = [("a", s, r.choice([0.1, 0.2, 0.5]), r.choice([0.0, 0.1, 0.2, 0.5])) for s in starts]
    notes = [("a", f"n{i}", e, e - r.choice([0, 3, 9]) / 16, r.choice([0.05, 0.1, 0.2, 0.3])) for i in range(60) for e in [r.randrange(176) / 16]]
    n = spark.createDataFrame(notes, "recording_id string, note_id string, end_anchor double, s double, lim double")
    f = spark.createDataFrame(frames, "recording_id string, start_sec double, rms double, next_rms double")
    got = {x.note_id: x.off for x in A.note_ends(n, f, 0.5).collect()}
    for _, k, e, s, lim in notes:
        best = max(((x[2] <= lim, max(0.0, x[2] - x[3]), -abs(x[1] - e), -x[1]) for x in frames if abs(x[1] - e) <= 0.5 and x[1] >= s), default=None)
        assert got.get(k) == (-best[3] if best and (best[0] or best[1] > 0) else None)


def test_note_ends_of_a_dense_recording_make_no_pairs(spark):
    n = spark.range(30000).selectExpr("'a' AS recording_id", "concat('n', id) AS note_id", "id / 60000 + 0.1 AS end_anchor", "id / 60000 AS s", "id % 7 / 7D AS lim")
    f = spark.range(30000).selectExpr("'a' AS recording_id", "id / 60000 AS start_sec", "(id * 7919 % 30000) / 30000D AS rms", "((id + 1) * 7919 % 30000) / 30000D AS next_rms")
    began = time.time()
    assert A.note_ends(n, f, 0.5).count() == 30000
    assert time.time() - began < 60


def test_both_sides_may_come_from_one_table(spark):
    """m1_align_notes stopped as ambiguous: its notes, joined with offsets, and its frames come from the same events."""
    from staveforge.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["m1_align_notes"](spark, sf).count() == QUERIES["a3_note_evidence"](spark, sf).count()


@pytest.mark.parametrize("seed, overlapping, closed", [(5, False, False), (6, True, False), (7, False, True)])
def test_runs_of_frames_hold_each_pair_once(spark, seed, overlapping, closed):
    notes, frames, n, f = tables(spark, seed, 60, 80, overlapping)
    got = sorted((r.note_id, i) for r in W.overlap_runs(n, f, ["recording_id"], "note_id", closed).collect() for i in range(r.first, r.last + 1))
    over = (lambda x, s, e: x[3] >= s and x[2] <= e) if closed else (lambda x, s, e: x[3] > s and x[2] < e)
    assert got == sorted((k, x[1]) for _, k, s, e, _ in notes for x in frames if over(x, s, e))


@pytest.mark.parametrize("name", ["j30_activity_ratio", "j5_interval_overlap"])
def test_no_join_pairs_notes_with_frames(spark, name):
    from staveforge.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroups" in plan
