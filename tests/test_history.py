"""Undo and redo against plain stacks that hold whole states."""

import random
from collections import defaultdict

import pytest

from staveforge.operators import history as H
from staveforge.plans import catalog, history_queries
from staveforge.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def stacks(kinds, limit):
    """(edit of every entry, edits in force at the end); an edit off the stack stays in force."""
    undo, redo, out, force = [], [], [], set()
    for no, kind in kinds:
        edit = None
        if kind == "edit":
            undo, redo, edit = [*undo, no][-limit:], [], no
            force.add(no)
        elif kind == "undo" and undo:
            *undo, edit = undo
            redo.append(edit)
            force.discard(edit)
        elif kind == "redo" and redo:
            *redo, edit = redo
            undo.append(edit)
            force.add(edit)
        out.append((no, edit))
    return out, force


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_random_scripts(spark, limit):
    r = random.Random(limit)
    rows = []
    for s in range(40):
        rows += [(f"s{s}", k, r.choices(["edit", "undo", "redo", "note"], [4, 4, 3, 1])[0]) for k in range(1, r.randint(1, 60) if s else 3000)]
    df = spark.createDataFrame(rows, "session string, entry long, kind string").repartition(5)
    res = H.resolve(df, ["session"], limit).cache()
    by = defaultdict(list)
    for s, k, kind in sorted(rows):
        by[s].append((k, kind))
    want = {s: stacks(x, limit) for s, x in by.items()}
    assert sorted((x.session, x.entry, x.edit) for x in res.collect()) == sorted((s, k, e) for s, (out, _) in want.items() for k, e in out)
    assert sorted((x.session, x.edit) for x in H.live_edits(res, ["session"]).collect()) == sorted((s, e) for s, (_, force) in want.items() for e in force)
    half = spark.createDataFrame([(s, len(x) // 2) for s, x in by.items()], "session string, version long")
    upto = {s: stacks([y for y in x if y[0] <= len(x) // 2], limit)[1] for s, x in by.items()}
    assert sorted((x.session, x.edit) for x in H.live_edits(res, ["session"], half).collect()) == sorted((s, e) for s, force in upto.items() for e in force)
    if limit == 100:
        assert all(x.undoable >= 0 for x in H.depth(res.where("session <> 's0'"), ["session"]).collect())
    assert H.resolve(df.limit(0), ["session"]).count() == 0


def test_notes_after_the_log(spark):
    t = Tables(spark, SF)
    base = defaultdict(dict)
    for r in history_queries.base(t).collect():
        base[r.recording_id][r.note_id] = (r.pitch_midi, r.start_sec)
    log = defaultdict(list)
    for r in sorted(history_queries.log(t).collect(), key=lambda r: (r.recording_id, r.entry)):
        log[r.recording_id].append(r)
    want = []
    for rec, entries in log.items():
        _, force = stacks([(r.entry, r.kind) for r in entries], H.LIMIT)
        notes = dict(base[rec])
        for r in entries:
            if r.entry in force:
                notes.pop(r.note_id, None) if r.gone else notes.update({r.note_id: (r.pitch_midi, r.start_sec)})
        want += [(rec, n, *v) for n, v in notes.items()]
    got = [tuple(r) for r in catalog.QUERIES["d12_notes_after"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
