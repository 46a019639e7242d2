"""The MIDI data source: round trips, merged folders, and a write that fails leaves nothing."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from staveforge.plans import catalog
from staveforge.sources import midi_files as MF
from staveforge.sources import smf

NOTE = "path string, track int, track_name string, start_tick long, end_tick long, pitch_midi int, velocity int, channel int"
ORDER = ["tick", "priority", "channel", "pitch"]


def plain_merge(content, single):
    """Events of the merged track as (tick, raw), by the rule alone."""
    events = list(smf.parse(content))
    rank = {"tempo": 1, "time_signature": 1, "key_signature": 1, "text": 2, "meta": 2, "note_off": 4, "note_on": 5}
    body = [e for e in events if e["kind"] not in ("track_name", "end_of_track")]
    body.sort(key=lambda e: (e["tick"], rank.get(e["kind"], 3), e["track"], e["ord"]))
    raw = lambda e: bytes([e["raw"][0] & 0xF0]) + e["raw"][1:] if single and e["channel"] is not None else e["raw"]
    return [(0, b"\xff\x03\x06merged"), *((e["tick"], raw(e)) for e in body), (max(e["tick"] for e in events), b"\xff\x2f\x00")]


def rich(tracks):
    """A file whose tracks hold every kind of message, running status and ties."""
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), 96)
    for body in tracks:
        out += b"MTrk" + struct.pack(">I", len(body)) + body
    return out


RICH = rich(
    [
        b"\x00\xff\x03\x01A\x00\xff\x51\x03\x07\xa1\x20\x00\xff\x58\x04\x06\x03\x18\x08\x00\xff\x59\x02\x00\x00\x60\xff\x01\x02hi\x00\xff\x2f\x00",
        b"\x00\xff\x03\x01B\x00\xc3\x05\x00\xb3\x07\x64\x00\x93\x3c\x40\x60\x3c\x00\x00\x40\x41\x00\xe3\x00\x40\x60\x83\x40\x00\x00\xf0\x03\x01\x02\xf7\x83\x00\xff\x2f\x00",
        b"\x60\x99\x24\x7f\x00\xd9\x10\x00\xa9\x24\x11\x60\x89\x24\x00\x00\xff\x2f\x00",
    ]
)


@pytest.mark.parametrize("single", [True, False])
def test_merge_of_a_folder(spark, tmp_path, single):
    one = rich([b"\x00\xff\x03\x01A\x00\x90\x3c\x40\x60\x80\x3c\x00\x00\xff\x2f\x00"])
    (tmp_path / "deep").mkdir()
    for name, content in (("a.mid", RICH), ("a_merge.mid", one), ("a_merge_3.mid", one), ("b.MIDI", RICH), ("deep/c.mid", RICH), ("one.mid", one), ("note.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    before = sorted(os.listdir(tmp_path))
    dry = MF.merge_folder(spark, str(tmp_path), recursive=True, dry_run=True, single_channel=single).collect()
    assert sorted(os.listdir(tmp_path)) == before
    assert {(os.path.basename(r.path), r.action, r.output) for r in dry} == {("a.mid", "dry_run", None), ("b.MIDI", "dry_run", None), ("c.mid", "dry_run", None), *((n, "skipped_single_track", None) for n in ("a_merge.mid", "a_merge_3.mid", "one.mid"))}
    got = {os.path.relpath(r.path, tmp_path): r for r in MF.merge_folder(spark, str(tmp_path), recursive=True, single_channel=single).collect()}
    made = {n: os.path.relpath(r.output, tmp_path) for n, r in got.items() if r.output}
    assert made == {"a.mid": "a_merge_2.mid", "b.MIDI": "b_merge.MIDI", "deep/c.mid": "deep/c_merge.mid"}
    for name, out in made.items():
        content = (tmp_path / out).read_bytes()
        assert content[8:14] == struct.pack(">HHH", 0, 1, 96)
        assert [(e["tick"], e["raw"]) for e in smf.parse(content)] == plain_merge(RICH, single)
        r = got[name]
        assert (r.source_tracks, r.output_tracks, r.source_length_ticks, r.output_length_ticks) == (3, 1, 576, 576)
        assert (r.output_note_on, r.output_note_off, r.output_tempos, r.output_time_signatures) == (3, 3, 1, 1) == (r.source_note_on, r.source_note_off, r.source_tempos, r.source_time_signatures)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("_staging")]


def test_scores_split_by_path_come_back(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for k in range(700):
        a = r.randrange(0, 5000)
        rows.append((r.choice(["hot", "hot", "hot", "x/y"]) + ".mid", r.randrange(1, 4), r.choice(["Bass", None]), a, a + r.choice([-5, 0, 1, 200]), r.randrange(128), r.choice([-3, 0, 64, 300]), r.choice([None, 0, 9, 15])))
    notes = spark.createDataFrame(rows, NOTE).repartition(5)
    tempo = spark.createDataFrame([(0, 500000), (960, 16777215), (480, 1)], "tick long, tempo int")
    MF.write_messages(MF.score(notes, tempo), str(tmp_path), ORDER)
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs) == ["hot.mid", "x/y.mid"]
    m = MF.read_messages(spark, str(tmp_path), recursive=True)
    key = lambda p: os.path.relpath(p, tmp_path)
    got = sorted((key(e.path), e.track, e.tick, e.kind, e.channel, e.data1, e.data2) for e in m.where("kind like 'note%'").collect())
    want = [(p, t, a, "note_on", c or 0, n, max(1, min(127, v))) for p, t, _, a, _, n, v, c in rows] + [(p, t, max(b, a + 1), "note_off", c or 0, n, 0) for p, t, _, a, b, n, _, c in rows]
    assert got == sorted(want)
    assert sorted((key(e.path), e.tick, e.tempo) for e in m.where("kind = 'tempo'").collect()) == [(p, *x) for p in ("hot.mid", "x/y.mid") for x in ((0, 500000), (480, 1), (960, 16777215))]
    for p in ("hot.mid", "x/y.mid"):
        ticks = {}
        for e in smf.parse((tmp_path / p).read_bytes()):
            ticks.setdefault(e["track"], []).append((e["tick"], e["kind"]))
        assert all([t for t, _ in v] == sorted(t for t, _ in v) and v[-1][1] == "end_of_track" for v in ticks.values())


def test_one_track_and_muted_notes(spark, tmp_path):
    rows = [("a.mid", 3, "A", 10, 20, 60, 64, 0, None), ("a.mid", 4, "B", 10, 12, 61, 64, 1, True), ("b.mid", 1, "Ab", 5, 5, 62, 1, None, True)]
    notes = spark.createDataFrame(rows, NOTE + ", muted boolean")
    tempo = spark.createDataFrame([(0, 500000), (96, 400000)], "tick long, tempo int")
    for name, one in (("one", True), ("more", False)):
        MF.write_messages(MF.score(notes, tempo, one_track=one), str(tmp_path / name), ORDER)
    assert os.listdir(tmp_path / "one") == ["a.mid"]
    e = list(smf.parse((tmp_path / "one" / "a.mid").read_bytes()))
    assert [(x["format"], x["track"], x["tick"], x["kind"]) for x in e] == [(0, 0, *x) for x in ((0, "track_name"), (0, "tempo"), (10, "note_on"), (20, "note_off"), (96, "tempo"), (96, "end_of_track"))]
    got = {n: [(x["track"], x["tick"], x["kind"], x["text"]) for x in smf.parse((tmp_path / "more" / n).read_bytes()) if x["kind"] != "tempo"] for n in ("a.mid", "b.mid")}
    lead = [(0, 0, "track_name", "Conductor"), (0, 96, "end_of_track", None)]
    assert got["a.mid"] == [*lead, (1, 0, "track_name", "A"), (1, 10, "note_on", None), (1, 20, "note_off", None), (1, 20, "end_of_track", None), (2, 0, "track_name", "B"), (2, 0, "end_of_track", None)]
    assert got["b.mid"] == [*lead, (1, 0, "track_name", "Ab"), (1, 0, "end_of_track", None)]
    names = spark.createDataFrame([(1, " a/b  c! "), (12, "Über-_x"), (3, None), (4, "__")], "i int, name string").select(MF.track_file(F.col("i"), F.col("name")).alias("f")).collect()
    assert [x.f for x in names] == ["01_a_b_c.mid", "12_Über-_x.mid", "03_.mid", "04_.mid"]


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    rows = [("a.mid", 1, "A", 0, 1, 60, 64, 0), ("b.mid", 1, "B", 0, 1, None, 64, 0)]  # a null pitch has no bytes
    notes = spark.createDataFrame(rows, NOTE)
    tempo = spark.createDataFrame([(0, 500000)], "tick long, tempo int")
    with pytest.raises(Exception):  # noqa: B017 - the kind is Spark's own
        MF.write_messages(MF.score(notes, tempo), str(tmp_path), ORDER)
    assert os.listdir(tmp_path) == []


def test_tempo_maps_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(MF, "TEMPO_CHANGES", 3)
    notes = spark.createDataFrame([("a.mid", 1, "A", 0, 1, 60, 64, 0)], NOTE)
    for n in (0, 4):
        with pytest.raises(ValueError):
            MF.score(notes, spark.range(n).select(F.col("id").alias("tick"), F.lit(500000).alias("tempo")))


def test_empty_folder_and_remote_paths(spark, tmp_path):
    assert MF.read_messages(spark, str(tmp_path)).count() == 0
    assert MF.merge_folder(spark, str(tmp_path)).count() == 0
    assert MF.mounted("file:///a/b") == "/a/b" and MF.mounted("file:/a") == "/a"
    with pytest.raises(ValueError):
        MF.mounted("s3a://bucket/x")


def test_query(spark):
    rows = catalog.QUERIES["s5_m25_folder_merge"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.alike and r.output_tracks == 1 and r.source_tracks > 1 for r in rows)
