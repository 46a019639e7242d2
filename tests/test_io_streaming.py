"""Round trips of MIDI and WAV files, streams against batch, array functions against plain Python."""

import io
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveforge.functions import exprs as E
from staveforge.operators import midi as MI
from staveforge.sources import drum_maps, smf, wav
from staveforge.streaming import online


def test_midi_round_trip(spark, tmp_path):
    rows = [("a", 0, 480, 60, 100, None, "Bass"), ("a", 480, 480, 62, 300, 3, "Bass"), ("a", 480, 960, 60, 0, 3, "Keys"), ("b", 5, 9, 1, 64, 9, None)]
    notes = spark.createDataFrame(rows, "song string, start_tick long, end_tick long, pitch_midi int, velocity int, channel int, track_name string")
    for r in smf.to_files(notes, ["song"]).collect():
        (tmp_path / f"{r.song}.MID").write_bytes(bytes(r.midi))
    (tmp_path / "c.txt").write_text("x")
    ev = smf.read_events(spark, str(tmp_path)).withColumn("song", F.regexp_extract("path", r"(\w)\.MID$", 1))
    on = {(r.song, r.tick, r.data1, r.data2, r.channel) for r in ev.where("kind = 'note_on'").collect()}
    assert on == {("a", 0, 60, 100, 0), ("a", 480, 62, 127, 3), ("a", 480, 60, 1, 3), ("b", 5, 1, 64, 9)}
    m = ev.where("kind in ('note_on', 'note_off')").select("song", "track", "channel", F.col("data1").alias("pitch"), (F.col("kind") == "note_on").alias("is_on"), "tick", F.col("ord"))
    assert MI.pair_notes(m, ["song", "track", "channel", "pitch"], ["ord"]).count() == 4
    assert {r.tempo for r in ev.where("kind = 'tempo'").collect()} == {500000}
    bad = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 10) + b"\x00\xff\x59\x02\x0f\x07\x00\xff\x2f\x00"
    assert [(e["kind"], e["data1"], e["data2"]) for e in smf.parse(bad)] == [("key_signature", 7, 0), ("end_of_track", None, None)]
    with pytest.raises(ValueError):
        list(smf.parse(b"RIFF"))


def test_fifo_pairs_pass_over_unmatched_offs(spark):
    rows = [("k", 1, False), ("k", 2, True), ("k", 3, True), ("k", 4, False), ("k", 5, False), ("k", 6, False), ("k", 7, True)]
    p = MI.pair_notes(spark.createDataFrame(rows, "key string, ord int, is_on boolean"), ["key"], ["ord"])
    assert {(r.on_ord, r.off_ord) for r in p.collect()} == {(2, 4), (3, 5)}


def test_wav_features(spark, tmp_path):
    rate = 8000
    x = 0.5 * np.sin(2 * math.pi * 110 * np.arange(rate) / rate)
    for name, channels in (("a.wav", 1), ("b.WAV", 2)):
        buf = io.BytesIO()
        with wave.open(buf, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.repeat((x * 32767).astype("<i2"), channels).tobytes())
        (tmp_path / name).write_bytes(buf.getvalue())
    f = wav.read_frames(spark, str(tmp_path), 1024, 512).toPandas()
    assert f.path.nunique() == 2 and len(f) == 2 * (-(-(rate - 1024) // 512) + 1)
    assert abs(f.rms.iloc[3] - 0.5 / 2**0.5) < 0.01 and abs(f.f0_hz.iloc[3] - 110) < 8 and f.pitch_confidence.iloc[3] > 0.5
    assert len(wav.framed(np.zeros(0), 8, 4)) == 1


def test_streams_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 100.0, 1.0), ("a", 100.2, 3.0), ("a", 100.3, 2.0), ("a", 101.0, 1.0), ("b", 100.0, 1.0), ("a", 105.0, 0.1), ("b", 109.0, 1.0)]
    late = [("a", 101.3, 4.0), ("b", 100.4, 2.0), ("a", 104.8, 0.2)]
    stamped = lambda x: spark.createDataFrame(x, "k string, t double, strength double").select("k", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "strength").coalesce(1)
    stamped(rows).write.parquet(src)
    s = spark.readStream.schema("k string, ts timestamp, strength double").parquet(src)
    q = online.refractory(s, "k", 0.5, "20 seconds").writeStream.format("memory").queryName("stand").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    stamped(late).write.mode("append").parquet(src)
    q.processAllAvailable()
    stamped([("z", 1000.0, 1.0)]).write.mode("append").parquet(src)  # moves the watermark past all
    q.processAllAvailable()
    q.stop()
    want, held = [], {}
    for k, t, v in sorted(rows + late, key=lambda r: r[1:]):
        if k not in held or t - held[k][0] >= 0.5:
            want += [(k, *held[k])] if k in held else []
            held[k] = (t, v)
        elif v > held[k][1]:
            held[k] = (t, v)
    want += [(k, *x) for k, x in held.items()]
    assert sorted((r.k, round(r.t, 6), r.strength) for r in spark.table("stand").collect()) == sorted(want)
    ts = str(tmp_path / "ts")
    spark.createDataFrame(rows, "k string, t double, strength double").select("k", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts")).coalesce(1).write.parquet(ts)
    out = online.transient_sessions(spark.readStream.schema("k string, ts timestamp").parquet(ts), "k", 200_000, "1 second")
    q = out.writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    # The watermark stands at 108 s, so the group of b at 109 s is still open.
    assert sorted((r.k, r.n) for r in spark.table("groups").collect()) == [("a", 1), ("a", 1), ("a", 3), ("b", 1)]


def test_array_functions(spark):
    rows = [([1, 2, 9], [1, 2, 3, 9]), ([2, 3], [1, 2, 3, 9]), ([], [1]), ([7], [1, 2]), ([1, 2, 3], [1])]
    d = spark.createDataFrame(rows, "o array<int>, f array<int>")
    got = [tuple(r) for r in d.select(E.prefix_length(F.col("o"), F.col("f")), E.suffix_length(F.col("o"), F.col("f")), E.fragment_length(F.col("o"), F.col("f")), E.alignment_start(F.col("o"), F.col("f"))).collect()]
    assert got == [(2, 1, 2, 0), (0, 0, 2, 1), (0, 0, 0, None), (0, 0, 0, None), (1, 0, 0, None)]
    n = spark.createDataFrame([("C1",), ("D1",), ("C2",), ("Bb1",), ("x",), ("C99",)], "n string").select(E.pitch_of_name(F.col("n"))).collect()
    assert [r[0] for r in n] == [36, 38, 48, 46, None, None]
    t = spark.createDataFrame([("api_key: 'abcdefgh12' sk-123-x Incorrect API key provided: foo.",)], "t string").select(E.redact(F.col("t"))).first()[0]
    assert t == "api_key: [REDACTED] [REDACTED_API_KEY] Incorrect API key provided: [REDACTED]."


def test_drum_maps(spark):
    m = {r.source_note: r.target_note for r in drum_maps.preset(spark, "ujam-candy", 36).collect()}
    assert [m[x] for x in (32, 36, 39, 45, 46, 50, 57)] == [36, 36, 43, 50, 48, 53, 60]
    assert drum_maps.slots(spark).count() == 36
    assert drum_maps.custom(spark, '{"name": "x", "notes": {"1": 2}}').first().target_note == 2
    for bad in ('{"name": "x"}', '{"name": "x", "notes": {"1": 200}}'):
        with pytest.raises(ValueError):
            drum_maps.custom(spark, bad)
