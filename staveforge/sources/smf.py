"""Standard MIDI files as event tables, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "path string, ticks_per_beat int, track int, ord int, tick long, kind string, channel int, data1 int, data2 int, tempo int, text string"
_TEXT = {0x01: "text", 0x03: "track_name", 0x2F: "end_of_track", 0x51: "tempo", 0x58: "time_signature", 0x59: "key_signature"}
_KIND = {0x8: "note_off", 0x9: "note_on", 0xA: "poly_touch", 0xB: "control", 0xC: "program", 0xD: "touch", 0xE: "bend"}


def _varlen(b: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        c = b[at]
        at += 1
        n = n << 7 | c & 0x7F
        if c < 0x80:
            return n, at


def parse(b: bytes) -> Iterator[dict]:
    """The events of one file in order, with absolute ticks and, as raw, their bytes under a status of their own. A key signature out of range is clamped (sharps -7..7, mode 0 or 1), not an error."""
    if b[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, form, _, tpb = struct.unpack(">IHHH", b[4:14])
    if tpb & 0x8000:
        raise ValueError("SMPTE time is not read")
    at, track = 8 + size, -1
    while at + 8 <= len(b):
        name, n = b[at : at + 4], struct.unpack(">I", b[at + 4 : at + 8])[0]
        at += 8
        end = at + n
        if name == b"MTrk":
            track += 1
            tick = order = status = 0
            while at < end:
                d, at = _varlen(b, at)
                tick += d
                e = {"format": form, "ticks_per_beat": tpb, "track": track, "ord": order, "tick": tick, "kind": "other", "channel": None, "data1": None, "data2": None, "tempo": None, "text": None}
                order += 1
                if b[at] >= 0x80:
                    status = b[at]
                    at += 1
                first = at
                if status == 0xFF:
                    kind = b[at]
                    n, at = _varlen(b, at + 1)
                    x = b[at : at + n]
                    at += n
                    e["kind"] = _TEXT.get(kind, "meta")
                    if kind == 0x51:
                        e["tempo"] = int.from_bytes(x[:3], "big")
                    elif kind == 0x58 and n >= 2:
                        e["data1"], e["data2"] = x[0], 1 << x[1]
                    elif kind == 0x59 and n >= 2:
                        e["data1"], e["data2"] = max(-7, min(7, struct.unpack("b", x[:1])[0])), int(x[1] == 1)
                    elif kind in (0x01, 0x03):
                        e["text"] = x.decode("utf-8", "replace")
                elif status in (0xF0, 0xF7):
                    n, at = _varlen(b, at)
                    at += n
                else:
                    e["kind"], e["channel"], e["data1"] = _KIND.get(status >> 4, "other"), status & 15, b[at]
                    at += 1
                    if status >> 4 not in (0xC, 0xD):
                        e["data2"] = b[at]
                        at += 1
                    if e["kind"] == "note_on" and e["data2"] == 0:
                        e["kind"] = "note_off"
                e["raw"] = bytes([status]) + b[first:at]
                yield e
        at = end


def read_events(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """EVENTS of every .mid or .midi file (any case) below folder, one file a row group; files come through Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).where(F.lower("path").rlike(r"\.midi?$"))
    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                yield pd.DataFrame([{"path": path, **e} for e in parse(bytes(content))], columns=names)

    return files.select("path", "content").mapInPandas(run, EVENTS)


def _var(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def build(tracks: list[tuple[str, list[tuple[int, int, int, int, int, int]]]], ticks_per_beat: int, tempo: list[tuple[int, int]]) -> bytes:
    """A type 1 file: a conductor track with tempo, then named tracks of (tick, order, is_on, channel, pitch, velocity)."""

    def chunk(events: list[tuple[int, bytes]]) -> bytes:
        body, at = b"", 0
        for tick, raw in events:
            body += _var(max(0, tick - at)) + raw
            at = max(at, tick)
        body += b"\x00\xff\x2f\x00"
        return b"MTrk" + struct.pack(">I", len(body)) + body

    out = [chunk([(t, b"\xff\x51\x03" + int(m).to_bytes(3, "big")) for t, m in sorted(tempo)])]
    for name, events in tracks:
        raw = name.encode()
        rows = [(t, bytes([(0x90 if on else 0x80) | ch, p, v if on else 0])) for t, _, on, ch, p, v in sorted(events)]
        out.append(chunk([(0, b"\xff\x03" + _var(len(raw)) + raw), *rows]))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(out), ticks_per_beat) + b"".join(out)


def to_files(notes: DataFrame, by: list[str], ticks_per_beat: int = 480, tempo: int = 500_000) -> DataFrame:
    """(by, midi): one file for each group of notes (start_tick, end_tick, pitch_midi, velocity, channel, track_name).

    One group is one piece of music. Notes end at least a tick after they start; offs come before ons; ties go by
    channel, pitch and velocity.
    """
    row = F.struct("track_name", "start_tick", "end_tick", F.coalesce("channel", F.lit(0)).alias("channel"), "pitch_midi", "velocity")
    g = notes.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("notes"))

    @F.udf("binary")
    def render(rows) -> bytes:
        tracks: dict[str, list] = {}
        for r in rows:
            v = max(1, min(127, r["velocity"]))
            end = max(r["end_tick"], r["start_tick"] + 1)
            tracks.setdefault(r["track_name"] or "Track", []).extend([(r["start_tick"], 1, 1, r["channel"], r["pitch_midi"], v), (end, 0, 0, r["channel"], r["pitch_midi"], 0)])
        return build(list(tracks.items()), ticks_per_beat, [(0, tempo)])

    return g.select(*by, render("notes").alias("midi"))
