"""Folders of MIDI files as a Spark data source, merging of tracks, and files from notes."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from staveforge.functions import exprs as E

from . import smf
from .shared import staged

MESSAGES = "path string, format int, ticks_per_beat int, track int, ord int, tick long, kind string, channel int, data1 int, data2 int, tempo int, raw binary"
#: What the writer asks for, in this order; rows of a file together, its tracks rising, each track in the order of its messages.
WRITTEN = "path string, format int, ticks_per_beat int, track int, tick long, raw binary"
#: Bytes of files that a reading task takes, but for a single larger file.
TASK_BYTES = 64 << 20
#: Changes of a tempo map that score() takes; they are broadcast as one row.
TEMPO_CHANGES = 100_000
_BATCH = 1 << 15
_ARROW = pa.schema([("path", pa.string()), ("format", pa.int32()), ("ticks_per_beat", pa.int32()), ("track", pa.int32()), ("ord", pa.int32()), ("tick", pa.int64()), ("kind", pa.string()), ("channel", pa.int32()), ("data1", pa.int32()), ("data2", pa.int32()), ("tempo", pa.int32()), ("raw", pa.binary())])


def mounted(path: str) -> str:
    """path as a folder of the file system; ValueError for one that only a remote scheme reaches."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"the midi source needs a folder that the driver and all executors have mounted, not {path}")
    return plain


def listed(folder: str, recursive: bool) -> list[tuple[str, int]]:
    """(path, bytes) of .mid and .midi files, any case, in order of their paths."""
    found = []
    for at, dirs, names in os.walk(folder):
        found += [(p, os.path.getsize(p)) for n in names if n.lower().endswith((".mid", ".midi")) and os.path.isfile(p := os.path.join(at, n))]
        if not recursive:
            dirs.clear()
    return sorted(found)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """(staged path, name below the folder) of each file that a task has written."""

    files: list[tuple[str, str]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.recursive = mounted(options["path"]), options.get("recursive", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        tasks: list[Files] = []
        held = TASK_BYTES
        for path, size in listed(self.folder, self.recursive):
            if held + size > TASK_BYTES:
                tasks.append(Files([]))
                held = 0
            tasks[-1].paths.append(path)
            held += size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path in partition.paths:
            with open(path, "rb") as f:
                content = f.read()
            for e in smf.parse(content):
                rows.append({"path": path, **{k: e[k] for k in _ARROW.names if k != "path"}})
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


class Writer(DataSourceWriter):
    """Tasks write whole files under a staging folder; commit moves those of the tasks that won, abort takes them away."""

    def __init__(self, options: dict[str, str]):
        self.folder = mounted(options["path"])
        self.staging = os.path.join(self.folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        done: list[tuple[str, str]] = []
        out = name = track = None
        tracks = start = at = 0

        def close_track() -> None:
            end = out.tell()
            out.seek(start - 4)
            out.write(struct.pack(">I", end - start))
            out.seek(end)

        def close_file() -> None:
            close_track()
            out.seek(10)
            out.write(struct.pack(">H", tracks))
            out.close()

        for r in iterator:
            if r.path != name:
                if out:
                    close_file()
                name, track, tracks = r.path, None, 0
                staged = os.path.join(self.staging, uuid.uuid4().hex)
                done.append((staged, name))
                out = open(staged, "wb")  # noqa: SIM115 - closed when the next file begins
                out.write(b"MThd" + struct.pack(">IHHH", 6, r.format, 0, r.ticks_per_beat))
            if r.track != track:
                if track is not None:
                    close_track()
                out.write(b"MTrk\0\0\0\0")
                track, start, at, tracks = r.track, out.tell(), 0, tracks + 1
            out.write(smf._var(max(0, r.tick - at)) + bytes(r.raw))
            at = max(at, r.tick)
        if out:
            close_file()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for staged, name in m.files if m else []:
                target = os.path.join(self.folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.replace(staged, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Staged files of attempts that lost go with their folder."""
        shutil.rmtree(self.staging, ignore_errors=True)


class MidiFiles(DataSource):
    """spark.read.format("midi"): MESSAGES of a folder's files; df.write.format("midi"): files of WRITTEN rows.

    Options: path, a folder that the driver and all executors have mounted; recursive. A file that is not MIDI is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read_messages(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    spark.dataSource.register(MidiFiles)
    return spark.read.format("midi").option("recursive", str(recursive).lower()).load(folder)


def write_messages(rows: DataFrame, folder: str, order: list[Column | str]) -> None:
    """One file for each path (below folder) of rows (path, format, ticks_per_beat, track, tick, raw and what order names).

    A file's rows come to one task by a shuffle on path and stream through it in order of track, then order; only the
    last write of a path stays. Each track's last row should be its end_of_track.
    """
    rows.sparkSession.dataSource.register(MidiFiles)
    names = [c.split()[0] for c in WRITTEN.split(", ")]
    ready = rows.repartition("path").sortWithinPartitions("path", "track", *order).select(*names)
    ready.write.format("midi").mode("append").option("path", folder).save()


def priority(kind: Column) -> Column:
    """Of messages of one tick, tempo and signatures go first, then other meta, control, note-offs, note-ons."""
    return F.when(kind.isin("tempo", "time_signature", "key_signature"), 1).when(kind.isin("text", "track_name", "end_of_track", "meta"), 2).when(kind == "note_off", 4).when(kind == "note_on", 5).otherwise(3)


def file_report(messages: DataFrame) -> DataFrame:
    """(path, tracks, ticks_per_beat, length_ticks, note_on, note_off, tempos, time_signatures) of each file."""
    counts = {"note_on": "note_on", "note_off": "note_off", "tempos": "tempo", "time_signatures": "time_signature"}
    return messages.groupBy("path").agg(
        F.count_distinct("track").alias("tracks"),
        F.any_value("ticks_per_beat").alias("ticks_per_beat"),
        F.max("tick").alias("length_ticks"),
        *[F.count_if(F.col("kind") == kind).alias(name) for name, kind in counts.items()],
    )


def _named(text: Column) -> Column:
    """A track_name message; names of up to 127 bytes."""
    raw = F.encode(text, "utf-8")
    return F.concat(F.unhex(F.lit("FF03")), F.unhex(F.lpad(F.hex(F.length(raw)), 2, "0")), raw)


def merged(messages: DataFrame, single_channel: bool) -> DataFrame:
    """All tracks of a file as one, in order of tick, priority, track and place, named merged and as long as the longest.

    Track names and ends go; single_channel moves every channel message to channel 0. Rows are as write_messages takes
    them, with order columns priority, from_track and ord. format becomes 0.
    """
    voice = F.col("channel").isNotNull()
    status = F.unhex(F.concat(F.substring(F.hex("raw"), 1, 1), F.lit("0"), F.expr("substring(hex(raw), 3)")))
    raw = F.when(voice, status).otherwise(F.col("raw")) if single_channel else F.col("raw")
    base = ["path", F.lit(0).alias("format"), "ticks_per_beat", F.lit(0).alias("track")]
    body = messages.where(~F.col("kind").isin("track_name", "end_of_track")).select(*base, "tick", raw.alias("raw"), priority(F.col("kind")).alias("priority"), F.col("track").alias("from_track"), "ord")
    ends = messages.groupBy("path").agg(F.any_value("ticks_per_beat").alias("ticks_per_beat"), F.max("tick").alias("last"))
    frame = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("tick"), _named(F.lit("merged")).alias("raw"), F.lit(0).alias("priority")), F.struct(F.col("last").alias("tick"), F.unhex(F.lit("FF2F00")).alias("raw"), F.lit(9).alias("priority"))))
    edges = ends.select(*base, frame.alias("e")).select("path", "format", "ticks_per_beat", "track", "e.*", F.lit(-1).alias("from_track"), F.lit(-1).alias("ord"))
    return body.unionByName(edges)


def merge_folder(spark: SparkSession, folder: str, recursive: bool = False, dry_run: bool = False, single_channel: bool = False, suffix: str = "_merge") -> DataFrame:
    """A merged copy beside every file of several tracks; the report of all files.

    Report: path, action (merged, dry_run or skipped_single_track), output (null: none), and file_report's columns with
    the prefix source_ and, read back from the output (without one: as the source), output_. The output's name is the
    source's with suffix, and _2, _3 and so on for the first that no file has.
    """
    root = mounted(folder)
    messages = read_messages(spark, root, recursive)
    source = file_report(messages)
    many = F.col("tracks") > 1
    parts = F.regexp_extract("path", r"(?is)^(.*)(\.midi?)$", 1), F.regexp_extract("path", r"(?is)^(.*)(\.midi?)$", 2)
    named = source.withColumns({"stem": parts[0], "ext": parts[1]})
    tail = F.regexp_extract("stem", rf"(?s)^(.*)\Q{suffix}\E(?:_([2-9]|[1-9][0-9]+))?$", 1), F.regexp_extract("stem", rf"(?s)^(.*)\Q{suffix}\E(?:_([2-9]|[1-9][0-9]+))?$", 2)
    held = named.where(F.col("stem").rlike(rf"(?s)^.*\Q{suffix}\E(?:_([2-9]|[1-9][0-9]+))?$")).select(tail[0].alias("stem"), "ext", F.when(tail[1] == "", 1).otherwise(tail[1].cast("int")).alias("n"))
    held = held.groupBy("stem", "ext").agg(F.collect_set("n").alias("held"))
    n = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("held"), F.lit(0)) + 1), F.coalesce("held", F.array().cast("array<int>"))))
    output = F.concat("stem", F.lit(suffix), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), "ext")
    plan = staged(named.join(held, ["stem", "ext"], "left").withColumn("output", F.when(many, output) if not dry_run else F.lit(None).cast("string")).withColumn("action", F.when(~many, "skipped_single_track").otherwise("dry_run" if dry_run else "merged")).drop("stem", "ext", "held"))
    if not dry_run:
        todo = messages.join(plan.where("output is not null").select("path", "output"), "path")
        below = F.substring("output", F.lit(len(root.rstrip("/")) + 2), F.length("output"))
        rows = merged(todo.withColumn("path", below).drop("output"), single_channel)
        write_messages(rows, root, ["tick", "priority", "from_track", "ord"])
    facts = [c for c in source.columns if c != "path"]
    made = file_report(read_messages(spark, root, recursive)).select(F.col("path").alias("output"), *[F.col(c).alias(f"output_{c}") for c in facts])
    out = plan.withColumnsRenamed({c: f"source_{c}" for c in facts}).join(made, "output", "left")
    return out.select("path", "action", "output", *[f"source_{c}" for c in facts], *[F.coalesce(f"output_{c}", f"source_{c}").alias(f"output_{c}") for c in facts])


def score(notes: DataFrame, tempo: DataFrame, ticks_per_beat: int = 480, one_track: bool = False) -> DataFrame:
    """Rows of write_messages for notes (path, track, track_name, start_tick, end_tick, pitch_midi, velocity, channel, and muted if there are such).

    tempo (tick, tempo) is a table of the same changes for all paths, of 1 to TEMPO_CHANGES rows (else ValueError). It stands on track 0, named
    Conductor, before the notes' tracks, which count from 1; with one_track all goes to one track of a format 0 file, which
    takes the largest of the names. A note lasts a tick or more; a null channel is 0; velocities stay within 1 to 127.
    Muted notes are left out, their tracks stay, but not a one_track file without other notes. At one tick offs come before
    ons, ties go by channel and pitch. The choice of path splits: by recording, action, layer or track. Order of rows:
    tick, priority, channel, pitch.
    """
    if not 1 <= tempo.limit(TEMPO_CHANGES + 1).count() <= TEMPO_CHANGES:
        raise ValueError(f"a tempo map has 1 to {TEMPO_CHANGES} changes")
    loud = ~F.coalesce(F.col("muted"), F.lit(False)) if "muted" in notes.columns else F.lit(True)
    n = notes.where(loud) if one_track else notes
    n = n.withColumn("track", F.lit(0)) if one_track else n
    ch = F.coalesce("channel", F.lit(0)).cast("int")
    end = F.greatest("end_tick", F.col("start_tick") + 1).cast("long")

    def message(status: int, velocity: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (ch + status, F.col("pitch_midi"), velocity)]))

    def row(tick: Column, raw: Column, place: int) -> Column:
        return F.struct(tick.cast("long").alias("tick"), raw.alias("raw"), F.lit(place).alias("priority"))

    def framed(df: DataFrame, rows: Column) -> DataFrame:
        return df.select("path", "track", F.explode(rows).alias("e")).select("path", "track", "e.*", F.lit(0).alias("channel"), F.lit(0).alias("pitch"))

    last = F.unhex(F.lit("FF2F00"))
    both = F.array(row(F.col("start_tick"), message(0x90, F.greatest(F.lit(1), F.least(F.lit(127), F.col("velocity")))), 5), row(end, message(0x80, F.lit(0)), 4))
    sounds = n.where(loud).select("path", "track", F.explode(both).alias("e"), ch.alias("channel"), F.col("pitch_midi").alias("pitch")).select("path", "track", "e.*", "channel", "pitch")
    set_tempo = F.unhex(F.concat(F.lit("FF5103"), F.lpad(F.hex(F.col("tempo").cast("long")), 6, "0")))
    changes = tempo.groupBy().agg(F.array_sort(F.collect_list(row(F.col("tick"), set_tempo, 1))).alias("changes"), F.max("tick").cast("long").alias("top"))  # one row
    tracks = n.groupBy("path", "track").agg(F.coalesce(F.max(F.when(loud, end)), F.lit(0)).alias("last"), F.coalesce(F.max("track_name"), F.lit("Track")).alias("name"))
    name = row(F.lit(0), _named(F.col("name")), 0)
    if one_track:
        out = framed(tracks.join(F.broadcast(changes)), F.concat(F.array(name), "changes", F.array(row(F.greatest("last", "top"), last, 9))))
    else:
        out = framed(tracks, F.array(name, row(F.col("last"), last, 9)))
        lead = n.select("path", F.lit(0).alias("track")).distinct().join(F.broadcast(changes))
        out = out.unionByName(framed(lead, F.concat(F.array(row(F.lit(0), _named(F.lit("Conductor")), 0)), "changes", F.array(row(F.col("top"), last, 9)))))
    return sounds.unionByName(out).withColumns({"format": F.lit(0 if one_track else 1), "ticks_per_beat": F.lit(ticks_per_beat)})


def track_file(index: Column, name: Column) -> Column:
    """K8: 07_Name.mid; all but letters, digits, hyphen and underscore becomes an underscore, runs of it one, none at the ends."""
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("_"), E.track_name(F.trim(F.coalesce(name, F.lit("")))), F.lit(".mid"))
