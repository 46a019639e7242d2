"""MIDI table algebra."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E
from staveforge.operators import midi as MI
from staveforge.sources import midi_files as MF
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import shared_dir

from .registry import query, sql

REC = ["recording_id"]
_MAP = ", tm AS (SELECT tick, tempo, sum(d) OVER (ORDER BY tick) AS sec FROM (SELECT tick, tempo, coalesce((tick - lag(tick) OVER (ORDER BY tick)) * lag(tempo) OVER (ORDER BY tick) / 480e6, 0.0) AS d FROM tempo_map))"


@query("w4_tempo_map", sql(_MAP + " SELECT tick, CAST(tempo AS INTEGER) AS tempo, round(sec, 9) AS sec FROM tm", "tempo_map"))
def w4(t: Tables) -> DataFrame:
    return MI.tempo_seconds(t.tempo_map, 480).select("tick", "tempo", F.round("sec", 9).alias("sec"))


def _per_recording(t: Tables) -> DataFrame:
    """The tempo map once for each recording, so that as-of joins partition by recording."""
    m = MI.tempo_seconds(t.tempo_map, 480)
    return t.notes.select(*REC).distinct().join(F.broadcast(m))


@query("j2_tick_to_seconds", sql(_MAP + " SELECT n.recording_id, n.note_id, round(m.sec + (n.start_tick - m.tick) * m.tempo / 480e6, 9) AS sec FROM notes n ASOF JOIN tm m ON n.start_tick >= m.tick", "tempo_map", "notes"))
def j2(t: Tables) -> DataFrame:
    n = MI.tick_to_seconds(t.notes.select(*REC, "note_id", "start_tick"), "start_tick", _per_recording(t), 480, REC, "sec")
    return n.select(*REC, "note_id", F.round("sec", 9).alias("sec"))


@query("j3_seconds_to_tick", sql(_MAP + " SELECT n.recording_id, n.note_id, CAST(greatest(0, round_even(m.tick + (n.start_sec - m.sec) * 480e6 / m.tempo, 0)) AS BIGINT) AS tick FROM notes n ASOF JOIN tm m ON n.start_sec >= m.sec", "tempo_map", "notes"))
def j3(t: Tables) -> DataFrame:
    return MI.seconds_to_tick(t.notes.select(*REC, "note_id", "start_sec"), "start_sec", _per_recording(t), 480, REC, "tick").select(*REC, "note_id", "tick")


def _msgs(t: Tables) -> DataFrame:
    return t.base_events.where(F.col("event_type").isin("signup", "error")).select(*REC, (F.col("k") % 8).alias("pitch"), (F.col("event_type") == "signup").alias("is_on"), F.col("event_id").alias("ord"))


_MSG = sql(", msgs AS (SELECT recording_id, k % 8 AS pitch, event_type = 'signup' AS is_on, event_id AS ord FROM base_events WHERE event_type IN ('signup', 'error'))", "base_events")


@query("j1_fifo_pairs", _MSG + """, s AS (SELECT *, sum(CASE WHEN is_on THEN 1 ELSE -1 END) OVER (PARTITION BY recording_id, pitch ORDER BY ord) AS c FROM msgs),
 f AS (SELECT *, least(0, min(c) OVER (PARTITION BY recording_id, pitch ORDER BY ord)) AS fl FROM s), g AS (SELECT *, coalesce(lag(fl) OVER (PARTITION BY recording_id, pitch ORDER BY ord), 0) AS was FROM f),
 n AS (SELECT *, row_number() OVER (PARTITION BY recording_id, pitch, is_on ORDER BY ord) AS n FROM g WHERE is_on OR fl = was)
 SELECT a.recording_id, a.pitch, a.ord AS on_ord, b.ord AS off_ord FROM n a JOIN n b ON a.recording_id = b.recording_id AND a.pitch = b.pitch AND a.n = b.n WHERE a.is_on AND NOT b.is_on""")
def j1(t: Tables) -> DataFrame:
    return MI.pair_notes(_msgs(t), [*REC, "pitch"], ["ord"])


@query("a33_event_counts", _MSG + " SELECT recording_id, count(*) FILTER (is_on) AS note_on, count(*) FILTER (NOT is_on) AS note_off FROM msgs GROUP BY 1")
def a33(t: Tables) -> DataFrame:
    return _msgs(t).groupBy(*REC).agg(F.count_if("is_on").alias("note_on"), F.count_if(~F.col("is_on")).alias("note_off"))


_EV = ", ev AS (SELECT recording_id, note_id, channel, start_tick AS event_tick, 1 AS event_order FROM notes UNION ALL SELECT recording_id, note_id, channel, greatest(end_tick, start_tick), 0 FROM notes)"


@query("k5_x16_delta_events", sql(_EV + " SELECT recording_id, note_id, channel, event_order, event_tick - lag(event_tick, 1, 0) OVER (PARTITION BY recording_id ORDER BY event_tick, event_order, note_id) AS delta FROM ev", "notes"))
def k5(t: Tables) -> DataFrame:
    return MI.delta_encode(MI.note_events(t.notes, [*REC, "note_id"]), REC, ["note_id"]).select(*REC, "note_id", "channel", "event_order", "delta")


@query("x37_a35_source_length", sql(_EV + ", d AS (SELECT recording_id, channel, event_tick - lag(event_tick, 1, 0) OVER (PARTITION BY recording_id, channel ORDER BY event_tick, event_order, note_id) AS delta FROM ev), l AS (SELECT recording_id, channel, sum(delta) AS total FROM d GROUP BY ALL) SELECT recording_id, CAST(max(total) AS BIGINT) AS length_ticks FROM l GROUP BY 1", "notes"))
def a35(t: Tables) -> DataFrame:
    d = MI.delta_encode(MI.note_events(t.notes, [*REC, "note_id"]), [*REC, "channel"], ["note_id"])
    return d.groupBy(*REC, "channel").agg(F.sum("delta").alias("total")).groupBy(*REC).agg(F.max("total").alias("length_ticks"))


@query("t1_note_order", sql(" SELECT recording_id, note_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id) AS INTEGER) AS place FROM notes", "notes"))
def t1(t: Tables) -> DataFrame:
    return t.notes.select(*REC, "note_id", F.row_number().over(Window.partitionBy(*REC).orderBy("start_sec", "end_sec", "note_id")).alias("place"))


@query("t2_session_order", sql(" SELECT recording_id, note_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_tick, end_tick, track_index, coalesce(nullif(channel, 0), -1), pitch_midi, note_id) AS INTEGER) AS place FROM notes", "notes"))
def t2(t: Tables) -> DataFrame:
    ch = F.coalesce(F.nullif("channel", F.lit(0)), F.lit(-1))
    return t.notes.select(*REC, "note_id", F.row_number().over(Window.partitionBy(*REC).orderBy("start_tick", "end_tick", "track_index", ch, "pitch_midi", "note_id")).alias("place"))


@query("t3_message_priority", "WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'note_on' WHEN 'error' THEN 'note_off' WHEN 'click' THEN 'control' WHEN 'view' THEN 'meta' ELSE 'meta_tempo' END AS kind, user_id FROM events), p AS (SELECT *, CASE kind WHEN 'meta_tempo' THEN 1 WHEN 'meta' THEN 2 WHEN 'control' THEN 3 WHEN 'note_off' THEN 4 ELSE 5 END AS pr FROM e) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pr, event_id) AS INTEGER) AS place FROM p")
def t3(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "note_on").when(F.col("event_type") == "error", "note_off").when(F.col("event_type") == "click", "control").when(F.col("event_type") == "view", "meta").otherwise("meta_tempo")
    e = t.read("events").select("event_id", "user_id", kind.alias("kind"))
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(MI.message_priority(F.col("kind")), "event_id")).alias("place"))


@query("u3_set_bpm", "SELECT CAST(0 AS BIGINT) AS tick, CAST(round_even(6e7 / 124.529, 0) AS INTEGER) AS tempo, 0 AS track")
def u3(t: Tables) -> DataFrame:
    """All tempo events go and one stands at tick 0 of track 0."""
    rest = t.tempo_map.where("tempo is null").withColumn("track", F.lit(0))
    return rest.unionByName(t.spark.range(1).select(F.lit(0).cast("long").alias("tick"), F.rint(F.lit(6e7 / 124.529)).cast("int").alias("tempo"), F.lit(0).alias("track")))


@query("s14_x58_timing_probe", sql(" SELECT arg_max(tempo, tick) AS last_tempo, arg_min(tempo, tick) AS first_tempo FROM tempo_map", "tempo_map"))
def s14(t: Tables) -> DataFrame:
    return t.tempo_map.agg(F.max_by("tempo", "tick").alias("last_tempo"), F.min_by("tempo", "tick").alias("first_tempo"))


@query("u1_track_union", sql(" SELECT recording_id, 0 AS channel, count(*) AS notes, count(DISTINCT channel) AS source_channels FROM notes GROUP BY 1", "notes"))
def u1(t: Tables) -> DataFrame:
    """Merged to one track with the single-channel policy."""
    return t.notes.withColumn("source", F.col("channel")).withColumn("channel", F.lit(0)).groupBy(*REC, "channel").agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("source").alias("source_channels"))


_NAME = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query("f1_f3_pitch_names", sql(f" SELECT DISTINCT pitch_midi, {_NAME}[pitch_midi % 12 + 1] || CAST(pitch_midi // 12 - 1 AS VARCHAR) AS name, {_NAME}[((pitch_midi - 36) % 12 + 12) % 12 + 1] || CAST(1 + CAST(floor((pitch_midi - 36) / 12.0) AS BIGINT) AS VARCHAR) AS c1_name FROM notes", "notes"))
def f1(t: Tables) -> DataFrame:
    p = F.col("pitch_midi")
    return t.notes.select("pitch_midi").distinct().select(p, E.pitch_name(p).alias("name"), E.pitch_name(p - 36, -1).alias("c1_name"))


@query("f2_name_to_pitch", sql(" SELECT DISTINCT pitch_midi, pitch_midi AS again FROM notes", "notes"))
def f2(t: Tables) -> DataFrame:
    """Names made by F3 and read back by F2 give the pitch again."""
    p = t.notes.select("pitch_midi").distinct()
    return p.select("pitch_midi", E.pitch_of_name(E.pitch_name(F.col("pitch_midi") - 36, -1), 36).cast("int").alias("again"))


@query("f6_note_ids", sql(" SELECT note_id, format('{}_t{:02d}_ch{}_p{:03d}_n{:06d}', layer, track_index + 1, channel, pitch_midi, row_number() OVER (PARTITION BY recording_id, track_index, channel, pitch_midi, layer ORDER BY end_sec, note_id)) AS built_id FROM notes", "notes"))
def f6(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*REC, "track_index", "channel", "pitch_midi", "layer").orderBy("end_sec", "note_id"))
    return t.notes.select("note_id", F.format_string("%s_t%02d_ch%d_p%03d_n%06d", F.col("layer"), F.col("track_index") + 1, F.col("channel"), F.col("pitch_midi"), n).alias("built_id"))


@query("f7_f8_constant_ticks", sql(" SELECT recording_id, note_id, CAST(greatest(0, round_even(start_sec * (480 * 1e6 / 500000), 0)) AS BIGINT) AS tick FROM notes", "notes"))
def f7(t: Tables) -> DataFrame:
    return t.notes.select(*REC, "note_id", E.ticks(F.col("start_sec")).alias("tick"))


@query("f9_f10_f12_text", "SELECT p_partkey, CASE WHEN regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') = '' THEN 'Layer' ELSE regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') END AS token, regexp_replace(regexp_replace(regexp_replace(p_type, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS track, lpad(CAST(CAST(floor(p_retailprice) AS INTEGER) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(p_retailprice) AS INTEGER) % 60 AS VARCHAR), 2, '0') AS mmss FROM part")
def f9(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", E.file_token(F.col("p_name")).alias("token"), E.track_name(F.col("p_type")).alias("track"), E.mm_ss(F.col("p_retailprice")).alias("mmss"))


@query("f13_f14_lenient_casts", "SELECT event_id, CAST(least(127, greatest(1, coalesce(TRY_CAST(event_type AS INTEGER), 64))) AS INTEGER) AS velocity, CAST(least(127, greatest(0, CAST(floor(value) AS INTEGER) - 100)) AS INTEGER) AS pitch FROM events")
def f13(t: Tables) -> DataFrame:
    v = F.coalesce(F.col("event_type").try_cast("int"), F.lit(64))
    return t.read("events").select("event_id", E.clip(v, 1, 127).cast("int").alias("velocity"), E.clip(F.floor("value").cast("int") - 100, 0, 127).cast("int").alias("pitch"))


def _folder(t: Tables) -> str:
    return f"{MF.mounted(shared_dir(t.spark))}/midi-{uuid.uuid4().hex}"


@query("s5_m25_folder_merge", sql(""", g AS (SELECT recording_id, count(DISTINCT track_index) AS tracks, count(*) AS n, max(greatest(end_tick, start_tick + 1)) AS last FROM notes GROUP BY 1), m AS (SELECT count(*) AS tempos, max(tick) AS top FROM tempo_map)
 SELECT recording_id, 'merged' AS action, tracks + 1 AS source_tracks, CAST(1 AS BIGINT) AS output_tracks, greatest(last, top) AS length_ticks, n AS note_on, n AS note_off, tempos, true AS alike FROM g, m""", "notes", "tempo_map"))
def m25(t: Tables) -> DataFrame:
    """Every recording as a MIDI file with a track for each track_index, merged to one track and channel and read back: facts of source and output."""
    folder = _folder(t)
    n = t.notes.withColumns({"path": F.concat("recording_id", F.lit(".mid")), "track": F.col("track_index") + 1, "track_name": F.concat(F.lit("track "), F.col("track_index").cast("string"))})
    MF.write_messages(MF.score(n, t.tempo_map), folder, ["tick", "priority", "channel", "pitch"])
    r = MF.merge_folder(t.spark, folder, single_channel=True)
    alike = F.lit(True)
    for c in ("length_ticks", "note_on", "note_off", "tempos", "ticks_per_beat"):
        alike = alike & (F.col(f"source_{c}") == F.col(f"output_{c}"))
    facts = [F.col(f"output_{c}").alias(c) for c in ("length_ticks", "note_on", "note_off", "tempos")]
    return r.select(F.regexp_extract("path", r"([^/]*)\.mid$", 1).alias("recording_id"), "action", "source_tracks", "output_tracks", *facts, alike.alias("alike"))


def _tracked(t: Tables) -> DataFrame:
    return t.notes.withColumns({"track": F.col("track_index") + 1, "track_name": F.concat(F.lit("Part / "), F.col("layer")), "muted": F.col("velocity") <= 40})


def _facts() -> list[Column]:
    return [F.count_if(F.col("kind") == "note_on").alias("notes"), F.count_if(F.col("kind") == "tempo").alias("tempos"), F.max("tick").alias("length_ticks")]


@query("k7_x43_split_multitrack", sql(""", m AS (SELECT count(*) AS tempos, max(tick) AS top FROM tempo_map), p AS (SELECT recording_id, CAST(dense_rank() OVER (PARTITION BY recording_id ORDER BY track_index) AS INTEGER) AS track, count(*) FILTER (velocity > 40) AS notes, coalesce(max(greatest(end_tick, start_tick + 1)) FILTER (velocity > 40), 0) AS length_ticks FROM notes GROUP BY recording_id, track_index)
 SELECT recording_id, track, notes, CAST(0 AS BIGINT) AS tempos, length_ticks FROM p UNION ALL SELECT DISTINCT recording_id, 0, CAST(0 AS BIGINT), tempos, top FROM p, m""", "notes", "tempo_map"))
def k7(t: Tables) -> DataFrame:
    """A file for each recording with a conductor and a track for each track_index that it has, muted notes left out, read back; tracks count as they stand in the file."""
    folder = _folder(t)
    MF.write_messages(MF.score(_tracked(t).withColumn("path", F.concat("recording_id", F.lit(".mid"))), t.tempo_map), folder, ["tick", "priority", "channel", "pitch"])
    return MF.read_messages(t.spark, folder).groupBy(F.regexp_extract("path", r"([^/]*)\.mid$", 1).alias("recording_id"), "track").agg(*_facts())


@query("k8_split_files", sql(""", m AS (SELECT count(*) AS tempos, max(tick) AS top FROM tempo_map) SELECT recording_id, printf('%02d_Part_%s.mid', track_index + 1, layer) AS file, count(*) AS notes, any_value(tempos) AS tempos, greatest(max(greatest(end_tick, start_tick + 1)), any_value(top)) AS length_ticks FROM notes, m WHERE velocity > 40 GROUP BY 1, 2""", "notes", "tempo_map"))
def k8(t: Tables) -> DataFrame:
    """A folder for each recording with a file of one track for each track_index and layer that has notes, read back."""
    folder = _folder(t)
    n = _tracked(t).withColumn("path", F.concat("recording_id", F.lit("/"), MF.track_file(F.col("track"), F.col("track_name"))))
    MF.write_messages(MF.score(n, t.tempo_map, one_track=True), folder, ["tick", "priority", "channel", "pitch"])
    parts = [F.regexp_extract("path", r"([^/]*)/([^/]*)$", k).alias(name) for k, name in ((1, "recording_id"), (2, "file"))]
    return MF.read_messages(t.spark, folder, recursive=True).groupBy(*parts).agg(*_facts())


@query("k6_m23_synced_files", sql(_MAP + """, s AS (SELECT n.recording_id, n.note_id, n.end_sec, CAST(greatest(0, round_even(m.tick + (n.start_sec - m.sec) * 480e6 / m.tempo, 0)) AS BIGINT) AS a FROM notes n ASOF JOIN tm m ON n.start_sec >= m.sec),
 e AS (SELECT s.recording_id, a, greatest(a + 1, CAST(round_even(m.tick + (s.end_sec - m.sec) * 480e6 / m.tempo, 0) AS BIGINT)) AS z FROM s ASOF JOIN tm m ON s.end_sec >= m.sec), c AS (SELECT count(*) AS tempos, max(tick) AS top FROM tempo_map)
 SELECT recording_id, count(*) AS notes, any_value(tempos) AS tempos, greatest(max(z), any_value(top)) AS length_ticks, CAST(sum(a) AS BIGINT) AS on_ticks, CAST(sum(z) AS BIGINT) AS off_ticks FROM e, c GROUP BY 1""", "tempo_map", "notes"))
def k6(t: Tables) -> DataFrame:
    """Notes at their seconds under the tempo map, as a file of one track for each recording, read back."""
    m, folder = _per_recording(t), _folder(t)
    n = t.notes.drop("start_tick", "end_tick")
    n = MI.seconds_to_tick(MI.seconds_to_tick(n, "start_sec", m, 480, REC, "start_tick"), "end_sec", m, 480, REC, "end_tick")
    n = n.withColumns({"path": F.concat("recording_id", F.lit(".mid")), "track": F.lit(0), "track_name": F.lit("Synced")})
    MF.write_messages(MF.score(n, t.tempo_map, one_track=True), folder, ["tick", "priority", "channel", "pitch"])
    ticks = [F.sum(F.when(F.col("kind") == kind, F.col("tick"))).alias(name) for kind, name in (("note_on", "on_ticks"), ("note_off", "off_ticks"))]
    return MF.read_messages(t.spark, folder).groupBy(F.regexp_extract("path", r"([^/]*)\.mid$", 1).alias("recording_id")).agg(*_facts(), *ticks)
