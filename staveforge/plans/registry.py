"""Registration of queries next to the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staveforge.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The same views that sources/adapters.py builds, for DuckDB.
VIEWS = {
    "base_events": """
        SELECT event_id, user_id, event_type, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS recording_id,
               CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
        FROM events""",
    "frames": """
        SELECT recording_id, CAST(row_number() OVER w - 1 AS INTEGER) AS frame_index, us / 1e9 AS start_sec,
               coalesce(lead(us / 1e9) OVER w, us / 1e9 + 0.25) AS end_sec, value / 500 AS rms, value / 500 < 0.1 AS is_silent,
               greatest(0.0, (value / 500) * (value / 500) - lag((value / 500) * (value / 500), 1, 0.0) OVER w) AS onset_score,
               k, event_type
        FROM base_events WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)""",
    "notes": """
        SELECT *, CAST(round_even(start_sec * 960, 0) AS BIGINT) AS start_tick, CAST(round_even(end_sec * 960, 0) AS BIGINT) AS end_tick FROM (
          SELECT recording_id, printf('n%08d', event_id) AS note_id, CAST(user_id % 16 AS INTEGER) AS channel, k AS pitch_midi,
                 CAST(least(127, greatest(1, round_even(value / 4, 0))) AS INTEGER) AS velocity, us / 1e9 AS start_sec,
                 us / 1e9 + (0.05 + (k % 10) * 0.05) AS end_sec, event_type AS layer, CAST(user_id % 4 AS INTEGER) AS track_index
          FROM base_events WHERE event_type IN ('click', 'purchase', 'view'))""",
    "tempo_map": """
        SELECT CAST(tick AS BIGINT) AS tick, tempo FROM (VALUES (0, 500000), (960, 400000), (4800, 600000), (9600, 500000), (19200, 450000), (38400, 550000), (57600, 480000), (76800, 500000)) AS t(tick, tempo)""",
    "hits": """
        SELECT recording_id, frame_index AS hit_id, start_sec AS onset_sec, onset_score, rms,
               CASE event_type WHEN 'click' THEN 'kick' WHEN 'view' THEN 'snare_or_clap' WHEN 'purchase' THEN 'hat' WHEN 'signup' THEN 'cymbal' ELSE 'tom_or_perc' END AS class_name,
               least(1.0, rms) AS confidence
        FROM frames WHERE onset_score > 0""",
    "phrase_timing": """
        SELECT printf('c%06d', o_custkey) AS recording_id, o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 3 ELSE 4 END AS beats_per_bar, CASE o_custkey % 3 WHEN 0 THEN 500000 WHEN 1 THEN 400000 ELSE 600000 END AS tempo,
               CASE o_custkey % 3 WHEN 0 THEN 500000 WHEN 1 THEN 400000 ELSE 600000 END / CAST(1e6 AS DOUBLE) AS beat_sec FROM (SELECT DISTINCT o_custkey FROM orders)""",
    "phrases": """
        SELECT recording_id, printf('p%08d_%d%d', l_orderkey, place, twin) AS note_id, a AS start_tick, z AS end_tick, a / CAST(480 AS DOUBLE) AS start_beat, z / CAST(480 AS DOUBLE) AS end_beat,
               a * tempo / CAST(480e6 AS DOUBLE) AS start_sec, z * tempo / CAST(480e6 AS DOUBLE) AS end_sec, pitch + 4 * twin AS pitch_midi, velocity, channel
        FROM (SELECT t.recording_id, l_orderkey, place, tempo, CAST(40 + t.o_custkey % 5 + [0, 3, 5, 7][place + 1] + CASE WHEN p % 8 = 0 THEN 12 ELSE 0 END AS INTEGER) AS pitch, CAST(40 + q AS INTEGER) AS velocity, CAST(t.o_custkey % 16 AS INTEGER) AS channel,
                     CAST((bar * beats_per_bar * 16 + place * 12) * 30 + s % 7 * 2 AS BIGINT) AS a, CAST((bar * beats_per_bar * 16 + place * 12) * 30 + s % 7 * 2 + ([6, 4, 5, 12][place + 1] + CASE WHEN s % 9 = 0 THEN 20 ELSE 0 END) * 30 AS BIGINT) AS z,
                     unnest(CASE WHEN x >= 0.08 THEN [0, 1] ELSE [0] END) AS twin
              FROM (SELECT l_orderkey, l_linenumber % 4 AS place, min(l_suppkey) AS s, min(l_partkey) AS p, max(l_quantity) AS q, max(l_tax) AS x FROM lineitem GROUP BY ALL) l
              JOIN (SELECT o_orderkey, o_custkey, k + k // 3 AS bar FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)) o ON o_orderkey = l_orderkey JOIN phrase_timing t USING (o_custkey))""",
    "pitch_frames": """
        SELECT recording_id, frame_index, start_sec, end_sec, CAST(35 AS DOUBLE) + CAST(3.65 AS DOUBLE) * k AS f0_hz, least(1.0, rms) AS confidence, rms >= 0.15 AS voiced FROM frames""",
}
_NEEDS = {"frames": ["base_events"], "notes": ["base_events"], "hits": ["frames"], "pitch_frames": ["frames"], "phrases": ["phrase_timing"]}


def sql(body: str, *views: str) -> str:
    """body after a WITH clause of the views it names and of those they need; body may go on with further CTEs (", x AS (...) SELECT ...")."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in _NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) if order else ""
    return f"{head} {body}"


def query(name: str, oracle: str | None = None):
    """Register a function of Tables under name."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put
