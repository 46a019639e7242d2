"""Pattern chain queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveforge.functions import exprs as E
from staveforge.operators import pattern as PT
from staveforge.sources.adapters import Tables

from .registry import query, sql

REC = ["recording_id"]
BAR, SLOTS = 2.0, 16

_GRID = """, g0 AS (SELECT *, CAST(floor(start_sec / 2.0) AS INTEGER) AS bar FROM notes),
 g1 AS (SELECT *, least(15, CAST(round_even((start_sec - bar * 2.0) * 8.0, 0) AS INTEGER)) AS slot, greatest(1, CAST(round_even((end_sec - start_sec) * 8.0, 0) AS INTEGER)) AS slots FROM g0),
 mono AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, bar, slot ORDER BY pitch_midi, slots DESC, velocity DESC, note_id) AS r FROM g1) WHERE r = 1)"""
_BARS = _GRID + """, lb AS (SELECT recording_id, max(bar) AS lb FROM mono GROUP BY 1), ev AS (SELECT recording_id, CAST(unnest(range(0, lb + 1)) AS INTEGER) AS bar FROM lb),
 bars AS (SELECT ev.recording_id, ev.bar, CAST(count(m.note_id) AS INTEGER) AS n, coalesce(list(m.slot ORDER BY m.slot) FILTER (m.note_id IS NOT NULL), []) AS slots_at, coalesce(list(m.pitch_midi ORDER BY m.slot) FILTER (m.note_id IS NOT NULL), []) AS pitches
  FROM ev LEFT JOIN mono m USING (recording_id, bar) GROUP BY ALL)"""


def _bars(t: Tables) -> DataFrame:
    return PT.bars(PT.monophonic(PT.on_grid(t.notes, BAR, SLOTS)), SLOTS)


@query("m12_bar_grid", sql(_GRID + " SELECT recording_id, note_id, bar, slot, slots FROM g1", "notes"))
def m12(t: Tables) -> DataFrame:
    return PT.on_grid(t.notes, BAR, SLOTS).select(*REC, "note_id", "bar", "slot", "slots")


@query("w35_monophonic", sql(_GRID + " SELECT recording_id, note_id FROM mono", "notes"))
def w35(t: Tables) -> DataFrame:
    return PT.monophonic(PT.on_grid(t.notes, BAR, SLOTS)).select(*REC, "note_id")


@query("u7_bars", sql(_BARS + " SELECT recording_id, bar, n, array_to_string(slots_at, ',') AS slots_at, array_to_string(pitches, ',') AS pitches, array_to_string(list_filter(range(16), lambda x: NOT list_contains(slots_at, x)), ',') AS empty_slots FROM bars", "notes"))
def u7(t: Tables) -> DataFrame:
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _bars(t).select(*REC, "bar", "n", j("slots_at").alias("slots_at"), j("pitches").alias("pitches"), j("empty_slots").alias("empty_slots"))


@query("a23_reference_count", sql(_BARS + ", c AS (SELECT recording_id, n, count(*) AS c FROM bars WHERE n > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, n DESC) AS k FROM c) SELECT recording_id, n AS notes_per_bar FROM r WHERE k = 1", "notes"))
def a23(t: Tables) -> DataFrame:
    return PT.reference_count(_bars(t))


@query("w34_sparse_runs", sql(_BARS + ", m AS (SELECT recording_id, greatest(1, ceil(0.35 * median(n))) AS lim FROM bars WHERE n > 0 GROUP BY 1), s AS (SELECT bars.recording_id, bar, bar - row_number() OVER (PARTITION BY bars.recording_id ORDER BY bar) AS run FROM bars JOIN m ON m.recording_id = bars.recording_id WHERE n <= lim) SELECT recording_id, min(bar) AS first_bar, max(bar) AS last_bar FROM s GROUP BY recording_id, run", "notes"))
def w34(t: Tables) -> DataFrame:
    return PT.sparse_runs(_bars(t))


# Coarser bars, so that families form on this fixture: pitch classes on a grid of two slots.
_COARSE = """, c0 AS (SELECT recording_id, note_id, CAST(floor(start_sec / 0.5) AS INTEGER) AS bar, CAST(pitch_midi % 3 AS INTEGER) AS pitch_midi, start_sec, velocity FROM notes),
 c1 AS (SELECT *, least(1, CAST(round_even((start_sec - bar * 0.5) * 4.0, 0) AS INTEGER)) AS slot FROM c0),
 cm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, bar, slot ORDER BY pitch_midi, velocity DESC, note_id) AS r FROM c1) WHERE r = 1),
 cb AS (SELECT recording_id, bar, count(*) AS n, list(slot ORDER BY slot) AS s, list(pitch_midi ORDER BY slot) AS p FROM cm GROUP BY ALL),
 fam AS (SELECT recording_id, s, p, count(*) AS size, min(bar) AS first_bar, list(bar ORDER BY bar) AS occ FROM cb GROUP BY recording_id, s, p HAVING count(*) > 1),
 fams AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY size DESC, first_bar) AS INTEGER) AS family_no FROM fam)"""


def _coarse(t: Tables) -> DataFrame:
    n = t.notes.withColumns({"pitch_midi": F.col("pitch_midi") % 3, "end_sec": F.col("start_sec") + 0.1})
    return PT.bars(PT.monophonic(PT.on_grid(n, 0.5, 2)), 2)


@query("a22_pattern_families", sql(_COARSE + " SELECT recording_id, family_no, CASE WHEN family_no <= 26 THEN 'pattern_' || chr(family_no + 64) ELSE printf('pattern_%03d', family_no) END AS family_id, size, first_bar FROM fams", "notes"))
def a22(t: Tables) -> DataFrame:
    return PT.families(_coarse(t)).select(*REC, "family_no", PT.family_id(F.col("family_no")).alias("family_id"), "size", "first_bar")


@query("a38_missing_bars", sql(_COARSE + """, o AS (SELECT recording_id, family_no, unnest(occ) AS bar FROM fams), gp AS (SELECT *, lag(bar) OVER (PARTITION BY recording_id, family_no ORDER BY bar) AS bf FROM o),
 gg AS (SELECT *, bar - bf AS gap FROM gp WHERE bf IS NOT NULL), pr AS (SELECT recording_id, family_no, greatest(1, CAST(round_even(median(gap), 0) AS INTEGER)) AS period FROM gg GROUP BY ALL),
 wt AS (SELECT gg.recording_id, gg.family_no, unnest(range(bf + period, gg.bar, period)) AS bar FROM gg JOIN pr USING (recording_id, family_no) WHERE gap >= 2 * period),
 lb AS (SELECT recording_id, max(bar) AS lb FROM cb GROUP BY 1), ev AS (SELECT recording_id, unnest(range(0, lb + 1)) AS bar FROM lb), al AS (SELECT ev.recording_id, ev.bar, coalesce(n, 0) AS n FROM ev LEFT JOIN cb USING (recording_id, bar)),
 md AS (SELECT recording_id, greatest(1, ceil(0.35 * median(n))) AS lim FROM al WHERE n > 0 GROUP BY 1), sp AS (SELECT al.recording_id, bar FROM al JOIN md USING (recording_id) WHERE n <= lim)
 SELECT DISTINCT wt.recording_id, CAST(wt.bar AS INTEGER) AS bar, wt.family_no FROM wt JOIN sp USING (recording_id, bar)""", "notes"))
def a38(t: Tables) -> DataFrame:
    b = _coarse(t)
    return PT.missing_bars(b, PT.families(b)).select(*REC, "bar", "family_no")


@query("m13_f19_match_families")
def m13(t: Tables) -> DataFrame:
    """The best family of each incomplete bar."""
    b = _coarse(t)
    return PT.match_families(b, PT.families(b))


@query("f15_f18_array_matching", sql(""", a AS (SELECT recording_id, bar, list(pitch_midi % 4 ORDER BY start_sec, note_id) AS x FROM (SELECT *, CAST(floor(start_sec / 2.0) AS INTEGER) AS bar FROM notes) GROUP BY ALL),
 b AS (SELECT recording_id, bar, x, coalesce(lag(x) OVER (PARTITION BY recording_id ORDER BY bar), []) AS y FROM a),
 c AS (SELECT *, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS o, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS f FROM b),
 d AS (SELECT *, list_transform(range(0, len(o)), lambda i: CASE WHEN o[i + 1] = f[i + 1] THEN 1 ELSE 0 END) AS e,
  list_transform(range(0, len(o)), lambda i: CASE WHEN o[len(o) - i] = f[len(f) - i] THEN 1 ELSE 0 END) AS g,
  list_transform(range(0, len(f) - len(o) + 1), lambda s: coalesce(nullif(list_position(list_transform(range(0, len(o)), lambda i: CASE WHEN o[i + 1] = f[s + i + 1] THEN 1 ELSE 0 END), 0), 0) - 1, len(o))) AS h,
  list_transform(range(0, len(f) - len(o) + 1), lambda s: coalesce(list_sum(list_transform(range(0, len(o)), lambda i: CASE WHEN o[i + 1] = f[s + i + 1] THEN 1 ELSE 0 END)), 0)) AS k FROM c)
 SELECT recording_id, bar, CAST(coalesce(nullif(coalesce(list_position(e, 0), 0), 0) - 1, len(o)) AS INTEGER) AS prefix, CAST(coalesce(nullif(coalesce(list_position(g, 0), 0), 0) - 1, len(o)) AS INTEGER) AS suffix,
  CAST(CASE WHEN len(o) = 0 THEN 0 ELSE list_max(h) END AS INTEGER) AS fragment, CAST(CASE WHEN list_max(k) > 0 THEN list_position(k, list_max(k)) - 1 END AS INTEGER) AS shift FROM d""", "notes"))
def f15(t: Tables) -> DataFrame:
    """Each bar's pitches against those of the bar before, the shorter inside the longer."""
    from pyspark.sql import Window

    n = t.notes.withColumn("bar", F.floor(F.col("start_sec") / 2.0).cast("int"))
    a = n.groupBy(*REC, "bar").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "note_id", (F.col("pitch_midi") % 4).alias("p")))), lambda v: v["p"]).alias("x"))
    b = a.withColumn("y", F.coalesce(F.lag("x").over(Window.partitionBy(*REC).orderBy("bar")), F.expr("cast(array() as array<int>)")))
    short = F.size("x") <= F.size("y")
    c = b.withColumns({"o": F.when(short, F.col("x")).otherwise(F.col("y")), "f": F.when(short, F.col("y")).otherwise(F.col("x"))})
    o, f = F.col("o"), F.col("f")
    return c.select(*REC, "bar", E.prefix_length(o, f).alias("prefix"), E.suffix_length(o, f).alias("suffix"), E.fragment_length(o, f).alias("fragment"), E.alignment_start(o, f).alias("shift"))


@query("p23_f30_buckets", "SELECT event_id, CASE WHEN value / 500 >= 0.85 THEN 'high' WHEN value / 500 >= 0.68 THEN 'medium' ELSE 'low' END AS confidence, CAST(least(12000, greatest(4000, 1000 + 220 * CAST(floor(value) AS INTEGER))) AS INTEGER) AS token_budget FROM events")
def p23(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", E.match_score(F.col("value") / 500).alias("confidence"), E.clip(1000 + 220 * F.floor("value").cast("int"), 4000, 12000).cast("int").alias("token_budget"))


@query("f31_redaction", "SELECT event_id, regexp_replace('key ' || event_type || ' sk-' || event_type || CAST(user_id AS VARCHAR) || ' end', '\\bsk-[A-Za-z0-9_-]+\\b', '[REDACTED_API_KEY]', 'g') AS text FROM events")
def f31(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", E.redact(F.concat(F.lit("key "), "event_type", F.lit(" sk-"), "event_type", F.col("user_id").cast("string"), F.lit(" end"))).alias("text"))
