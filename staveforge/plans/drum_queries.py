"""Drum chain queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.operators import drums as D
from staveforge.sources import drum_maps as M
from staveforge.sources.adapters import Tables

from .registry import query, sql

REC = ["recording_id"]
_SCORE = ", scored AS (SELECT *, 0.52 * onset_score + 0.26 * confidence + 0.10 * rms + 0.12 * rms AS score FROM hits)"
_GROUPS = _SCORE + ", st AS (SELECT *, CASE WHEN onset_sec - lag(onset_sec) OVER w > 0.15 THEN 1 ELSE 0 END AS nw FROM scored WINDOW w AS (PARTITION BY recording_id ORDER BY onset_sec, hit_id)), gr AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY recording_id ORDER BY onset_sec, hit_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS transient FROM st)"

# Same, with each layer (here the class) by itself: hits of two layers at one time are two hits.
_LAYERED = _GROUPS.replace("PARTITION BY recording_id ORDER", "PARTITION BY recording_id, class_name ORDER")
LAYER = [*REC, "class_name"]


def _scored(t: Tables) -> DataFrame:
    return t.hits.withColumn("score", D.score(F.col("onset_score"), F.col("confidence"), F.col("rms"), F.col("rms")))


@query("p20_hit_score", sql(_SCORE + " SELECT recording_id, hit_id, round(score, 9) AS score FROM scored", "hits"))
def p20(t: Tables) -> DataFrame:
    return _scored(t).select(*REC, "hit_id", F.round("score", 9).alias("score"))


@query("w25_peak_pick", sql(", e AS (SELECT recording_id, frame_index, onset_score AS v, max(onset_score) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t, avg(onset_score) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY frame_index)) SELECT recording_id, frame_index FROM e WHERE v >= 0.02 AND v >= t AND v >= m + 0.01", "frames"))
def w25(t: Tables) -> DataFrame:
    return D.peaks(t.frames, REC, "frame_index", "onset_score", 3, 3, 6, 6, 0.01, 0.02).select(*REC, "frame_index")


@query("w28_transient_groups", sql(_GROUPS + " SELECT recording_id, hit_id, transient FROM gr", "hits"))
def w28(t: Tables) -> DataFrame:
    return D.transient_groups(t.hits, REC, 0.15).select(*REC, "hit_id", "transient")


@query("w29_group_winner", sql(_LAYERED + ", rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, class_name, transient ORDER BY score DESC, onset_sec, hit_id) AS rn FROM gr) SELECT recording_id, hit_id, rn > 1 AS suppressed FROM rk", "hits"))
def w29(t: Tables) -> DataFrame:
    """The best hit of each transient of each layer."""
    return D.group_winners(_scored(t), LAYER, 0.15).select(*REC, "hit_id", "suppressed")




def _spaced(by: str, gap: str) -> str:
    return (
        sql(_SCORE, "hits").replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", o AS (SELECT *, {gap} AS gap, row_number() OVER (PARTITION BY {by} ORDER BY onset_sec, hit_id) AS rn FROM scored),
 f AS (SELECT {by}, rn, hit_id AS kept, onset_sec AS at, score AS v, 1 AS grp FROM o WHERE rn = 1
   UNION ALL SELECT {', '.join('f.' + c.strip() for c in by.split(','))}, o.rn, CASE WHEN o.onset_sec - f.at >= o.gap OR o.score > f.v THEN o.hit_id ELSE f.kept END, CASE WHEN o.onset_sec - f.at >= o.gap OR o.score > f.v THEN o.onset_sec ELSE f.at END,
     CASE WHEN o.onset_sec - f.at >= o.gap OR o.score > f.v THEN o.score ELSE f.v END, CASE WHEN o.onset_sec - f.at >= o.gap THEN f.grp + 1 ELSE f.grp END
   FROM f JOIN o ON o.rn = f.rn + 1 AND {' AND '.join(f'o.{c.strip()} = f.{c.strip()}' for c in by.split(','))})
 SELECT {by}, arg_max(kept, rn) AS hit_id FROM f GROUP BY {by}, grp"""
    )


@query("w30_min_spacing", _spaced("recording_id, class_name", "0.4"))
def w30(t: Tables) -> DataFrame:
    return D.keep_spaced(_scored(t), LAYER, "onset_sec", "score", F.lit(0.4), "hit_id").select(*LAYER, "hit_id")


@query("w31_class_refractory", _spaced("recording_id, class_name", "CASE class_name WHEN 'kick' THEN 0.5 WHEN 'hat' THEN 0.3 ELSE 0.8 END"))
def w31(t: Tables) -> DataFrame:
    gap = F.when(F.col("class_name") == "kick", 0.5).when(F.col("class_name") == "hat", 0.3).otherwise(0.8)
    return D.keep_spaced(_scored(t), [*REC, "class_name"], "onset_sec", "score", gap, "hit_id").select(*REC, "class_name", "hit_id")


@query("w32_previous_unsuppressed", sql(_LAYERED + ", rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, class_name, transient ORDER BY score DESC, onset_sec, hit_id) > 1 AS sup FROM gr) SELECT recording_id, hit_id, round((onset_sec - last_value(CASE WHEN NOT sup THEN onset_sec END IGNORE NULLS) OVER (PARTITION BY recording_id, class_name ORDER BY onset_sec, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) * 1000, 6) AS previous_ms FROM rk", "hits"))
def w32(t: Tables) -> DataFrame:
    w = Window.partitionBy(*REC, "class_name").orderBy("onset_sec", "hit_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("suppressed"), F.col("onset_sec")), ignorenulls=True).over(w)
    return D.group_winners(_scored(t), LAYER, 0.15).select(*REC, "hit_id", F.round((F.col("onset_sec") - last) * 1000, 6).alias("previous_ms"))


@query("w33_simultaneous_layers", sql(_GROUPS + " SELECT recording_id, transient, array_to_string(list_sort(list_distinct(list(class_name))), '|') AS layers FROM gr GROUP BY ALL", "hits"))
def w33(t: Tables) -> DataFrame:
    g = D.transient_groups(t.hits, REC, 0.15)
    return g.groupBy(*REC, "transient").agg(F.array_join(F.array_sort(F.collect_set("class_name")), "|").alias("layers"))


@query("p22_velocity", sql(", s AS (SELECT *, onset_score * (0.70 + 0.20 * confidence) AS s FROM hits), q AS (SELECT *, quantile_cont(s, 0.1) OVER (PARTITION BY recording_id) AS lo, quantile_cont(s, 0.9) OVER (PARTITION BY recording_id) AS hi FROM s) SELECT recording_id, hit_id, CAST(greatest(1, least(127, round_even(20 + 88 * least(1.0, greatest(0.0, (s - lo) / greatest(hi - lo, 1e-9))) + 12 * least(1.0, greatest(0.0, confidence)), 0))) AS INTEGER) AS velocity FROM q", "hits"))
def p22(t: Tables) -> DataFrame:
    return D.velocities(t.hits, REC).select(*REC, "hit_id", "velocity")


@query("p21_rejection", sql(_SCORE + " SELECT recording_id, hit_id, CASE WHEN confidence < 0.05 THEN 'low_confidence' WHEN class_name = 'tom_or_perc' AND confidence < 0.2 THEN 'tom_not_clear' END AS rejection_reason FROM scored", "hits"))
def p21(t: Tables) -> DataFrame:
    r = F.when(F.col("confidence") < 0.05, "low_confidence").when((F.col("class_name") == "tom_or_perc") & (F.col("confidence") < 0.2), "tom_not_clear")
    return t.hits.select(*REC, "hit_id", r.alias("rejection_reason"))


@query("a14_a15_class_counts", sql(", d AS (SELECT unnest(['kick', 'snare_or_clap', 'hat', 'cymbal', 'tom_or_perc', 'unknown']) AS class_name), r AS (SELECT recording_id, max(end_sec) AS dur FROM frames GROUP BY 1), c AS (SELECT recording_id, class_name, count(*) AS n FROM hits GROUP BY ALL) SELECT r.recording_id, d.class_name, coalesce(n, 0) AS hits, round(coalesce(n, 0) / dur, 9) AS per_second FROM r CROSS JOIN d LEFT JOIN c USING (recording_id, class_name)", "hits"))
def a14(t: Tables) -> DataFrame:
    length = t.frames.groupBy(*REC).agg(F.max("end_sec").alias("dur"))
    dom = length.withColumn("class_name", F.explode(F.array(*[F.lit(c) for c in D.CLASSES])))
    c = t.hits.groupBy(*REC, "class_name").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return dom.join(c, [*REC, "class_name"], "left").select(*REC, "class_name", n.alias("hits"), F.round(n / F.col("dur"), 9).alias("per_second"))


@query("a16_velocity_summary", sql(" SELECT layer, min(velocity) AS min_v, median(velocity) AS median_v, max(velocity) AS max_v, quantile_cont(velocity, 0.9) AS p90_v FROM notes GROUP BY 1", "notes"))
def a16(t: Tables) -> DataFrame:
    v = F.col("velocity")
    return t.notes.groupBy("layer").agg(F.min(v).alias("min_v"), F.median(v).alias("median_v"), F.max(v).alias("max_v"), F.percentile(v, 0.9).alias("p90_v"))


@query("a17_intervals", sql(", i AS (SELECT recording_id, class_name, onset_sec - lag(onset_sec) OVER (PARTITION BY recording_id, class_name ORDER BY onset_sec, hit_id) AS d FROM hits) SELECT class_name, round(min(d) * 1000, 6) AS min_ms, round(median(d) * 1000, 6) AS median_ms, count(*) FILTER (d < 0.08) AS under_80ms, count(*) FILTER (d < 0.5) AS under_refractory FROM i WHERE d IS NOT NULL GROUP BY 1", "hits"))
def a17(t: Tables) -> DataFrame:
    d = F.col("onset_sec") - F.lag("onset_sec").over(Window.partitionBy(*REC, "class_name").orderBy("onset_sec", "hit_id"))
    i = t.hits.select("class_name", d.alias("d")).where("d is not null")
    return i.groupBy("class_name").agg(F.round(F.min("d") * 1000, 6).alias("min_ms"), F.round(F.median("d") * 1000, 6).alias("median_ms"), F.count_if(F.col("d") < 0.08).alias("under_80ms"), F.count_if(F.col("d") < 0.5).alias("under_refractory"))


@query("a36_bpm", sql(", i AS (SELECT recording_id, onset_sec - lag(onset_sec) OVER (PARTITION BY recording_id ORDER BY onset_sec, hit_id) AS d FROM hits), m AS (SELECT recording_id, 60 / median(d) AS b FROM i WHERE d BETWEEN 0.06 AND 1.5 GROUP BY 1), l AS (SELECT recording_id, CASE WHEN b < 70 THEN b * pow(2, ceil(log2(70 / b))) ELSE b END AS b FROM m) SELECT recording_id, round(CASE WHEN b > 190 THEN b / pow(2, ceil(log2(b / 190))) ELSE b END, 6) AS bpm FROM l", "hits"))
def a36(t: Tables) -> DataFrame:
    d = F.col("onset_sec") - F.lag("onset_sec").over(Window.partitionBy(*REC).orderBy("onset_sec", "hit_id"))
    m = t.hits.select(*REC, d.alias("d")).where("d between 0.06 and 1.5").groupBy(*REC).agg(F.median("d").alias("m"))
    return m.select(*REC, F.round(D.bpm(F.col("m")), 6).alias("bpm"))


_GM = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in M.GM.items()) + ") AS m(source_note, target_note)"


@query("j24_remap_keep", sql(f" SELECT n.recording_id, n.note_id, CAST(coalesce(m.target_note, n.pitch_midi) AS INTEGER) AS pitch_midi FROM notes n LEFT JOIN {_GM} ON m.source_note = n.pitch_midi", "notes"))
def j24(t: Tables) -> DataFrame:
    m = F.broadcast(M.preset(t.spark, "gm"))  # 22 rows
    return t.notes.join(m, F.col("pitch_midi") == F.col("source_note"), "left").select(*REC, "note_id", F.coalesce("target_note", "pitch_midi").alias("pitch_midi"))


@query("x33_remap_nearest", sql(f", c AS (SELECT n.recording_id, n.note_id, m.target_note, row_number() OVER (PARTITION BY n.recording_id, n.note_id ORDER BY abs(m.source_note - n.pitch_midi), m.source_note) AS rn FROM notes n CROSS JOIN {_GM}) SELECT recording_id, note_id, CAST(target_note AS INTEGER) AS pitch_midi FROM c WHERE rn = 1", "notes"))
def x33(t: Tables) -> DataFrame:
    """Nearest mapped note: the 128 pitches meet the map once, and notes look the answer up."""
    pitches = t.spark.range(128).select(F.col("id").cast("int").alias("pitch_midi"))
    near = pitches.join(F.broadcast(M.preset(t.spark, "gm"))).groupBy("pitch_midi").agg(F.min(F.struct(F.abs(F.col("source_note") - F.col("pitch_midi")).alias("d"), "source_note", "target_note")).alias("b"))
    return t.notes.join(F.broadcast(near), "pitch_midi").select(*REC, "note_id", F.col("b.target_note").alias("pitch_midi"))


_SLOTS = "(VALUES " + ", ".join(f"('{f}_{i + 1}', {3 * k + i}, {M.GM_SLOTS[f][i]}, {str(f'{f}_{i + 1}' in M.ENABLED).lower()})" for k, f in enumerate(M.SLOT_FAMILIES) for i in range(3)) + ") AS s(slot, ordinal, note, enabled)"


@query("a20_duplicate_targets", f"SELECT CAST(note AS INTEGER) AS note, array_to_string(list_sort(list(slot)), ',') AS slots FROM {_SLOTS} GROUP BY note HAVING count(*) > 1")
def a20(t: Tables) -> DataFrame:
    g = M.slots(t.spark).groupBy("note").agg(F.array_join(F.sort_array(F.collect_list("slot")), ",").alias("slots"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").select("note", "slots")


@query("a18_pitch_histogram", sql(" SELECT layer, pitch_midi, count(*) AS notes FROM notes GROUP BY ALL", "notes"))
def a18(t: Tables) -> DataFrame:
    return t.notes.groupBy("layer", "pitch_midi").agg(F.count(F.lit(1)).alias("notes"))


@query("a21_layer_population", f"WITH c AS (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1) SELECT slot, coalesce(n, 0) AS hits, CASE WHEN NOT enabled THEN 'disabled' WHEN n IS NULL THEN 'empty' ELSE 'used' END AS state FROM {_SLOTS} LEFT JOIN c ON c.k = s.note")
def a21(t: Tables) -> DataFrame:
    c = t.base_events.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    s = M.slots(t.spark)
    return s.join(c, s.note == c.k, "left").select("slot", F.coalesce("n", F.lit(0)).alias("hits"), F.when(~F.col("enabled"), "disabled").when(F.col("n").isNull(), "empty").otherwise("used").alias("state"))


@query("p30_density_warnings", sql(", r AS (SELECT recording_id, max(end_sec) AS dur FROM frames GROUP BY 1), c AS (SELECT recording_id, count(*) FILTER (class_name = 'kick') AS kicks, count(*) FILTER (class_name = 'cymbal') AS cymbals, count(*) AS n FROM hits GROUP BY 1) SELECT recording_id, kicks > 40 AS too_many_kicks, cymbals > 40 AS too_many_cymbals, n / dur > 2.0 AS too_dense FROM c JOIN r USING (recording_id)", "hits"))
def p30(t: Tables) -> DataFrame:
    length = t.frames.groupBy(*REC).agg(F.max("end_sec").alias("dur"))
    k = F.col("class_name")
    c = t.hits.groupBy(*REC).agg(F.count_if(k == "kick").alias("kicks"), F.count_if(k == "cymbal").alias("cymbals"), F.count(F.lit(1)).alias("n"))
    return c.join(length, REC).select(*REC, (F.col("kicks") > 40).alias("too_many_kicks"), (F.col("cymbals") > 40).alias("too_many_cymbals"), (F.col("n") / F.col("dur") > 2.0).alias("too_dense"))
