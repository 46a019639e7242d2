"""Whole passes and their parts (M10, M24, M26, M27, K1, K12, K15, S4, A34, A37, A38, F24, J27, J28, U6, P15, P17, P21, P29, W25, X20-X26, X32, X34, X36, X40)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.functions import exprs as E
from staveforge.operators import drums as D
from staveforge.operators import pattern as PT
from staveforge.operators import repair as R
from staveforge.sources import drum_maps as M
from staveforge.sources.adapters import Tables
from staveforge.sources.shared import shared_dir

from . import drum_queries as DQ
from . import repair_queries as RQ
from .drum_queries import _SCORE, _scored
from .frame_queries import _ACTIVE, _regions
from .note_queries import _PLAN, EVIDENCE, MIN_RMS, ONSET, VALID, V, _valid
from .pattern_queries import _COARSE, _coarse
from .registry import query, sql

REC = ["recording_id"]


# ---- patterns


@query("a37_family_period", sql(_COARSE + """, o AS (SELECT recording_id, family_no, unnest(occ) * 0.5 AS tt FROM fams), d AS (SELECT recording_id, family_no, tt - lag(tt) OVER (PARTITION BY recording_id, family_no ORDER BY tt) AS d FROM o), b AS (SELECT *, min(d) OVER (PARTITION BY recording_id, family_no) AS base FROM d WHERE d > 0),
 n AS (SELECT recording_id, family_no, d / greatest(1, round_even(d / greatest(1e-6, base), 0)) AS p FROM b), g AS (SELECT recording_id, family_no, median(p) AS p, CASE WHEN count(*) > 1 THEN stddev_pop(p) ELSE 0.0 END AS v FROM n GROUP BY 1, 2) SELECT recording_id, family_no, round(p, 9) AS period_sec, round(greatest(0.0, least(1.0, 1 - v / greatest(1e-6, p))), 6) AS stability FROM g WHERE p > 0.03""", "notes"))
def a37(t: Tables) -> DataFrame:
    """Distances between occurrences over the multiple of the smallest that they are: median and stability."""
    o = PT.families(_coarse(t)).select(*REC, "family_no", F.explode("occurrences").alias("bar"))
    d = o.withColumn("d", (F.col("bar") - F.lag("bar").over(Window.partitionBy(*REC, "family_no").orderBy("bar"))) * 0.5).where("d > 0")
    d = d.withColumn("base", F.min("d").over(Window.partitionBy(*REC, "family_no")))
    p = d.withColumn("p", F.col("d") / F.greatest(F.lit(1.0), F.rint(F.col("d") / F.greatest(F.lit(1e-6), F.col("base")))))
    g = p.groupBy(*REC, "family_no").agg(F.median("p").alias("p"), F.stddev_pop("p").alias("v")).where("p > 0.03")
    return g.select(*REC, "family_no", F.round("p", 9).alias("period_sec"), F.round(E.clip(1 - F.col("v") / F.greatest(F.lit(1e-6), F.col("p")), 0.0, 1.0), 6).alias("stability"))


_BLOCKS = _COARSE + """, lb AS (SELECT recording_id, max(bar) AS lb FROM cb GROUP BY 1), ev AS (SELECT recording_id, CAST(unnest(range(0, lb + 1)) AS INTEGER) AS bar FROM lb), al AS (SELECT ev.recording_id, ev.bar, coalesce(n, 0) AS n, coalesce(s, []) AS s FROM ev LEFT JOIN cb USING (recording_id, bar)),
 oc AS (SELECT recording_id, family_no, size, s AS es, unnest(occ) AS bar FROM fams), og AS (SELECT *, lag(bar) OVER (PARTITION BY recording_id, family_no ORDER BY bar) AS bf FROM oc), gp AS (SELECT *, bar - bf AS gap FROM og WHERE bf IS NOT NULL),
 st AS (SELECT *, greatest(1.0, median(gap) OVER w) AS per, coalesce(stddev_pop(gap) OVER w, 0.0) AS va FROM gp WINDOW w AS (PARTITION BY recording_id, family_no)),
 sb AS (SELECT *, greatest(0.0, least(1.0, 1 - va / greatest(1.0, per))) AS stab, greatest(1, CAST(floor(len(es) * 0.35) AS INTEGER)) AS sparse FROM st WHERE gap > 1 AND abs(gap - greatest(1, round_even(gap / per, 0)) * per) <= greatest(1.0, per * 0.35)),
 mb AS (SELECT sb.*, unnest(range(bf + 1, sb.bar)) AS mbar FROM sb), mc AS (SELECT mb.*, al.n, len(list_filter(es, lambda x: NOT list_contains(al.s, x))) AS miss FROM mb JOIN al ON al.recording_id = mb.recording_id AND al.bar = mbar WHERE al.n <= sparse),
 md AS (SELECT *, greatest(0.0, least(1.0, 0.45 + 0.2 * least(1.0, size / 4.0) + 0.15 * stab + 0.15 * miss / greatest(1, len(es)) + 0.1 * (1 - least(1.0, n / (sparse + 1.0))) + 0.1 * least(1.0, greatest(0, gap - 1) / greatest(1.0, per)) + CASE WHEN n = 0 THEN 0.1 ELSE 0.0 END)) AS conf FROM mc WHERE miss > 0 AND miss >= greatest(1, ceil(len(es) * 0.5)))"""


@query("a38_missing_blocks", sql(_BLOCKS + " SELECT recording_id, CAST(mbar AS INTEGER) AS bar, family_no, CAST(max(miss) AS INTEGER) AS missing_slots, round(max(conf), 6) AS confidence FROM md GROUP BY recording_id, mbar, family_no", "notes"))
def a38(t: Tables) -> DataFrame:
    """The whole rule: steps near a multiple of the median, stability, share of missing slots, sparsity and confidence."""
    b = _coarse(t)
    o = PT.families(b).select(*REC, "family_no", F.col("size").alias("occ"), F.col("slots_at").alias("es"), F.explode("occurrences").alias("bar"))
    fam = Window.partitionBy(*REC, "family_no")
    g = o.withColumn("bf", F.lag("bar").over(fam.orderBy("bar"))).where("bf is not null").withColumn("gap", F.col("bar") - F.col("bf"))
    s = g.groupBy(*REC, "family_no").agg(F.greatest(F.lit(1.0), F.median("gap")).alias("per"), F.stddev_pop("gap").alias("va"))
    g = g.join(s, [*REC, "family_no"])
    times = F.greatest(F.lit(1.0), F.rint(F.col("gap") / F.col("per")))
    g = g.where((F.col("gap") > 1) & (F.abs(F.col("gap") - times * F.col("per")) <= F.greatest(F.lit(1.0), F.col("per") * 0.35)))
    g = g.withColumns({"stab": E.clip(1 - F.col("va") / F.greatest(F.lit(1.0), F.col("per")), 0.0, 1.0), "sparse": F.greatest(F.lit(1), F.floor(F.size("es") * 0.35).cast("int"))})
    m = g.select(*REC, "family_no", "occ", "es", "gap", "per", "stab", "sparse", F.explode(F.sequence(F.col("bf") + 1, F.col("bar") - 1)).alias("bar"))
    m = m.join(b.select(*REC, "bar", "n", "slots_at"), [*REC, "bar"]).where("n <= sparse").withColumn("miss", F.size(PT.missing_slots(F.col("slots_at"), F.col("es"))))
    m = m.where((F.col("miss") > 0) & (F.col("miss") >= F.greatest(F.lit(1), F.ceil(F.size("es") * 0.5))))
    c = (
        0.45 + 0.2 * F.least(F.lit(1.0), F.col("occ") / 4.0) + 0.15 * F.col("stab") + 0.15 * F.col("miss") / F.greatest(F.lit(1), F.size("es")) + 0.1 * (1 - F.least(F.lit(1.0), F.col("n") / (F.col("sparse") + 1.0)))
        + 0.1 * F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("gap") - 1) / F.greatest(F.lit(1.0), F.col("per"))) + F.when(F.col("n") == 0, 0.1).otherwise(0.0)
    )
    return m.groupBy(*REC, "bar", "family_no").agg(F.max("miss").alias("missing_slots"), F.round(F.max(E.clip(c, 0.0, 1.0)), 6).alias("confidence"))


_RUNS_OF = _COARSE + """, lb AS (SELECT recording_id, max(bar) AS lb FROM cb GROUP BY 1), ev AS (SELECT recording_id, CAST(unnest(range(0, lb + 1)) AS INTEGER) AS bar FROM lb), al AS (SELECT ev.recording_id, ev.bar, coalesce(n, 0) AS n FROM ev LEFT JOIN cb USING (recording_id, bar)),
 lim AS (SELECT recording_id, greatest(1, ceil(0.35 * median(n))) AS lim FROM al WHERE n > 0 GROUP BY 1), sp AS (SELECT al.recording_id, bar, bar - row_number() OVER (PARTITION BY al.recording_id ORDER BY bar) AS run FROM al JOIN lim USING (recording_id) WHERE n <= lim),
 sr AS (SELECT recording_id, min(bar) AS first_bar, max(bar) AS last_bar FROM sp GROUP BY recording_id, run), fb AS (SELECT recording_id, family_no, size, len(s) AS notes, p, unnest(occ) AS bar FROM fams),
 cx0 AS (SELECT sr.recording_id, first_bar, last_bar, 'before' AS side, family_no, max(bar) AS bar, first_bar - max(bar) AS distance, any_value(size) AS size, any_value(notes) AS notes, any_value(p) AS p FROM sr JOIN fb ON fb.recording_id = sr.recording_id AND fb.bar < first_bar AND fb.bar >= first_bar - 8 GROUP BY sr.recording_id, first_bar, last_bar, family_no
  UNION ALL SELECT sr.recording_id, first_bar, last_bar, 'after', family_no, min(bar), min(bar) - last_bar, any_value(size), any_value(notes), any_value(p) FROM sr JOIN fb ON fb.recording_id = sr.recording_id AND fb.bar > last_bar AND fb.bar <= last_bar + 8 GROUP BY sr.recording_id, first_bar, last_bar, family_no),
 cx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, first_bar, side ORDER BY distance) AS k FROM cx0) WHERE k <= 5)"""


def _contexts(t: Tables) -> DataFrame:
    """For each run of sparse bars the nearest families of eight bars on each side, five at most."""
    b = _coarse(t)
    f = PT.families(b).select(*REC, "family_no", "size", F.size("slots_at").alias("notes"), F.col("pitches").alias("p"), F.explode("occurrences").alias("bar"))
    r = PT.sparse_runs(b)
    near = r.withColumn("bar", F.explode(F.concat(F.sequence(F.col("first_bar") - 8, F.col("first_bar") - 1), F.sequence(F.col("last_bar") + 1, F.col("last_bar") + 8))))
    j = near.join(f, [*REC, "bar"]).withColumn("side", F.when(F.col("bar") < F.col("first_bar"), "before").otherwise("after"))
    j = j.withColumn("distance", F.when(F.col("side") == "before", F.col("first_bar") - F.col("bar")).otherwise(F.col("bar") - F.col("last_bar")))
    g = j.groupBy(*REC, "first_bar", "last_bar", "side", "family_no").agg(F.min(F.struct("distance", "bar", "size", "notes", "p")).alias("x")).select(*REC, "first_bar", "last_bar", "side", "family_no", "x.*")
    return g.withColumn("k", F.row_number().over(Window.partitionBy(*REC, "first_bar", "side").orderBy("distance"))).where("k <= 5")


@query("j27_family_context", sql(_RUNS_OF + " SELECT recording_id, first_bar, last_bar, side, family_no, CAST(bar AS INTEGER) AS bar, CAST(distance AS INTEGER) AS distance, size FROM cx", "notes"))
def j27(t: Tables) -> DataFrame:
    return _contexts(t).select(*REC, "first_bar", "last_bar", "side", "family_no", "bar", "distance", "size")


@query("u6_j28_bridges", sql(_RUNS_OF + """, iv AS (SELECT *, list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i]) AS steps FROM cx), pr AS (SELECT a.recording_id, a.first_bar, a.family_no AS fa, b.family_no AS fb, a.notes = b.notes AND a.steps = b.steps AS ok FROM iv a JOIN iv b ON a.recording_id = b.recording_id AND a.first_bar = b.first_bar AND a.side = 'before' AND b.side = 'after')
 SELECT recording_id, first_bar, count(*) FILTER (fa = fb) AS bridge_ids, bool_or(ok) AS compatible FROM pr GROUP BY 1, 2""", "notes"))
def u6(t: Tables) -> DataFrame:
    """Families on both sides of a run of sparse bars, and whether some pair has equal counts and intervals."""
    c = _contexts(t)
    p = F.col("p")
    steps = F.zip_with(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: x - y)
    c = c.select(*REC, "first_bar", "side", "family_no", "notes", steps.alias("steps"))
    a = c.where("side = 'before'").drop("side")
    b = c.where("side = 'after'").select(*REC, "first_bar", F.col("family_no").alias("f2"), F.col("notes").alias("n2"), F.col("steps").alias("s2"))
    j = a.join(b, [*REC, "first_bar"])
    return j.groupBy(*REC, "first_bar").agg(F.count_if(F.col("family_no") == F.col("f2")).alias("bridge_ids"), F.bool_or((F.col("notes") == F.col("n2")) & (F.col("steps") == F.col("s2"))).alias("compatible"))


@query("f24_group_key", sql(", b AS (SELECT recording_id, CAST(floor(start_sec / 2.0) AS INTEGER) AS bar, list(pitch_midi ORDER BY start_sec, note_id) AS p, list(start_sec ORDER BY start_sec, note_id) AS s FROM notes GROUP BY 1, 2) SELECT recording_id, bar, len(p) || '|' || array_to_string(list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i]), ',') || '|' || array_to_string(list_transform(range(1, len(s)), lambda i: CAST(round_even(round((s[i + 1] - s[i]) * 1000 / 80, 6), 0) AS BIGINT)), ',') AS group_key FROM b", "notes"))
def f24(t: Tables) -> DataFrame:
    """Count, intervals and onset distances in bins of 80 ms."""
    n = t.notes.withColumn("bar", F.floor(F.col("start_sec") / 2.0).cast("int"))
    b = n.groupBy(*REC, "bar").agg(F.array_sort(F.collect_list(F.struct("start_sec", "note_id", "pitch_midi"))).alias("x"))
    a, c = F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x"))
    pitch = F.array_join(F.zip_with(a, c, lambda u, v: (v["pitch_midi"] - u["pitch_midi"]).cast("string")), ",")
    rhythm = F.array_join(F.zip_with(a, c, lambda u, v: F.rint(F.round((v["start_sec"] - u["start_sec"]) * 1000 / 80, 6)).cast("long").cast("string")), ",")
    return b.select(*REC, "bar", F.concat_ws("|", F.size("x").cast("string"), pitch, rhythm).alias("group_key"))


# ---- drums


def _recursive(views: str, source: str, by: list[str], gap: str, out: str) -> str:
    """CTEs that keep rows of source (onset_sec, hit_id, score) spaced by gap, the stronger replacing the nearer."""
    keys, on = ", ".join(by), " AND ".join(f"{out}_o.{c} = {out}_f.{c}" for c in by)
    take = f"{out}_o.onset_sec - {out}_f.at >= {out}_o.gap OR {out}_o.score > {out}_f.v"
    head = views if views.startswith("WITH RECURSIVE") else views.replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f""", {out}_o AS (SELECT *, {gap} AS gap, row_number() OVER (PARTITION BY {keys} ORDER BY onset_sec, hit_id) AS rn FROM {source}),
 {out}_f AS (SELECT {keys}, rn, hit_id AS kept, onset_sec AS at, score AS v, 1 AS grp FROM {out}_o WHERE rn = 1 UNION ALL SELECT {', '.join(f'{out}_f.{c}' for c in by)}, {out}_o.rn, CASE WHEN {take} THEN {out}_o.hit_id ELSE {out}_f.kept END, CASE WHEN {take} THEN {out}_o.onset_sec ELSE {out}_f.at END,
  CASE WHEN {take} THEN {out}_o.score ELSE {out}_f.v END, CASE WHEN {out}_o.onset_sec - {out}_f.at >= {out}_o.gap THEN {out}_f.grp + 1 ELSE {out}_f.grp END FROM {out}_f JOIN {out}_o ON {out}_o.rn = {out}_f.rn + 1 AND {on}),
 {out} AS (SELECT {keys}, arg_max(kept, rn) AS hit_id FROM {out}_f GROUP BY {keys}, grp)"""


_PEAKS = ", pe AS (SELECT recording_id, frame_index, onset_score AS v, max(onset_score) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t, avg(onset_score) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY frame_index)), pk AS (SELECT recording_id, frame_index AS hit_id, CAST(frame_index AS DOUBLE) AS onset_sec, v AS score FROM pe WHERE v >= 0.02 AND v >= t AND v >= m + 0.01)"


@query("w25_peak_pick_wait", _recursive(sql(_PEAKS, "frames"), "pk", REC, "8.0", "kp") + " SELECT recording_id, hit_id AS frame_index FROM kp")
def w25(t: Tables) -> DataFrame:
    """Peaks with the wait rule: of peaks under eight frames apart the higher stays."""
    p = D.peaks(t.frames, REC, "frame_index", "onset_score", 3, 3, 6, 6, 0.01, 0.02).select(*REC, "frame_index", F.col("frame_index").cast("double").alias("at"), F.col("onset_score").alias("v"))
    return D.keep_spaced(p, REC, "at", "v", F.lit(8.0), "frame_index").select(*REC, "frame_index")


_REJECT = "CASE WHEN confidence < 0.05 THEN 'low_confidence' WHEN class_name = 'tom_or_perc' AND confidence < 0.2 THEN 'tom_not_clear' WHEN class_name NOT IN ('kick', 'snare_or_clap', 'hat', 'cymbal', 'tom_or_perc') OR rms < 0.08 THEN 'unknown_skipped' END"


def _reject() -> Column:
    known = F.col("class_name").isin(*D.CLASSES[:-1]) & (F.col("rms") >= 0.08)
    return F.when(F.col("confidence") < 0.05, "low_confidence").when((F.col("class_name") == "tom_or_perc") & (F.col("confidence") < 0.2), "tom_not_clear").when(~known, "unknown_skipped")


@query("p21_rejection_chain", sql(f", r AS (SELECT *, {_REJECT} AS reason FROM hits) SELECT recording_id, class_name, coalesce(reason, 'accepted') AS outcome, count(*) AS hits FROM r GROUP BY ALL", "hits"))
def p21(t: Tables) -> DataFrame:
    """How many hits of a class each rule of the chain turns away; a faint hit counts as unknown here."""
    return t.hits.groupBy(*REC, "class_name", F.coalesce(_reject(), F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("hits"))


_TARGET = "CASE class_name WHEN 'kick' THEN 36 WHEN 'snare_or_clap' THEN 39 WHEN 'hat' THEN 42 WHEN 'cymbal' THEN 49 WHEN 'crash_or_cymbal' THEN 49 WHEN 'tom_or_perc' THEN 45 ELSE 39 END"
# How long a note of a class sounds, in seconds.
LENGTHS = {"kick": 0.10, "snare_or_clap": 0.10, "hat": 0.06, "cymbal": 0.32, "tom_or_perc": 0.14, "unknown": 0.08}
# The notes of classes on the gm and sitala maps, by snare target.
TARGETS = {"kick": 36, "hat": 42, "cymbal": 49, "crash_or_cymbal": 49, "tom_or_perc": 45, "unknown": 39}
SNARES = {"sn1": 38, "sn2": 40, "clap": 39}


def target_note(name: Column, snare: str = "clap") -> Column:
    """P15 on gm and sitala."""
    out = F.when(name == "snare_or_clap", SNARES[snare])
    for k, v in TARGETS.items():
        out = out.when(name == k, v)
    return out.otherwise(TARGETS["unknown"])


def canonical_class(name: Column) -> Column:
    """X20."""
    return F.when(name == "crash_or_cymbal", "cymbal").when(name.isin(*D.CLASSES), name).otherwise("unknown")


def note_length(name: Column) -> Column:
    """Seconds of a class."""
    out = F.when(F.lit(False), 0.0)
    for k, v in LENGTHS.items():
        out = out.when(canonical_class(name) == k, v)
    return out.otherwise(LENGTHS["unknown"])


def semantic_slot(name: Column, high: Column, mid: Column, low: Column, attack: Column, decay: Column, centroid: Column, snare: str = "sn1") -> Column:
    """The layer slot of a hit; unknown classes have none."""
    c = canonical_class(name)
    snare_slot = F.lit("clap_1") if snare == "clap" else F.when((high >= 0.65) & (attack >= 0.58) & (decay <= 0.60), "clap_1").otherwise("snare_1")
    hat = F.when((decay >= 0.62) & (high >= 0.30), "hh_open_1").otherwise("hh_1")
    tom = F.when(high >= 0.82, "perc_1").when((centroid < 600) | (low > mid * 1.35), "tom_l_1").when((centroid < 1400) & (mid > 0.90), "tom_m_1").when((centroid < 3000) & (mid > 1.10), "tom_h_1").otherwise("tom_l_1")
    return F.when(c == "kick", "kick_1").when(c == "snare_or_clap", snare_slot).when(c == "hat", hat).when(c == "cymbal", "cym_1").when(c == "tom_or_perc", tom)


@query("p15_x20_x25_class_targets", sql(f" SELECT recording_id, hit_id, CASE class_name WHEN 'crash_or_cymbal' THEN 'cymbal' ELSE class_name END AS layer, CAST({_TARGET} AS INTEGER) AS note, CASE class_name WHEN 'kick' THEN 0.10 WHEN 'snare_or_clap' THEN 0.10 WHEN 'hat' THEN 0.06 WHEN 'cymbal' THEN 0.32 WHEN 'tom_or_perc' THEN 0.14 ELSE 0.08 END AS length_sec FROM hits", "hits"))
def p15(t: Tables) -> DataFrame:
    c = F.col("class_name")
    return t.hits.select(*REC, "hit_id", canonical_class(c).alias("layer"), target_note(c).alias("note"), note_length(c).alias("length_sec"))


@query("p17_x22_semantic_slots", sql(""", f AS (SELECT h.recording_id, hit_id, class_name, h.confidence AS high, h.rms * 1.5 AS mid, h.onset_score * 2 AS low, h.onset_score AS attack, 1 - h.confidence AS decay, f.k * 50.0 AS centroid FROM hits h JOIN frames f ON f.recording_id = h.recording_id AND f.frame_index = h.hit_id)
 SELECT recording_id, hit_id, CASE class_name WHEN 'kick' THEN 'kick_1' WHEN 'snare_or_clap' THEN CASE WHEN high >= 0.65 AND attack >= 0.58 AND decay <= 0.6 THEN 'clap_1' ELSE 'snare_1' END WHEN 'hat' THEN CASE WHEN decay >= 0.62 AND high >= 0.3 THEN 'hh_open_1' ELSE 'hh_1' END WHEN 'cymbal' THEN 'cym_1'
  WHEN 'tom_or_perc' THEN CASE WHEN high >= 0.82 THEN 'perc_1' WHEN centroid < 600 OR low > mid * 1.35 THEN 'tom_l_1' WHEN centroid < 1400 AND mid > 0.9 THEN 'tom_m_1' WHEN centroid < 3000 AND mid > 1.1 THEN 'tom_h_1' ELSE 'tom_l_1' END END AS slot FROM f""", "hits"))
def p17(t: Tables) -> DataFrame:
    """Slots of hits, with levels of the fixture in place of band energies."""
    h = t.hits.join(t.frames.select(*REC, F.col("frame_index").alias("hit_id"), "k"), [*REC, "hit_id"])
    return h.select(*REC, "hit_id", semantic_slot(F.col("class_name"), F.col("confidence"), F.col("rms") * 1.5, F.col("onset_score") * 2, F.col("onset_score"), 1 - F.col("confidence"), F.col("k") * 50.0).alias("slot"))


_GAP = "CASE class_name WHEN 'kick' THEN 0.5 WHEN 'hat' THEN 0.3 ELSE 0.8 END"
_WIN = _SCORE + f""", ok AS (SELECT * FROM scored WHERE {_REJECT} IS NULL), tn AS (SELECT *, CASE WHEN onset_sec - lag(onset_sec) OVER w > 0.15 THEN 1 ELSE 0 END AS nw FROM ok WINDOW w AS (PARTITION BY recording_id, class_name ORDER BY onset_sec, hit_id)), tg AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id, class_name ORDER BY onset_sec, hit_id ROWS UNBOUNDED PRECEDING) AS transient FROM tn),
 wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, class_name, transient ORDER BY score DESC, onset_sec, hit_id) AS r FROM tg) WHERE r = 1)"""
_SPACED = _recursive(sql(_WIN, "hits"), "wn", [*REC, "class_name"], "0.2", "sp") + ", sw AS (SELECT w.* FROM wn w JOIN sp ON sp.recording_id = w.recording_id AND sp.class_name = w.class_name AND sp.hit_id = w.hit_id)"


@query("m10_drum_extraction", _recursive(_SPACED, "sw", [*REC, "class_name"], _GAP, "kp") + f""", k AS (SELECT w.* FROM sw w JOIN kp ON kp.recording_id = w.recording_id AND kp.class_name = w.class_name AND kp.hit_id = w.hit_id), s AS (SELECT *, onset_score * (0.70 + 0.20 * confidence) AS st FROM k), q AS (SELECT *, quantile_cont(st, 0.1) OVER (PARTITION BY recording_id) AS lo, quantile_cont(st, 0.9) OVER (PARTITION BY recording_id) AS hi FROM s)
 SELECT recording_id, hit_id, class_name, CAST({_TARGET} AS INTEGER) AS note, CAST(greatest(1, least(127, round_even(20 + 88 * least(1.0, greatest(0.0, (st - lo) / greatest(hi - lo, 1e-9))) + 12 * least(1.0, greatest(0.0, confidence)), 0))) AS INTEGER) AS velocity, CAST(greatest(0, round_even(onset_sec * 960, 0)) AS BIGINT) AS tick FROM q""")
def m10(t: Tables) -> DataFrame:
    """From hits to drum notes: reject; by layer the best of each transient, spacing and refractory; velocity, target note and tick."""
    ok = _scored(t).where(_reject().isNull())
    best = D.group_winners(ok, [*REC, "class_name"], 0.15).where("not suppressed").drop("suppressed", "transient")
    best = D.keep_spaced(best, [*REC, "class_name"], "onset_sec", "score", F.lit(0.2), "hit_id")
    gap = F.when(F.col("class_name") == "kick", 0.5).when(F.col("class_name") == "hat", 0.3).otherwise(0.8)
    kept = D.keep_spaced(best, [*REC, "class_name"], "onset_sec", "score", gap, "hit_id")
    return D.velocities(kept, REC).select(*REC, "hit_id", "class_name", target_note(F.col("class_name")).alias("note"), "velocity", E.ticks(F.col("onset_sec")).alias("tick"))


@query("a34_x32_drum_audit", sql(" SELECT recording_id, pitch_midi, count(*) AS notes, (SELECT string_agg(DISTINCT CAST(channel AS VARCHAR), ',' ORDER BY CAST(channel AS VARCHAR)) FROM notes m WHERE m.recording_id = n.recording_id) AS channels FROM notes n WHERE channel = 9 GROUP BY 1, 2", "notes"))
def a34(t: Tables) -> DataFrame:
    """Pitches of the drum channel, and the channels of the recording."""
    all_ = t.notes.groupBy(*REC).agg(F.array_join(F.array_sort(F.collect_set(F.col("channel").cast("string"))), ",").alias("channels"))
    return t.notes.where("channel = 9").groupBy(*REC, "pitch_midi").agg(F.count(F.lit(1)).alias("notes")).join(all_, REC)


_GMV = DQ._GM


def remap(notes: DataFrame, mapping: DataFrame, unmapped: str, channel: int | None) -> DataFrame:
    """Drum notes through a map of source_note and target_note; unmapped ones stay (keep), go (drop), and channel, if given, is set (X34). changed tells which moved."""
    m = notes.where("channel = 9").join(F.broadcast(mapping), F.col("pitch_midi") == F.col("source_note"), "left")  # one row a pitch: 128 at most
    m = m.where("target_note is not null") if unmapped == "drop" else m
    out = m.withColumns({"changed": F.coalesce(F.col("target_note") != F.col("pitch_midi"), F.lit(False)), "pitch_midi": F.coalesce("target_note", "pitch_midi")})
    return (out.withColumn("channel", F.lit(channel)) if channel is not None else out).drop("source_note", "target_note")


@query("m24_drum_remap", sql(f" SELECT n.recording_id, n.note_id, m.target_note AS pitch_midi, 3 AS channel, m.target_note <> n.pitch_midi AS changed FROM notes n JOIN {_GMV} ON m.source_note = n.pitch_midi WHERE channel = 9", "notes"))
def m24(t: Tables) -> DataFrame:
    return remap(t.notes, M.preset(t.spark, "gm"), "drop", 3).select(*REC, "note_id", "pitch_midi", "channel", "changed")


@query("x36_remap_report", sql(f", r AS (SELECT n.recording_id, n.end_tick, m.target_note IS NOT NULL AS mapped, coalesce(m.target_note <> n.pitch_midi, false) AS changed FROM notes n LEFT JOIN {_GMV} ON m.source_note = n.pitch_midi WHERE channel = 9), l AS (SELECT recording_id, max(end_tick) AS src FROM notes WHERE channel = 9 GROUP BY 1) SELECT recording_id, count(*) AS notes, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT mapped) AS unmapped, max(end_tick) = any_value(src) AS sync_preserved FROM r JOIN l USING (recording_id) GROUP BY 1", "notes"))
def x36(t: Tables) -> DataFrame:
    """Counts of a remap that keeps unmapped notes, and whether the length in ticks stays."""
    drums, mapping = t.notes.where("channel = 9"), M.preset(t.spark, "gm")
    known = F.col("pitch_midi").isin(*M.GM)
    src = drums.groupBy(*REC).agg(F.max("end_tick").alias("src"), F.count_if(~known).alias("unmapped"))
    r = remap(t.notes, mapping, "keep", None).groupBy(*REC).agg(F.count(F.lit(1)).alias("notes"), F.count_if("changed").alias("changed"), F.max("end_tick").alias("now"))
    return r.join(src, REC).select(*REC, "notes", "changed", "unmapped", (F.col("now") == F.col("src")).alias("sync_preserved"))


# ---- timing, tempo, documents


@query("p29_x17_timing_fallback", sql(ONSET + " SELECT n.recording_id, n.note_id, round(coalesce(nearest_onset_sec, n.start_sec), 9) AS start_sec, round(CASE WHEN nearest_onset_sec IS NULL THEN n.end_sec ELSE greatest(nearest_onset_sec + 1e-4, n.end_sec) END, 9) AS end_sec, nearest_onset_sec IS NOT NULL AS aligned FROM notes n LEFT JOIN onset USING (recording_id, note_id)", "notes", "frames"))
def p29(t: Tables) -> DataFrame:
    """Aligned times where there are any, else the original ones."""
    on = V.onset_top1(t.notes, t.frames, 0.5).select(*REC, "note_id", "nearest_onset_sec")
    n, at = t.notes.join(on, [*REC, "note_id"], "left"), F.col("nearest_onset_sec")
    return n.select(*REC, "note_id", F.round(F.coalesce(at, "start_sec"), 9).alias("start_sec"), F.round(F.when(at.isNull(), F.col("end_sec")).otherwise(F.greatest(at + 1e-4, "end_sec")), 9).alias("end_sec"), at.isNotNull().alias("aligned"))


@query("x40_x44_tempo_normaliser", """WITH e AS (SELECT event_id, CAST(k * 10 - 50 AS BIGINT) AS tick, CASE WHEN k % 7 = 0 THEN 0 ELSE 400000 + k * 1000 END AS tempo FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)), n AS (SELECT event_id, greatest(0, tick) AS tick, CASE WHEN tempo <= 0 THEN 500000 ELSE tempo END AS tempo FROM e),
 l AS (SELECT tick, arg_max(tempo, event_id) AS tempo FROM n GROUP BY 1), d AS (SELECT *, lag(tempo) OVER (ORDER BY tick) AS was FROM l) SELECT tick, CAST(tempo AS INTEGER) AS tempo FROM d WHERE was IS NULL OR was <> tempo""")
def x40(t: Tables) -> DataFrame:
    """Negative ticks become 0, bad tempos the default, the last of a tick counts, repeats go. One window over tempo changes, few by nature."""
    e = t.base_events.select("event_id", (F.col("k") * 10 - 50).cast("long").alias("tick"), F.when(F.col("k") % 7 == 0, 0).otherwise(400000 + F.col("k") * 1000).alias("tempo"))
    n = e.select("event_id", F.greatest(F.lit(0), "tick").alias("tick"), F.when(F.col("tempo") <= 0, 500000).otherwise(F.col("tempo")).alias("tempo"))
    one = n.groupBy("tick").agg(F.max_by("tempo", "event_id").cast("int").alias("tempo"))
    was = F.lag("tempo").over(Window.orderBy("tick"))
    return one.withColumn("was", was).where("was is null or was <> tempo").drop("was")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_documents(notes: DataFrame, folder: str) -> None:
    """K1: one JSON document a recording, notes in canonical order, one file a partition."""
    note = F.struct("start_sec", "end_sec", "note_id", "pitch_midi", "velocity")
    notes.groupBy(*REC).agg(F.array_sort(F.collect_list(note)).alias("notes")).withColumn("schema_version", F.lit("0.1.0")).write.json(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against a fixed schema; a line that does not fit is an error."""
    schema = "recording_id string, schema_version string, notes array<struct<start_sec: double, end_sec: double, note_id: string, pitch_midi: int, velocity: int>>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)


@query("s4_k1_json_documents", sql(" SELECT recording_id, note_id, pitch_midi, velocity, round(start_sec, 9) AS start_sec, round(end_sec, 9) AS end_sec, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, note_id) - 1 AS INTEGER) AS place FROM notes", "notes"))
def s4(t: Tables) -> DataFrame:
    """Notes written as JSON documents and read back."""
    folder = shared_folder(t.spark, "documents")
    write_documents(t.notes, folder)
    d = read_documents(t.spark, folder).select(*REC, F.posexplode("notes").alias("place", "n"))
    return d.select(*REC, "n.note_id", "n.pitch_midi", "n.velocity", F.round("n.start_sec", 9).alias("start_sec"), F.round("n.end_sec", 9).alias("end_sec"), "place")


@query("k15_hit_csv", sql(f" SELECT recording_id, hit_id, hit_id || ',' || class_name || ',' || printf('%.6f', round(onset_sec, 6)) || ',' || printf('%.4f', round(confidence, 4)) || ',' || coalesce({_REJECT}, '') AS line FROM hits", "hits"))
def k15(t: Tables) -> DataFrame:
    """A line of the debug CSV for each raw hit, rejected ones too."""
    f = lambda c, d: F.format_string(f"%.{d}f", E.round_half(F.col(c), d))
    return t.hits.select(*REC, "hit_id", F.concat_ws(",", F.col("hit_id").cast("string"), "class_name", f("onset_sec", 6), f("confidence", 4), F.coalesce(_reject(), F.lit(""))).alias("line"))


# ---- the stem pipeline and its report

_SEL = EVIDENCE + ONSET + VALID + f", plan AS (SELECT *, {_PLAN} AS a FROM valid), sel AS (SELECT n.recording_id, n.note_id, n.pitch_midi, n.start_sec, n.end_sec FROM notes n JOIN plan p ON p.recording_id = n.recording_id AND p.note_id = n.note_id WHERE a IN ('KEEP', 'REVIEW'))"
_STEM = _SEL + _ACTIVE + RQ._phase1("sel") + RQ._apply1("sel") + RQ._phase2("n1") + RQ._APPLY2 + RQ._phase3("n2") + RQ._APPLY3 + RQ._phase5("n3")


def _stem(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plan, selected notes, repaired notes, regions and pitch frames, staged."""
    frames = RQ.staged_frames(t)
    plan = R.staged(V.plan(_valid(t), allow_delete=True).select(*REC, "note_id", "confidence", "plan_action", "onset_norm", "max_rms", "sustained"))
    sel = t.notes.join(plan.where(F.col("plan_action").isin("KEEP", "REVIEW")).select(*REC, "note_id"), [*REC, "note_id"], "left_semi")
    sel, regions = R.staged(sel.select(*REC, "note_id", "pitch_midi", "start_sec", "end_sec")), R.staged(_regions(t))
    return plan, sel, R.staged(R.repair(sel, regions, frames, t.pitch_frames, RQ.P)), regions, t.pitch_frames


@query("m26_process_stem", sql(_STEM + RQ._errors("sel", "b") + RQ._score("sel", "b") + RQ._errors("n5", "a") + RQ._score("n5", "a") + """, pc AS (SELECT recording_id, count(*) AS notes, count(*) FILTER (a = 'KEEP') AS kept, count(*) FILTER (a = 'REVIEW') AS review FROM plan GROUP BY 1), rc AS (SELECT recording_id, count(*) AS repaired_notes FROM n5 GROUP BY 1)
 SELECT recording_id, notes, kept, review, repaired_notes, scb.errors AS errors_before, sca.errors AS errors_after, round(0.35 * scb.coverage + 0.20 * scb.overhang + 0.30 * scb.continuity + 0.15 * scb.pitch_consistency, 9) AS score_before, round(0.35 * sca.coverage + 0.20 * sca.overhang + 0.30 * sca.continuity + 0.15 * sca.pitch_consistency, 9) AS score_after FROM pc JOIN rc USING (recording_id) JOIN scb USING (recording_id) JOIN sca USING (recording_id)""", "frames", "notes", "pitch_frames"))
def m26(t: Tables) -> DataFrame:
    """Validate, plan, select, repair and score every recording: what a run of the stem pipeline reports."""
    plan, sel, out, regions, pitch = _stem(t)
    a = F.col("plan_action")
    c = plan.groupBy(*REC).agg(F.count(F.lit(1)).alias("notes"), F.count_if(a == "KEEP").alias("kept"), F.count_if(a == "REVIEW").alias("review"))
    s = lambda n, k: R.score(n, regions, pitch).select(*REC, F.col("errors").alias(f"errors_{k}"), F.round("total", 9).alias(f"score_{k}"))
    return c.join(out.groupBy(*REC).agg(F.count(F.lit(1)).alias("repaired_notes")), REC).join(s(sel, "before"), REC).join(s(out, "after"), REC)


_QA = """, qa AS (SELECT p.recording_id, p.note_id, p.a AS plan_action, round(p.confidence, 6) AS confidence, CASE WHEN q.note_id IS NULL THEN NULL ELSE CAST(round_even((q.start_sec - n.start_sec) * 1000, 0) AS BIGINT) END AS start_shift_ms, CASE WHEN q.note_id IS NULL THEN NULL ELSE CAST(round_even((q.end_sec - n.end_sec) * 1000, 0) AS BIGINT) END AS end_shift_ms, concat_ws('; ', phase_1, phase_2, CASE WHEN cut THEN 'SPLIT' END, CASE WHEN phase_5 THEN 'GAP_CLOSED' END) AS actions
 FROM plan p JOIN notes n ON n.recording_id = p.recording_id AND n.note_id = p.note_id LEFT JOIN n5 q ON q.recording_id = p.recording_id AND q.note_id = p.note_id)"""


def _qa(t: Tables) -> DataFrame:
    plan, _, out, _, _ = _stem(t)
    plan = V.settled(plan, t.notes, t.frames, 6, MIN_RMS)
    n = t.notes.select(*REC, "note_id", F.col("start_sec").alias("s0"), F.col("end_sec").alias("e0"))
    j = plan.join(n, [*REC, "note_id"]).join(out, [*REC, "note_id"], "left")
    shift = lambda a, b: F.rint((F.col(a) - F.col(b)) * 1000).cast("long")
    tags = F.concat_ws("; ", "phase_1", "phase_2", F.when(F.col("cut"), "SPLIT"), F.when(F.col("phase_5"), "GAP_CLOSED"))
    return j.select(*REC, "note_id", "plan_action", E.round_half(F.col("confidence"), 6).alias("confidence"), shift("start_sec", "s0").alias("start_shift_ms"), shift("end_sec", "e0").alias("end_shift_ms"), tags.alias("actions"))


@query("m27_qa_report", sql(_STEM + _QA + " SELECT * FROM qa", "frames", "notes", "pitch_frames"))
def m27(t: Tables) -> DataFrame:
    """A row for each note: plan, confidence, how repair moved it and why; notes that were not selected have no shifts."""
    return _qa(t)


@query("k12_qa_csv", sql(_STEM + _QA + " SELECT recording_id, note_id, recording_id || ',' || note_id || ',' || plan_action || ',' || printf('%.6f', confidence) || ',' || coalesce(CAST(start_shift_ms AS VARCHAR), '') || ',' || coalesce(CAST(end_shift_ms AS VARCHAR), '') || ',\"' || actions || '\"' AS line FROM qa", "frames", "notes", "pitch_frames"))
def k12(t: Tables) -> DataFrame:
    """The report's CSV lines, columns in a fixed order, actions quoted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return _qa(t).select(*REC, "note_id", F.concat_ws(",", "recording_id", "note_id", "plan_action", F.format_string("%.6f", "confidence"), text("start_shift_ms"), text("end_shift_ms"), E.csv_field(F.col("actions"))).alias("line"))
