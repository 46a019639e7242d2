"""Regions that a completion may write: long gaps with evidence and the trailing gap, each with its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.sources.shared import staged

from . import pack as K
from .timejoin import interval_join, preceding

REC = K.REC
#: Seconds of context on each side, and the notes that it may hold on each.
CONTEXT_SEC, CONTEXT_NOTES = 5.0, 24
#: Seconds around a region over which its density is taken.
DENSITY_SEC = 3.0


def open_gaps(notes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(recording_id, start_sec, end_sec, longest, usual) of the long gaps between neighbouring notes and after the last one.

    Long is at least 0.14 s, 0.75 of the median duration and 0.9 of the median distance of onsets; longest is the most a
    region may last, usual the median duration. Notes go by start, end, pitch and id. Recordings of one note have none.
    """
    p = preceding(notes, REC, "start_sec", ["start_sec", "end_sec", "pitch_midi", "note_id"], F.struct("start_sec", "end_sec"), "prev")
    long_, apart = F.col("end_sec") - F.col("start_sec"), F.col("start_sec") - F.col("prev.start_sec")
    last = F.max_by("end_sec", F.struct("start_sec", "end_sec", "pitch_midi", "note_id"))
    s = p.groupBy(*REC).agg(F.median(F.when(long_ > 0, long_)).alias("d"), F.median(F.when(apart > 0, apart)).alias("o"), F.count(F.lit(1)).alias("n"), last.alias("tail")).where("n >= 2")
    usual = F.coalesce("d", F.lit(0.25))
    onset = F.coalesce("o", usual)
    least, longest = F.greatest(F.lit(0.14), usual * 0.75, onset * 0.9), F.greatest(F.lit(0.75), F.least(F.lit(10.0), onset * 12))
    s = s.select(*REC, "tail", usual.alias("usual"), least.alias("least"), longest.alias("longest"))
    inner = p.where("prev is not null").select(*REC, F.col("prev.end_sec").alias("start_sec"), F.col("start_sec").alias("end_sec"))
    tail = s.join(lengths, REC).select(*REC, F.col("tail").alias("start_sec"), F.col("duration_sec").alias("end_sec"))
    g = inner.unionByName(tail).join(s.drop("tail"), REC)
    return g.where(F.col("end_sec") - F.col("start_sec") >= F.col("least")).drop("least")


def writable(notes: DataFrame, runs: DataFrame, tones: DataFrame, lengths: DataFrame, bucket: float = 4.0) -> DataFrame:
    """(recording_id, region_id, start_sec, end_sec, onset_count, reason, usual, duration_sec): gaps with evidence, cut to it, joined where at most 0.1 s apart to the nanosecond (binary rounding aside)."""
    g = staged(open_gaps(notes, lengths))
    e = K.gap_evidence(g.select(*REC, "start_sec", "end_sec"), runs, tones, bucket).where("has_evidence")
    e = e.join(g.select(*REC, "start_sec", "longest"), [*REC, "start_sec"])
    a, b = F.greatest("start_sec", "active_start"), F.least("end_sec", "active_end")
    thin = b <= a + 0.04
    e = e.select(*REC, F.when(thin, F.col("start_sec")).otherwise(a).alias("a"), F.when(thin, F.col("end_sec")).otherwise(b).alias("b"), "longest", "onset_count", "reason")
    e = e.select(*REC, F.col("a").alias("start_sec"), F.least("b", F.col("a") + F.col("longest")).alias("end_sec"), "onset_count", "reason").where("end_sec > start_sec + 0.08")
    m = K.merge_candidates(e, 0.1)
    m = m.withColumn("region_id", F.format_string("acr_%04d", F.row_number().over(Window.partitionBy(*REC).orderBy("start_sec"))))
    m = m.join(lengths.select(*REC, "duration_sec"), REC).join(g.select(*REC, "usual").distinct(), REC)
    m = m.withColumns({"start_sec": F.greatest(F.lit(0.0), F.col("start_sec")), "end_sec": F.least("duration_sec", "end_sec")})
    return m.where("end_sec > start_sec + 0.08").select(*REC, "region_id", "start_sec", "end_sec", "onset_count", "reason", "usual", "duration_sec")


def _around(regions: DataFrame, notes: DataFrame, reach: float) -> DataFrame:
    """Notes that touch a region widened by reach, with the region's own times as a and b; note columns with the prefix r_."""
    wide = regions.select(*REC, "region_id", "duration_sec", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), (F.col("start_sec") - reach).alias("start_sec"), (F.col("end_sec") + reach).alias("end_sec"))
    return interval_join(wide, notes.select(*REC, "note_id", "start_sec", "end_sec", "pitch_midi"), REC, max(4.0, reach), closed=True).drop("start_sec", "end_sec")


_NOTES = "array<struct<start:double,end:double,pitch:int,id:string>>"
_REGION = [*REC, "region_id"]


def _note() -> Column:
    return F.struct(F.col("r_start_sec").alias("start"), F.col("r_end_sec").alias("end"), F.col("r_pitch_midi").alias("pitch"), F.col("r_note_id").alias("id"))


def nearest_notes(regions: DataFrame, notes: DataFrame, limit: int = CONTEXT_NOTES) -> DataFrame:
    """(recording_id, region_id, nearest): the limit notes whose start is nearest to the region's or whose end is nearest to its end, nearest first.

    The search widens eightfold for the regions that have not found enough within its reach, up to the recording's length.
    """
    order = [F.col("away"), *[F.col(f"r_{c}") for c in ("start_sec", "end_sec", "pitch_midi", "note_id")]]
    away = F.least(F.abs(F.col("r_start_sec") - F.col("a")), F.abs(F.col("r_end_sec") - F.col("b")))
    todo, reach, out = regions, 8.0, None
    longest = notes.groupBy(*REC).agg((F.max("end_sec") - F.least(F.lit(0.0), F.min("start_sec"))).alias("span"))
    todo = todo.join(longest, REC)
    while todo.limit(1).count():
        found = _around(todo, notes, reach).withColumn("away", away).where(F.col("away") <= reach)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*_REGION).orderBy(*order))).where(F.col("rank") <= limit)
        got = found.groupBy(*_REGION).agg(F.array_sort(F.collect_list(F.struct("rank", _note().alias("note")))).alias("n"))
        done = todo.where(F.greatest("span", "duration_sec") <= reach).select(*_REGION).unionByName(got.where(F.size("n") >= limit).select(*_REGION)).distinct()
        part = staged(got.join(done, _REGION, "left_semi").select(*_REGION, F.transform("n", lambda x: x["note"]).alias("nearest")))
        out = part if out is None else out.unionByName(part)
        todo, reach = staged(todo.join(done, _REGION, "left_anti")), reach * 8
    return out


def _steps(a: Column) -> Column:
    """Distances above 0 between neighbouring starts, in microseconds' rounding."""
    raw = F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(a, i)["start"] - F.get(a, i - 1)["start"])).otherwise(F.array().cast("array<double>"))
    return F.transform(F.filter(raw, lambda d: d > 0), lambda d: F.round(d, 6))


def _common(a: Column, limit: int) -> Column:
    """The commonest values of an array, the first seen of equals."""
    counted = F.transform(F.array_distinct(a), lambda x, i: F.struct((-F.size(F.filter(a, lambda y: y == x))).alias("c"), i.alias("i"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(counted), lambda s: s["x"]), 1, limit)


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _deviation(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))


def completion_regions(notes: DataFrame, runs: DataFrame, tones: DataFrame, lengths: DataFrame, bucket: float = 4.0) -> DataFrame:
    """A row for each region of writable(), with what a completion is told of it.

    notes: recording_id, note_id, start_sec, end_sec, pitch_midi. runs and tones are the evidence of pack.gap_evidence,
    lengths has duration_sec. before holds up to 24 notes that end in the 5 s up to the region, after up to 24 that start
    in the 5 s from its end; a region with neither takes the 24 nearest of its recording. From these come the set, range
    and preference of pitches, key, rhythm and motif with its confidence; optional regions have a faint motif or too few
    notes around. Counts and density follow the notes within 3 s and the onsets heard. Notes of equal times go by pitch,
    then id. Arrays hold at most 48 notes. Recordings without notes, or of one, give no rows.
    """
    r = staged(writable(notes, runs, tones, lengths, bucket))
    near = staged(_around(r, notes, CONTEXT_SEC))
    before = (F.col("r_end_sec") <= F.col("a")) & (F.col("r_end_sec") >= F.greatest(F.lit(0.0), F.col("a") - CONTEXT_SEC))
    after = (F.col("r_start_sec") >= F.col("b")) & (F.col("r_start_sec") <= F.least("duration_sec", F.col("b") + CONTEXT_SEC))
    ends, starts = ["r_end_sec", "r_start_sec", "r_pitch_midi", "r_note_id"], ["r_start_sec", "r_end_sec", "r_pitch_midi", "r_note_id"]

    def side(rows: DataFrame, order: list[str], last: bool, out: str) -> DataFrame:
        w = Window.partitionBy(*_REGION).orderBy(*[F.col(c).desc() if last else F.col(c) for c in order])
        held = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CONTEXT_NOTES)
        place = -F.col("rank") if last else F.col("rank")
        listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), _note().alias("note"))))
        return held.groupBy(*_REGION).agg(F.transform(listed, lambda x: x["note"]).alias(out))

    lo, hi = F.greatest(F.lit(0.0), F.col("a") - DENSITY_SEC), F.least("duration_sec", F.col("b") + DENSITY_SEC)
    dense = near.groupBy(*_REGION).agg(F.count_if((F.col("r_start_sec") < hi) & (F.col("r_end_sec") > lo)).alias("around"))
    c = r
    for part in (side(near.where(before), ends, True, "before"), side(near.where(after), starts, False, "after"), dense):
        c = c.join(part, _REGION, "left")
    none = F.array().cast(_NOTES)
    c = staged(c.withColumns({"before": F.coalesce("before", none), "after": F.coalesce("after", none), "around": F.coalesce("around", F.lit(0))}))
    lone = c.where((F.size("before") == 0) & (F.size("after") == 0)).select(*r.columns)
    if lone.limit(1).count():
        c = c.join(nearest_notes(lone, notes), _REGION, "left")
    else:
        c = c.withColumn("nearest", F.lit(None).cast(_NOTES))
    local = F.concat("before", "after", F.coalesce("nearest", none))
    c = staged(c.withColumn("local", local).drop("nearest"))
    heard = c.select(*_REGION, F.posexplode("local").alias("start_sec", "x")).select(*_REGION, "start_sec", F.col("x.id").alias("note_id"), F.col("x.pitch").alias("pitch_midi"))
    return described(c.join(K.key_estimate(heard, _REGION), _REGION, "left"))


def described(c: DataFrame) -> DataFrame:
    """What completion_regions says of a region, from its before, after, local and around."""

    def by_start(a: Column) -> Column:
        return F.array_sort(a)  # the fields of a note are start, end, pitch, id

    local, before, after = F.col("local"), F.col("before"), F.col("after")
    b, a = by_start(before), by_start(after)
    motif = (
        F.when((F.size(b) > 0) & (F.size(a) > 0), F.concat(F.slice(b, -F.least(F.lit(4), F.size(b)), F.lit(4)), F.slice(a, 1, 4)))
        .when(F.size(b) > 0, F.slice(b, -F.least(F.lit(6), F.size(b)), F.lit(6)))
        .otherwise(F.slice(a, 1, 6))
    )
    c = c.withColumns({"pitches": F.transform(local, lambda x: x["pitch"]), "ordered": by_start(local), "intervals": F.slice(_steps(by_start(F.concat(before, after))), 1, 24), "motif": motif})
    c = c.withColumn("motif_pitches", F.transform("motif", lambda x: x["pitch"]))
    pitch_steps = F.when(F.size("motif") > 1, F.transform(F.sequence(F.lit(1), F.size("motif") - 1), lambda i: F.get("motif_pitches", i) - F.get("motif_pitches", i - 1))).otherwise(F.array().cast("array<int>"))
    own = _steps(F.col("motif"))
    c = c.withColumns({"motif_intervals": pitch_steps, "motif_rhythm": F.when(F.size(own) > 0, own).otherwise(F.slice("intervals", 1, 8))})
    steps, rhythm, nb, na = F.col("motif_intervals"), F.col("motif_rhythm"), F.size("before"), F.size("after")
    most = F.size(F.filter(steps, lambda x: x == F.get(_common(steps, 1), F.lit(0))))
    sure = (
        F.when(nb >= 4, 0.35).when(nb >= 2, 0.2).otherwise(0.0)
        + F.when(na >= 3, 0.35).when(na >= 1, 0.2).otherwise(0.0)
        + F.when(F.size(steps) == 0, 0.0).when(most >= 2, 0.2).otherwise(0.1)
        + F.when(F.size(rhythm) >= 2, F.when(_deviation(rhythm) <= 0.25, 0.1).otherwise(0.0)).when(F.size(rhythm) == 1, 0.05).otherwise(0.0)
    )
    c = c.withColumn("motif_confidence", F.least(F.lit(1.0), F.round(sure, 3)))
    c = c.withColumn("optional", (F.col("motif_confidence") < 0.45) | (nb < 2) | (na < 1))

    lasting = F.filter(F.transform(local, lambda x: x["end"] - x["start"]), lambda d: d > 0)
    middle = F.coalesce(_median(lasting), F.col("usual"))
    size = F.col("end_sec") - F.col("start_sec")
    span = F.least("duration_sec", F.col("end_sec") + DENSITY_SEC) - F.greatest(F.lit(0.0), F.col("start_sec") - DENSITY_SEC)
    c = c.withColumns({"min_duration": F.greatest(F.lit(0.05), F.least(F.lit(0.5), middle * 0.45)), "longest": F.least(F.greatest(F.lit(1.2), size), F.greatest(F.lit(0.3), middle * 3.2)), "density": F.col("around") / F.greatest(F.lit(0.25), span), "size": F.greatest(F.lit(0.1), size)})
    c = c.withColumn("max_duration", F.when(F.col("longest") <= F.col("min_duration"), F.col("min_duration") + 0.1).otherwise(F.col("longest")))
    centre = F.col("density") * F.col("size")
    c = c.withColumn("centre", F.when(F.col("onset_count") > 0, F.greatest(centre, F.least(F.lit(8.0), F.col("onset_count").cast("double")))).otherwise(centre))
    floor = F.floor(F.col("centre") * 0.4).cast("int")
    c = c.withColumn("least_notes", F.when(F.col("optional"), 0).when((F.col("centre") >= 1) & (floor == 0), 1).otherwise(floor))
    c = c.withColumn("most_notes", F.greatest("least_notes", F.least(F.lit(24), (F.ceil(F.col("centre") * 1.8) + 1).cast("int"))))
    beat = _median(F.col("intervals"))
    pace = F.when(beat > 0, 1.2 / F.greatest(F.lit(0.05), beat)).otherwise(0.0)
    limit = F.greatest(F.lit(0.35), F.least(F.lit(8.0), F.greatest(F.col("density") * 1.7, pace, F.col("most_notes") / F.col("size"))))
    low, high = F.array_min("pitches"), F.array_max("pitches")
    lowest, highest = F.greatest(F.lit(0), low), F.least(F.lit(127), high)

    def ids(side: Column) -> Column:
        return F.transform(side, lambda x: x["id"])

    onsets = F.transform(F.slice("ordered", 1, 24), lambda x: F.round(x["start"], 6))
    gaps = F.when(F.size(onsets) > 1, F.transform(F.sequence(F.lit(1), F.size(onsets) - 1), lambda i: F.round(F.get(onsets, i) - F.get(onsets, i - 1), 6))).otherwise(F.array().cast("array<double>"))
    return c.select(
        *_REGION,
        "start_sec",
        "end_sec",
        "reason",
        F.greatest(F.lit(0.0), F.col("start_sec") - CONTEXT_SEC).alias("context_start_sec"),
        F.least("duration_sec", F.col("end_sec") + CONTEXT_SEC).alias("context_end_sec"),
        ids(before).alias("before"),
        ids(after).alias("after"),
        F.array_sort(F.array_distinct("pitches")).alias("pitch_set"),
        lowest.alias("lowest"),
        highest.alias("highest"),
        _common(F.col("pitches"), 8).alias("preferred"),
        F.array_compact(F.array(F.when(lowest > 0, lowest - 1), F.when(highest < 127, highest + 1))).alias("forbidden"),
        "key_name",
        onsets.alias("onsets"),
        gaps.alias("onset_gaps"),
        _common(F.transform("ordered", lambda x: F.round(x["end"] - x["start"], 6)), 8).alias("common_durations"),
        "intervals",
        "motif_pitches",
        "motif_intervals",
        "motif_rhythm",
        "motif_confidence",
        "optional",
        "least_notes",
        "most_notes",
        limit.alias("density_limit"),
        "min_duration",
        "max_duration",
    )
