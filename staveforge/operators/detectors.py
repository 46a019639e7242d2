"""Drum candidates from band envelopes: five detectors or one over the full band, and their way to accepted hits."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from staveforge.sources.shared import staged

from . import drums as D
from .onsets import Picking, detect_onsets

# Class and least onset strength of each detector, which reads the envelope of its own name.
DETECTORS: dict[str, tuple[str, float]] = {
    "kick": ("kick", 0.24),
    "snare": ("snare_or_clap", 0.22),
    "hat": ("hat", 0.22),
    "cymbal": ("cymbal", 0.28),
    "tom": ("tom_or_perc", 0.24),
}
# Weights of onset strength, dominance, attack and decay in a detector's confidence.
WEIGHTS: dict[str, tuple[float, float, float, float]] = {
    "kick": (0.48, 0.34, 0.18, 0.0),
    "snare": (0.46, 0.30, 0.24, 0.0),
    "hat": (0.44, 0.32, 0.24, 0.0),
    "cymbal": (0.42, 0.28, 0.0, 0.30),
    "tom": (0.44, 0.34, 0.22, 0.0),
}
LEVELS = ("low", "mid", "upper", "high")
#: Frames in a part of the numbering.
PART = 4096
_EPS = 1e-9


@dataclass(frozen=True)
class Profile:
    """Settings of an extraction; milliseconds where the name says so. The values as given are those of balanced."""

    onset_pre_max: int = 1
    onset_post_max: int = 1
    onset_pre_avg: int = 5
    onset_post_avg: int = 5
    onset_delta: float = 0.08
    onset_wait: int = 1
    min_hit_spacing_ms: float = 60.0
    kick_refractory_ms: float = 140.0
    snare_refractory_ms: float = 120.0
    hat_refractory_ms: float = 55.0
    cymbal_refractory_ms: float = 240.0
    tom_refractory_ms: float = 100.0
    same_transient_window_ms: float = 35.0
    min_class_confidence: float = 0.55

    def picking(self, minimum: float) -> Picking:
        return Picking(self.onset_pre_max, self.onset_post_max, self.onset_pre_avg, self.onset_post_avg, self.onset_delta, self.onset_wait, minimum)

    def refractory_sec(self, class_name: Column) -> Column:
        own = F.lit(self.tom_refractory_ms)
        for name, ms in (("kick", self.kick_refractory_ms), ("snare_or_clap", self.snare_refractory_ms), ("hat", self.hat_refractory_ms), ("cymbal", self.cymbal_refractory_ms)):
            own = F.when(class_name == name, ms).otherwise(own)
        return own / 1000


# The settings of the three profiles.
PROFILES: dict[str, Profile] = {
    "conservative": Profile(
        onset_pre_avg=6,
        onset_post_avg=6,
        onset_delta=0.10,
        onset_wait=2,
        min_hit_spacing_ms=80.0,
        kick_refractory_ms=160.0,
        snare_refractory_ms=140.0,
        hat_refractory_ms=70.0,
        cymbal_refractory_ms=320.0,
        tom_refractory_ms=140.0,
        min_class_confidence=0.60,
    ),
    "balanced": Profile(),
    "sensitive": Profile(
        onset_pre_avg=4,
        onset_post_avg=4,
        onset_delta=0.05,
        min_hit_spacing_ms=45.0,
        kick_refractory_ms=110.0,
        snare_refractory_ms=95.0,
        hat_refractory_ms=40.0,
        cymbal_refractory_ms=180.0,
        tom_refractory_ms=80.0,
        same_transient_window_ms=30.0,
        min_class_confidence=0.50,
    ),
}


def profile(name: str = "balanced", **overrides: float | None) -> Profile:
    """A profile's settings under the overrides that are not None; ValueError for unknown names and negative values."""
    if name not in PROFILES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    if unknown := overrides.keys() - {f.name for f in fields(Profile)}:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    out = replace(PROFILES[name], **{k: v for k, v in overrides.items() if v is not None})
    for f in fields(out):
        if getattr(out, f.name) < 0:
            raise ValueError(f"{f.name} must be at least 0")
    return out


def described(found: DataFrame, env: DataFrame, by: list[str]) -> DataFrame:
    """found (by, detector, band, frame_index, onset_sec, strength, relaxed) with low, mid, upper, high, attack and decay.

    Each onset asks for the thirteen frames of its own band from three before to nine after it, and for the four levels
    at its frame; one equi-join by frame answers all, so a long signal is spread like its frames.
    """
    at = F.col("frame_index")
    own = F.transform(F.sequence(at - 3, at + 9), lambda f: F.struct(F.col("band").alias("band"), f.alias("frame"), F.lit("own").alias("role")))
    levels = F.array(*[F.struct(F.lit(b).alias("band"), at.alias("frame"), F.lit(b).alias("role")) for b in LEVELS])
    asked = found.select(*by, "detector", at.alias("at"), "onset_sec", "strength", "relaxed", F.explode(F.concat(own, levels)).alias("ask"))
    asked = asked.select(*by, "detector", "at", "onset_sec", "strength", "relaxed", "ask.band", "ask.frame", "ask.role")
    heard = asked.join(env.select(*by, "band", F.col("frame_index").alias("frame"), F.col("strength").alias("level")), [*by, "band", "frame"])

    def mean(lo: int, hi: int) -> Column:
        return F.avg(F.when((F.col("role") == "own") & F.col("frame").between(F.col("at") + lo, F.col("at") + hi), F.col("level")))

    named = [F.max(F.when(F.col("role") == b, F.col("level"))).alias(b) for b in LEVELS]
    whole = [F.any_value(c).alias(c) for c in ("onset_sec", "strength", "relaxed")]
    g = heard.groupBy(*by, "detector", "at").agg(*whole, *named, mean(-3, 0).alias("pre"), mean(0, 2).alias("short"), mean(0, 9).alias("long"))
    attack, decay = (F.col("short") - F.col("pre")) / (F.col("short") + _EPS), F.col("long") / (F.col("short") + _EPS)
    return g.withColumns({"attack": _within(attack), "decay": _within(decay)}).withColumnRenamed("at", "frame_index").drop("pre", "short", "long")


def _within(x: Column, top: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(top), x))


def _by_detector(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, v in values.items():
        out = F.when(F.col("detector") == name, v).otherwise(out)
    return out


def _bands(df: DataFrame) -> DataFrame:
    """Shares of the three main bands and the centroid that stands for them."""
    total = F.col("low") + F.col("mid") + F.col("high") + _EPS
    out = df.withColumns({f"{b}_ratio": F.col(b) / total for b in ("low", "mid", "high")})
    return out.withColumn("centroid", F.col("low_ratio") * 120 + F.col("mid_ratio") * 1600 + F.col("high_ratio") * 7000)


def numbered(df: DataFrame, by: list[str], parts: list[str], order: list[Column], out: str) -> DataFrame:
    """df with out, the number of a row in its key from 0, by parts, then order. Rows are ordered within a part, and only the counts of parts within a key."""
    n = df.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy(*by, *parts).orderBy(*order)) - 1
    return df.join(n, [*by, *parts]).withColumn(out, F.col("__before") + rank).drop("__before")


def detector_candidates(env: DataFrame, by: list[str], p: Profile, rate: float, hop: int = 256) -> DataFrame:
    """The candidates of all five detectors.

    env has (by, band, frame_index, strength) for the five detectors' bands and the four levels. All detectors are picked
    in one pass, each at its own least strength, and each signal and detector without an onset once more with looser
    thresholds. candidate_id counts a signal's candidates by detector in the order of DETECTORS, then time. A candidate
    carries its detector, the envelope levels, attack, decay, dominance, confidence, and the class that competes with it.
    """
    own = env.where(F.col("band").isin(*DETECTORS))
    least = F.lit(0.0)
    for name, (_, threshold) in DETECTORS.items():
        least = F.when(F.col("band") == name, max(p.onset_delta, threshold, 0.04)).otherwise(least)
    found = detect_onsets(own, [*by, "band"], p.picking(0.0), rate, hop, least).withColumn("detector", F.col("band"))
    c = _bands(described(found, env, by))
    low, mid, upper, high, attack, decay = (F.col(x) for x in (*LEVELS, "attack", "decay"))
    total = low + mid + high + _EPS
    snare = F.least(F.lit(1.5), mid + 0.7 * upper)
    dominance = {
        "kick": low / total,
        "snare": snare / F.greatest(snare + low + 0.5 * high, F.lit(_EPS)),
        "hat": high / (mid + high + _EPS),
        "cymbal": (high + 0.4 * upper) / total,
        "tom": (0.6 * low + mid) / total,
    }
    less = {
        "kick": F.when(decay > 0.92, 0.10 * decay).otherwise(0.0),
        "snare": F.when((high > 0.85) & (mid < 0.30), 0.09).otherwise(0.0),
        "hat": F.lit(0.0),
        "cymbal": F.when((attack > 0.70) & (decay < 0.35), 0.12).otherwise(0.0),
        "tom": F.when(high > 0.70, 0.12).otherwise(0.0),
    }
    rivals = {
        "kick": ("tom_or_perc", 0.65 * mid),
        "snare": ("cymbal", 0.55 * high),
        "hat": ("cymbal", 0.55 * high + 0.25 * decay),
        "cymbal": ("hat", 0.55 * high + 0.25 * attack),
        "tom": ("kick", 0.65 * low),
    }
    confidence = {d: w[0] * F.col("strength") + w[1] * dominance[d] + w[2] * attack + w[3] * decay - less[d] for d, w in WEIGHTS.items()}
    place = _by_detector({d: F.lit(i) for i, d in enumerate(DETECTORS)})
    c = c.withColumns(
        {
            "class_name": _by_detector({d: F.lit(name) for d, (name, _) in DETECTORS.items()}),
            "dominance": _within(_by_detector(dominance)),
            "confidence": _within(_by_detector(confidence), 0.99),
            "rival": _by_detector({d: F.lit(r) for d, (r, _) in rivals.items()}),
            "rival_score": _within(_by_detector({d: s for d, (_, s) in rivals.items()})),
            "__place": place,
            "__part": F.floor(F.col("frame_index") / PART),
        }
    )
    return numbered(staged(c), by, ["__place", "__part"], [F.col("frame_index")], "candidate_id").drop("__place", "__part")


def global_candidates(env: DataFrame, by: list[str], p: Profile, rate: float, hop: int = 256, minimum: float = 0.20) -> DataFrame:
    """Onsets of the full band, each of the class with the largest of five scores (of equal ones the first of DETECTORS).

    Confidence is the best score less 0.35 of the second, which names the competing class. Columns as in detector_candidates.
    """
    full = env.where(F.col("band") == "full")
    found = detect_onsets(full, [*by, "band"], p.picking(minimum), rate, hop).withColumn("detector", F.lit("global"))
    c = _bands(described(found, env, by))
    low, mid, high, s = F.col("low"), F.col("mid"), F.col("high"), F.col("strength")
    scores = {
        "kick": 0.55 * low + 0.25 * s + 0.20 * low / (mid + _EPS),
        "snare_or_clap": 0.45 * mid + 0.28 * s + 0.27 * F.least(F.lit(1.0), mid + 0.6 * high),
        "hat": 0.46 * high + 0.24 * s + 0.30 * F.least(F.lit(1.0), high / (mid + _EPS)),
        "cymbal": 0.38 * high + 0.20 * s + 0.42 * F.least(F.lit(1.0), high + 0.35 * mid),
        "tom_or_perc": 0.42 * mid + 0.30 * low + 0.28 * s,
    }
    ranked = F.array_sort(F.array(*[F.struct((-_within(v, 1.25)).alias("less"), F.lit(i).alias("place"), F.lit(k).alias("name")) for i, (k, v) in enumerate(scores.items())]))
    c = c.withColumn("__r", ranked)
    best, second = -F.col("__r")[0]["less"], -F.col("__r")[1]["less"]
    c = c.withColumns(
        {
            "class_name": F.col("__r")[0]["name"],
            "dominance": F.greatest(low, mid, high) / (low + mid + high + _EPS),
            "confidence": _within(best - 0.35 * second, 0.98),
            "rival": F.col("__r")[1]["name"],
            "rival_score": _within(second),
            "__part": F.floor(F.col("frame_index") / PART),
        }
    ).drop("__r")
    return numbered(staged(c), by, ["__part"], [F.col("frame_index")], "candidate_id").drop("__part")


def tempo(candidates: DataFrame, by: list[str], default: float = 120.0) -> DataFrame:
    """(by, bpm): 60 over the median interval of 0.06 to 1.5 s between neighbouring candidates, folded into 70 to 190; default without such intervals."""
    gap = F.col("onset_sec") - F.lag("onset_sec").over(Window.partitionBy(*by).orderBy("onset_sec"))
    g = candidates.select(*by, "onset_sec", gap.alias("gap")).groupBy(*by).agg(F.median(F.when(F.col("gap").between(0.06, 1.5), F.col("gap"))).alias("gap"))
    return g.select(*by, F.coalesce(D.bpm(F.col("gap")), F.lit(default)).alias("bpm"))


def to_hits(candidates: DataFrame, by: list[str], p: Profile, ticks_per_beat: int = 480, bpm: float | None = None) -> DataFrame:
    """Every candidate as a hit, with hit_id, tick, score and reason (null: accepted).

    hit_id counts a signal's hits by time, then falling confidence, then candidate_id. Hits of little confidence and toms
    that a kick or snare rivals go first; then, by class, all but the best of a transient, those too near to a better one
    and those within the class's refractory time. Ticks follow bpm, or the signal's own tempo.
    """
    c = candidates.withColumn("__part", F.floor(F.col("frame_index") / PART))
    c = numbered(c, by, ["__part"], [F.col("frame_index"), F.col("confidence").desc(), F.col("candidate_id")], "hit_id").drop("__part")
    pace = candidates.select(*by).distinct().withColumn("bpm", F.lit(float(bpm))) if bpm else tempo(candidates, by)
    c = c.join(pace, by).withColumn("tick", F.greatest(F.lit(0), F.rint(F.col("onset_sec") * F.col("bpm") * (ticks_per_beat / 60))).cast("long"))
    tom = (F.col("class_name") == "tom_or_perc") & F.col("rival").isin("kick", "snare_or_clap") & (F.col("rival_score") >= F.col("confidence") * 0.92)
    early = F.when(F.col("confidence") < p.min_class_confidence, "low_confidence").when(tom, "tom_not_clear")
    c = staged(c.withColumns({"score": D.score(F.col("strength"), F.col("confidence"), F.col("attack"), F.col("dominance")), "early": early}))

    key = [*by, "class_name"]
    slim = c.where(F.col("early").isNull()).select(*key, "hit_id", "onset_sec", "score")
    best = staged(D.group_winners(slim, key, p.same_transient_window_ms / 1000))
    alive = best.where("not suppressed").select(*slim.columns)
    spaced = staged(D.keep_spaced(alive, key, "onset_sec", "score", F.lit(p.min_hit_spacing_ms / 1000), "hit_id"))
    kept = D.keep_spaced(spaced, key, "onset_sec", "score", p.refractory_sec(F.col("class_name")), "hit_id")
    steps = best.select(*by, "hit_id", (~F.col("suppressed")).cast("int").alias("passed"))
    for df in (spaced, kept):
        steps = steps.unionByName(df.select(*by, "hit_id", F.lit(1).alias("passed")))
    passed = steps.groupBy(*by, "hit_id").agg(F.sum("passed").alias("passed"))
    late = F.when(F.col("passed") == 0, "same_transient_group").when(F.col("passed") == 1, "global_min_spacing").when(F.col("passed") == 2, "class_refractory")
    return c.join(passed, [*by, "hit_id"], "left").withColumn("reason", F.coalesce("early", late)).drop("early", "passed")


def counters(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, detector, candidates, accepted, rejected) of to_hits."""
    lost = F.col("reason").isNotNull()
    return hits.groupBy(*by, "detector").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(~lost).alias("accepted"), F.count_if(lost).alias("rejected"))
