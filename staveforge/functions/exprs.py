"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def round_half(x: Column, digits: int) -> Column:
    """x, of either sign, rounded as a double: half away from zero of x * 10**digits. F.round rounds the decimal form of x, which differs where that is a tie and the double is not."""
    m = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(m).cast("double")
    return F.signum(x) * (whole + F.when(m - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def energy_score(mean: Column, top: Column, minimum: float) -> Column:
    """P1."""
    if minimum <= 0:
        return F.lit(1.0)
    return 0.6 * F.least(F.lit(1.0), mean / minimum) + 0.4 * F.least(F.lit(1.0), top / (2 * minimum))


def onset_norm(onset: Column, minimum: float) -> Column:
    """P2."""
    if minimum <= 0:
        return F.when(onset > 0, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), onset / minimum)


def validation_action(confidence: Column, keep: float = 0.70, review: float = 0.45) -> Column:
    """P3."""
    return F.when(confidence >= keep, "KEEP").when(confidence >= review, "REVIEW").otherwise("MUTE_CANDIDATE")


def plan_action(confidence: Column, keep: float = 0.70, review: float = 0.45, delete: float = 0.20, allow_delete: bool = False) -> Column:
    """P5."""
    out = F.when(confidence >= keep, "KEEP").when(confidence >= review, "REVIEW")
    return (out.when(confidence < delete, "DELETE_CANDIDATE") if allow_delete else out).otherwise("MUTE")


# The texts of validation reasons.
NO_FRAMES, WEAK_ONSET, LOW_RMS, WEAK_SUSTAIN = "no overlapping audio frames", "weak or missing onset near note start", "low RMS during note", "short/weak sustained energy"
HIGH_MATCH, MIXED = "high confidence match", "mixed evidence for note-to-audio match"


def reasons(frames: Column, onset: Column, mean: Column, sustain: Column, confidence: Column, min_onset: float, min_rms: float, keep: float = 0.70) -> Column:
    """Conditional texts in a fixed order, or the default."""
    parts = [(frames == 0, NO_FRAMES), (onset < min_onset, WEAK_ONSET), (mean < min_rms, LOW_RMS), (sustain < 0.5, WEAK_SUSTAIN), (confidence >= keep, HIGH_MATCH)]
    found = F.filter(F.array(*[F.when(c, t) for c, t in parts]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(MIXED)))


def alignment_confidence(action: Column, onset: Column, rms: Column, sustain: Column, min_onset: float, min_rms: float) -> Column:
    """Onset, rms and sustain weigh by the action taken."""
    o = F.lit(1.0) if min_onset <= 0 else F.least(F.lit(1.0), onset / min_onset)
    r = F.lit(1.0) if min_rms <= 0 else F.least(F.lit(1.0), rms / min_rms)
    s = clip(sustain, 0.0, 1.0)
    weights = {"ALIGNED": (0.55, 0.30, 0.15), "REVIEW_TIMING": (0.30, 0.30, 0.20), "KEEP_ORIGINAL_LOW_CONFIDENCE": (0.20, 0.20, 0.20)}
    out = F.when(F.lit(False), 0.0)
    for name, (a, b, c) in weights.items():
        out = out.when(action == name, clip(a * o + b * r + c * s, 0.0, 1.0))
    return out.otherwise(0.0)


def safe_interval(start: Column, end: Column, duration: Column, sample_rate: int) -> tuple[Column, Column]:
    """Inside [0, duration] and at least one sample (or 0.1 ms) long."""
    least = max(1 / sample_rate if sample_rate > 0 else 1e-4, 1e-4)
    s = F.least(F.greatest(F.lit(0.0), start), F.greatest(F.lit(0.0), duration - least))
    e = F.greatest(end, s + least)
    return s, F.when(duration > 0, F.when(F.least(e, duration) > s, F.least(e, duration)).when(F.least(duration, s + least) > s, F.least(duration, s + least)).otherwise(s + least)).otherwise(e)


def side_errors(reference: Column, detected: Column) -> tuple[Column, Column]:
    """Milliseconds before and after, null where nothing was detected."""
    return F.when(detected.isNotNull(), F.greatest(F.lit(0.0), (reference - detected) * 1000)), F.when(detected.isNotNull(), F.greatest(F.lit(0.0), (detected - reference) * 1000))


def pitch_name(pitch: Column, middle: int = 1) -> Column:
    """C4 = 60 (middle 1); F3 with another middle octave."""
    return F.concat(F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / 12) - middle).cast("string"))


def pitch_of_name(name: Column, c1: int = 36) -> Column:
    """note name with optional # or b to pitch, octave 1 at c1; null if it is no name or outside 0..127."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True) for x in kv]), F.upper(F.regexp_extract(name, r"^([A-Ga-g])", 1)))
    mark = F.regexp_extract(name, r"^[A-Ga-g]([#b]?)", 1)
    octave = F.regexp_extract(name, r"^[A-Ga-g][#b]?(-?[0-9]+)$", 1).try_cast("int")
    pitch = base + F.when(mark == "#", 1).when(mark == "b", -1).otherwise(0) + (octave - 1) * 12 + c1
    return F.when((pitch >= 0) & (pitch <= 127), pitch)


def hz_to_midi(hz: Column) -> Column:
    """F5."""
    return 69 + 12 * F.log2(hz / 440)


def ticks(sec: Column, ticks_per_beat: int = 480, tempo: int = 500_000) -> Column:
    """Half to even, at least 0."""
    return F.greatest(F.lit(0), F.rint(sec * (ticks_per_beat * 1e6 / tempo)).cast("long"))


def file_token(text: Column) -> Column:
    """F9."""
    t = F.regexp_replace(text, r"[^A-Za-z0-9]", "")
    return F.when(t == "", "Layer").otherwise(t)


def track_name(text: Column) -> Column:
    """F10."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), "_+", "_"), "^_|_$", "")


def mm_ss(sec: Column) -> Column:
    """F12."""
    s = F.floor(F.greatest(sec, F.lit(0.0))).cast("int")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def snap(tick: Column, ticks_per_beat: int, division: int | None) -> Column:
    """Halves go up."""
    grid = max(1, int(4 * ticks_per_beat / division + 0.5)) if division else 1
    return (F.floor(tick / grid + 0.5) * grid).cast("long")


def match_score(score: Column) -> Column:
    """P23."""
    return F.when(score >= 0.85, "high").when(score >= 0.68, "medium").otherwise("low")


def prefix_length(observed: Column, full: Column, tolerance: float = 0.0) -> Column:
    """equal elements from the start."""
    same = F.zip_with(observed, full, lambda a, b: F.abs(a - b) <= tolerance)  # null past the shorter end
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size(observed), F.size(full))).cast("int")


def suffix_length(observed: Column, full: Column, tolerance: float = 0.0) -> Column:
    """F16."""
    return prefix_length(F.reverse(observed), F.reverse(full), tolerance)


def fragment_length(observed: Column, full: Column) -> Column:
    """the longest run of equal elements from the start of observed, over all shifts at which it fits into full."""
    last = F.size(full) - F.size(observed)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: prefix_length(observed, F.slice(full, i, F.size(observed))))
    return F.when((last < 0) | (F.size(observed) == 0), 0).otherwise(F.array_max(runs)).cast("int")


def alignment_start(observed: Column, full: Column) -> Column:
    """the shift with most equal elements, the first of the best; null if none is equal."""
    last = F.size(full) - F.size(observed)
    at = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.aggregate(F.zip_with(observed, F.slice(full, i + 1, F.size(observed)), lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0))).alias("n"), (-i).alias("at")))
    best = F.array_max(at)
    return F.when((last >= 0) & (best["n"] > 0), -best["at"]).cast("int")


# What must not reach an error report, and what stands in its place.
SECRETS = [
    (r"(?i)(incorrect api key provided:\s*)([^.]+)", "$1[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]+\b", "[REDACTED_API_KEY]"),
    (r"(?i)(api[-_ ]?key\s*[:=]\s*)['\"]?[A-Za-z0-9_-]{8,}['\"]?", "$1[REDACTED]"),
]


def redact(text: Column) -> Column:
    """F31."""
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def html_escape(text: Column) -> Column:
    """ampersand, angle brackets."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def csv_field(text: Column) -> Column:
    """a quoted field with its quotes doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def safe_file_name(text: Column) -> Column:
    """runs outside letters, digits, dot, underscore and hyphen become one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
