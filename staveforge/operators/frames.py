"""Per-frame features and their roll-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def frame_signal(pcm: DataFrame, size: int, hop: int, keys: list[str]) -> DataFrame:
    """(keys, frame_index, samples) of a column signal array<double>: zero-padded tail, the last frame is the first to reach the end; an empty signal is one zero frame."""
    n = F.size("signal")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / hop).cast("int") + 1)
    f = pcm.select(*keys, "signal", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame_index"))
    part = F.slice("signal", F.col("frame_index") * hop + 1, F.lit(size))
    return f.select(*keys, "frame_index", F.concat(part, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(part))).alias("samples"))


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def zero_crossings(x: Column) -> Column:
    """Share of neighbours with different sign bits."""
    turns = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: ((a < 0) != (b < 0)).cast("int"))
    return F.when(F.size(x) < 2, 0.0).otherwise(F.aggregate(turns, F.lit(0), lambda a, v: a + v) / (F.size(x) - 1))


def magnitudes(x: Column, n: int) -> Column:
    """|DFT| of n Hann-windowed samples for bins 0..n/2, as a plain sum with fixed coefficients."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    y = F.zip_with(x, F.array(*[F.lit(h) for h in hann]), lambda a, b: a * b)

    def part(k: Column, trig) -> Column:
        at = F.transform(y, lambda v, i: v * trig(i * k * (2 * math.pi / n)))
        return F.aggregate(at, F.lit(0.0), lambda a, v: a + v)

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.sqrt(F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2)))


def smooth(df: DataFrame, col: str, by: list[str], order: str, width: int, out: str) -> DataFrame:
    """Centred moving average with zeros outside; edges are divided by the full width."""
    h = width // 2
    return df.withColumn(out, F.sum(col).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-h, h)) / width)


def delta(df: DataFrame, col: str, by: list[str], order: str, out: str) -> DataFrame:
    """Difference to the row before, 0 for the first."""
    return df.withColumn(out, F.col(col) - F.coalesce(F.lag(col).over(Window.partitionBy(*by).orderBy(order)), F.col(col)))


def normalise_envelope(df: DataFrame, col: str, by: list[str], out: str) -> DataFrame:
    """Minus p5, over p95 of what is left, clipped to 0..2.5. Two joins with one row a key."""
    p5 = df.groupBy(*by).agg(F.percentile(col, 0.05).alias("__p5"))
    s = df.join(p5, by).withColumn("__x", F.greatest(F.col(col) - F.col("__p5"), F.lit(0.0)))
    p95 = s.groupBy(*by).agg(F.percentile("__x", 0.95).alias("__p95"))
    return s.join(p95, by).withColumn(out, F.when(F.col("__p95") <= 1e-9, 0.0).otherwise(F.least(F.lit(2.5), F.col("__x") / F.col("__p95")))).drop("__p5", "__p95", "__x")


def _between(low, high, part):
    """low * (1 - part) + high * part, with the sum rounded once, as SQL engines that fuse multiply and add do."""
    return math.fma(low, 1 - part, high * part)


def quantile(df: DataFrame, by: list[str], value: Column, at: float, out: str) -> DataFrame:
    """(by, out): the value at `at` of all non-null values, between its two neighbours in order; one row a key.

    F.percentile rounds both products, which is off by one last place where the neighbours are almost equal, so that
    rows that equal the percentile fall on its other side.
    """
    v = df.select(*by, value.alias("__v")).where("__v is not null")
    w = Window.partitionBy(*by)
    pos = (F.count("__v").over(w) - 1) * F.lit(at)
    r = v.select(*by, "__v", F.row_number().over(w.orderBy("__v")).alias("__r"), pos.alias("__p")).where("__r - 1 = floor(__p) or __r - 1 = ceil(__p)")
    e = r.groupBy(*by).agg(F.min("__v").alias("__l"), F.max("__v").alias("__h"), F.max(F.col("__p") - F.floor("__p")).alias("__f"))
    return e.select(*by, F.when(F.col("__f") > 0, F.udf(_between, "double")("__l", "__h", "__f")).otherwise(F.col("__l")).alias(out))


def classify(df: DataFrame, by: list[str]) -> DataFrame:
    """P10: frame_class from percentiles of a whole recording; silence before attack before tail before sustain.

    df: by, rms_smooth, envelope_delta, onset_strength.
    """
    delta_ = F.col("envelope_delta")
    q = df.select(*by).distinct()
    for name, col, at in (("__s", F.when(F.col("rms_smooth") > 0, F.col("rms_smooth")), 0.2), ("__o", F.col("onset_strength"), 0.75), ("__a", F.when(delta_ > 0, delta_), 0.6), ("__t", F.when(delta_ < 0, delta_), 0.4)):
        q = q.join(quantile(df, by, col, at, name), by, "left")
    silence, onset = F.greatest(F.lit(1e-5), 0.35 * F.coalesce("__s", F.lit(0.0))), F.greatest(F.lit(1e-7), 0.6 * F.coalesce("__o", F.lit(0.0)))
    kind = F.when(F.col("rms_smooth") <= silence, "silence").when((F.col("onset_strength") >= onset) & (F.col("envelope_delta") >= F.coalesce("__a", F.lit(0.0))), "attack").when(F.col("envelope_delta") <= F.coalesce("__t", F.lit(0.0)), "tail").otherwise("sustain")
    return df.join(q, by).withColumn("frame_class", kind).drop("__s", "__o", "__a", "__t")
