"""Time joins that Catalyst has no operator for: interval overlap, band, as-of and nearest.

Each turns the time predicate into an equi-join on (keys, time bucket), so a plan is a sort-merge or hash join that
partitions by time as well as by key: a long recording does not land in one task. Matches are those of the plain
predicate; buckets only decide where rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _span(a: Column, b: Column, width: float) -> Column:
    return F.sequence(F.floor(a / width), F.greatest(F.floor(a / width), F.floor(b / width)))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], width: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """Pairs with r.end > l.start and r.start < l.end (closed: >= and <=); both sides have start_sec and end_sec.

    Right columns come out with the prefix r_. A pair that shares several buckets is kept in the first of them. width
    should be near the longest interval; any positive width is right. how is inner or left.
    """
    keys = [f"r_{c}" for c in by]
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    lb = left.withColumn("__b", F.explode(_span(F.col("start_sec"), F.col("end_sec"), width)))
    rb = r.withColumn("__rb", F.explode(_span(F.col("r_start_sec"), F.col("r_end_sec"), width)))
    over = (F.col("r_end_sec") >= F.col("start_sec")) & (F.col("r_start_sec") <= F.col("end_sec")) if closed else (F.col("r_end_sec") > F.col("start_sec")) & (F.col("r_start_sec") < F.col("end_sec"))
    first = F.col("__b") == F.greatest(F.floor(F.col("start_sec") / width), F.floor(F.col("r_start_sec") / width))
    on = [F.col(a) == F.col(b) for a, b in zip(by, keys, strict=True)] + [F.col("__b") == F.col("__rb"), over, first]
    found = lb.join(rb, on).drop("__b", "__rb", *keys)
    if how == "inner":
        return found
    cols = left.columns
    return left.join(found.drop(*[c for c in cols if c not in (*by, "note_id")]), [*by, "note_id"], "left")


def band_join(left: DataFrame, right: DataFrame, by: list[str], at: str, r_at: str, width: float) -> DataFrame:
    """Pairs with abs(right.r_at - left.at) <= width; right columns get the prefix r_. The right side meets three buckets."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    lb = left.withColumn("__b", F.floor(F.col(at) / width))
    rb = r.withColumn("__rb", F.explode(F.array(*[F.floor(F.col(f"r_{r_at}") / width) + d for d in (-1, 0, 1)])))
    on = [F.col(c) == F.col(f"r_{c}") for c in by] + [F.col("__b") == F.col("__rb"), F.abs(F.col(f"r_{r_at}") - F.col(at)) <= width]
    return lb.join(rb, on).drop("__b", "__rb", *[f"r_{c}" for c in by])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """left with right's values at the last right row whose at is <= left's (forward: the first >=), null if there is none.

    One union and one window; both sides have the column at. strict leaves out equal times. Right rows with equal times
    should be unique by (by, at).
    """
    side = 0 if not strict else 2
    l_rows = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    r_rows = right.select(*by, at, F.lit(side if not forward else 2 - side).alias("__side"), F.struct(*values).alias("__v"))
    u = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = [F.col(at).asc(), F.col("__side").asc()] if not forward else [F.col(at).desc(), F.col("__side").desc()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """left with right's values at the nearest right time; the earlier of two that are equally near. Adds near_<at>."""
    r = right.withColumn(f"near_{at}", F.col(at)).select(*by, at, f"near_{at}", *values)
    names = [f"near_{at}", *values]
    b = asof_join(left, r, by, at, names).withColumnsRenamed({n: f"__b_{n}" for n in names})
    f = asof_join(b, r, by, at, names, forward=True).withColumnsRenamed({n: f"__f_{n}" for n in names})
    db, df = F.col(at) - F.col(f"__b_near_{at}"), F.col(f"__f_near_{at}") - F.col(at)
    back = df.isNull() | (db <= df)
    return f.select(*left.columns, *[F.when(back, F.col(f"__b_{n}")).otherwise(F.col(f"__f_{n}")).alias(n) for n in names])


def preceding(df: DataFrame, by: list[str], at: str, order: list[str], value: Column, out: str, width: float = 60.0) -> DataFrame:
    """df with out, value of the row before in order (which begins with at), null for a key's first row.

    Rows are ordered inside buckets of width; only the last rows of buckets are ordered by key, so a long recording is
    spread over tasks.
    """
    b = df.withColumn("__b", F.floor(F.col(at) / width))
    ends = b.groupBy(*by, "__b").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    ends = ends.select(*by, "__b", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b")).alias("__carried"))
    own = F.lag(value).over(Window.partitionBy(*by, "__b").orderBy(*order))
    return b.join(ends, [*by, "__b"]).withColumn(out, F.coalesce(own, F.col("__carried"))).drop("__b", "__carried")
