"""Mixing sources to target token counts by entropy balancing (operator 5): built-in functions only.

Document rates minimise their relative entropy to one, under a token total for each source. The solution is an
exponential tilt in the document's tokens, rate = exp(lambda * tokens / scale), cut at max_copies; lambda is the
source's dual variable. The dual is convex and falls apart by source, so a Newton round is one aggregation over
(source, size) cells, and the duals stay in a table: no source count limits it. Rates then become whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_ROWS, Scratch


#: Units of one source that are put in order at once when a queue is cut.
EDGE = 20_000
#: Sources whose duals may be broadcast, at about 100 bytes each; beyond it the same join shuffles.
SOURCES = 100_000
_PLACES = 1 << 52


def words(text: Column) -> Column:
    """Number of runs without ASCII white space (null: 0): every run becomes one letter, and no array of words is built."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.length(F.regexp_replace(bare, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """(source, total, target) from (source, total).

    Sources in code point order, null last, take the weights in turn. The sum of totals is shared by weight; a target
    stops at cap times its total, and the excess goes to the others by weight until none is above. That fixed point
    is one level: target = min(cap * total, weight * level), so sources are sorted by the level that fills them.
    The windows run over one row for each source.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = Window.orderBy("fills", F.col("source").asc_nulls_last())
    t = sources.withColumn("weight", w).withColumn("full", F.col("total") * cap).withColumn("fills", F.col("full") / F.col("weight"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filled.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("all", F.sum("total").over(Window.partitionBy()))
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # The level is that of the first source which it does not fill; with cap >= 1 there is one.
    t = t.withColumn("at", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "source", "level"))).over(Window.partitionBy()))
    level = F.coalesce(F.col("at.level"), F.col("level"))
    return t.select("source", "total", F.least(F.col("full"), F.col("weight") * level).alias("target"))


def duals(cells: DataFrame, goal: DataFrame, cap: float, scratch: Scratch, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(source, total, target, scale, dual) that solve sum(size * rate) = target in every source.

    cells: (source, size, n). Newton steps on the log of the mixed total, kept inside a bracket that shrinks. A
    source that is filled to cap, or has no words, needs no dual: it is null.
    """
    scale = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    scale = scale.withColumnRenamed("source", "s")
    state = goal.join(scale, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    done = (F.col("total") == 0) | (F.col("target") >= F.col("total") * cap * (1 - 1e-12))
    state = scratch.write(state.select("*", F.when(~done, F.lit(0.0)).alias("dual"), F.lit(-1e3).alias("lo"), F.lit(1e3).alias("hi"), F.lit(False).alias("met")), "duals")
    for _ in range(rounds):
        open_ = state.where("dual is not null and not met").select(F.col("source").alias("s"), "dual", "scale")
        x = F.col("size") / F.col("scale")
        rate = F.least(F.exp(F.least(F.col("dual") * x, F.lit(50.0))), F.lit(cap))
        got = cells.join(open_, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"),
        )
        now = state.join(got, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.log(F.col("target")) - F.log(F.col("got"))
        lo, hi = F.when(gap > 0, F.col("dual")).otherwise(F.col("lo")), F.when(gap < 0, F.col("dual")).otherwise(F.col("hi"))
        newton = F.col("dual") + gap * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        # Without a step inside the bracket: double while one side is still unbounded, else halve.
        away = F.when((F.col("hi") >= 1e3) & (gap > 0), F.greatest(F.col("lo") * 2, F.lit(1.0))).when((F.col("lo") <= -1e3) & (gap < 0), F.least(F.col("hi") * 2, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        met = F.coalesce(F.abs(gap) < tolerance, F.lit(True))
        now = now.withColumns({"lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi")})
        now = now.withColumns({"met": met, "dual": F.when(met, F.col("dual")).otherwise(F.when(inside, newton).otherwise(away))}).drop("got", "slope")
        nxt = scratch.write(now.select("source", "total", "target", "scale", "dual", "lo", "hi", "met"), "duals")
        scratch.drop(state)
        state = nxt
        if not state.where("not met").limit(1).count():
            break
    return state.select("source", "total", "target", "scale", "dual")


def _cut(units: DataFrame, rest: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, last, left): units of a source up to queue place `last` fit into its rest; left is what they do not use.

    units: (source, key, at, mass), rest: (source, rest). The place is found by histogram, 12 bits of the queue a
    round, each round only inside the bin that the last one could not take whole; below EDGE units, in order.
    """
    u = units.select("source", "key", "mass", "at")
    edge = scratch.write(rest.select(F.col("source").alias("es"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("had"), "rest", F.lit(False).alias("fits")), "edge")
    for bits in (40, 28, 16, 4):
        inside = u.join(edge.where("not fits"), F.col("source").eqNullSafe(F.col("es"))).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.lit(1 << (bits + 12))))
        hist = inside.groupBy("source", F.shiftright("at", bits).alias("bin")).agg(F.sum("mass").alias("m"), F.first("rest").alias("rest"), F.first("had").alias("had"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("m").over(Window.partitionBy("source").orderBy("bin")) + F.col("had")
        hist = hist.withColumn("upto", upto)
        taken = F.col("upto") <= F.col("rest")
        nxt = hist.groupBy("source").agg(F.max(F.when(taken, F.col("upto"))).alias("now"), F.min(F.when(~taken, F.struct("bin", "n"))).alias("next")).withColumnRenamed("source", "ns")
        moved = edge.join(nxt, F.col("es").eqNullSafe(F.col("ns")), "left").select(
            "es", F.coalesce(F.shiftleft("next.bin", bits), "lo").alias("lo"), F.greatest("had", F.coalesce("now", "had")).alias("had"), "rest",
            (F.col("fits") | F.col("next").isNull()).alias("fits"), F.coalesce("next.n", F.lit(0)).alias("n"),
        )
        moved = scratch.write(moved, "edge")
        scratch.drop(edge)
        edge = moved
        if not edge.where((F.col("n") > EDGE) & ~F.col("fits")).limit(1).count():
            break
        edge = edge.drop("n")
    edge = edge.drop("n")
    inside = u.join(edge.where("not fits"), F.col("source").eqNullSafe(F.col("es"))).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.lit(1 << bits)))
    order = Window.partitionBy("source").orderBy("at", "key")
    inside = inside.withColumn("upto", F.sum("mass").over(order) + F.col("had")).where("upto <= rest")
    last = inside.groupBy(F.col("source").alias("ls")).agg(F.max(F.struct("at", "key")).alias("last"), F.max("upto").alias("got"))
    none = F.struct((F.col("lo") - 1).alias("at"), F.lit(2**63 - 1).alias("key"))
    every = F.struct(F.lit(1 << 53).alias("at"), F.lit(2**63 - 1).alias("key"))
    return edge.join(last, F.col("es").eqNullSafe(F.col("ls")), "left").select(F.col("es").alias("source"), F.when(F.col("fits"), every).otherwise(F.coalesce("last", none)).alias("last"), (F.col("rest") - F.coalesce("got", "had")).alias("left"))


def _fill(units: DataFrame, limit: DataFrame) -> DataFrame:
    """(source, key) of waiting units that fill what _cut left: the largest mass that still fits goes first, as often as it fits.

    The fold runs over the distinct masses of a source's waiting units, none above twice what is left (less than one document).
    """
    lim = limit.select(F.col("source").alias("ls"), "last", "left").where("left > 0")
    waiting = units.join(lim, F.col("source").eqNullSafe(F.col("ls"))).where((F.struct("at", "key") > F.col("last")) & (F.col("mass") < 2 * F.col("left"))).select("source", "key", "at", "mass", "left")
    cells = waiting.groupBy("source", "mass").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    runs = cells.groupBy("source").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("mass", "n")), asc=False).alias("c"))
    nothing = F.struct(F.col("left").alias("left"), F.expr("cast(array() as array<struct<mass:bigint,k:bigint>>)").alias("got"))

    def step(state: Column, c: Column) -> Column:
        k = F.least(c["n"], F.floor(state["left"] / c["mass"]))
        more = F.concat(state["got"], F.array(F.struct(c["mass"].alias("mass"), k.alias("k"))))
        return F.when(k > 0, F.struct((state["left"] - k * c["mass"]).alias("left"), more.alias("got"))).otherwise(state)

    # At last the smallest document that overshoots, where that comes nearer.
    s = runs.select("source", "c", F.aggregate("c", nothing, step).alias("s"))
    used = lambda c: F.exists("s.got", lambda g: (g["mass"] == c["mass"]) & (g["k"] == c["n"]))
    over = F.array_min(F.transform(F.filter("c", lambda c: (c["mass"] < 2 * F.col("s.left")) & ~used(c)), lambda c: c["mass"]))
    s = s.withColumn("over", over)
    again = F.coalesce(F.aggregate(F.filter("s.got", lambda g: g["mass"] == F.col("over")), F.lit(0).cast("long"), lambda a, g: g["k"]), F.lit(0)) + 1
    got = F.when(F.col("over").isNull(), F.col("s.got")).otherwise(F.concat(F.col("s.got"), F.array(F.struct(F.col("over").alias("mass"), again.cast("long").alias("k")))))
    picks = s.select("source", F.explode(got).alias("p")).groupBy(F.col("source").alias("ps"), F.col("p.mass").alias("pm")).agg(F.max("p.k").alias("k"))
    order = F.row_number().over(Window.partitionBy("source", "mass").orderBy("at", "key"))
    chosen = waiting.join(picks, F.col("source").eqNullSafe(F.col("ps")) & (F.col("mass") == F.col("pm")))
    return chosen.withColumn("r", order).where("r <= k").select("source", "key")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cap: int = 3, prefix: str = "") -> DataFrame:
    """docs with size, source_size, target and copies, each name behind prefix (own columns of these names are replaced).

    Targets are those of targets(weights, cap). A copy count is 0 to cap. Whole parts of the rate are copies for sure;
    the rest goes to the documents that come first by hash(id, text) over their fractional part, so reruns agree and
    expected copies follow the rates. What the queue leaves of a target is filled with waiting documents, the largest
    that fit first, so a source misses its target by at most half of its smallest waiting unit. Null texts have size 0
    and one copy; rows that repeat a source, id and text are one unit: all of them get a copy more or none does. Null
    is a source of its own. An empty table stays empty.
    """
    sc = Scratch(docs.sparkSession, "mix")
    base = docs.drop(*[prefix + c for c in ("size", "source_size", "target", "copies")])
    # Names that no column of docs has.
    x = "_mix"
    while any(c.lower().startswith(x) for c in docs.columns):
        x += "_"
    own = {f"{x}_source": F.col(f"`{source_col}`").cast("string"), f"{x}_size": words(F.col(f"`{text_col}`").cast("string")), f"{x}_key": F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))}
    rows = base.withColumns(own)
    slim = rows.select(F.col(f"{x}_source").alias("source"), F.col(f"{x}_size").alias("size"), F.col(f"{x}_key").alias("key"))
    slim = sc.write(slim.groupBy("source", "size", "key").agg(F.count(F.lit(1)).alias("rows")), "slim")
    cells = sc.write(slim.groupBy("source", "size").agg(F.sum("rows").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("total"))
    solved = sc.write(duals(cells, sc.write(targets(totals, weights, float(cap)), "goal"), float(cap), sc), "solved")

    def rate(size: Column, dual: Column, scale: Column) -> Column:
        tilt = F.exp(F.least(dual * size / scale, F.lit(50.0)))
        return F.when(size == 0, F.lit(1.0)).otherwise(F.coalesce(F.least(tilt, F.lit(float(cap))), F.lit(float(cap))))

    def queued(r: Column, key: Column) -> Column:
        """Place from 0 to _PLACES - 1 in the queue for one copy more; null for a whole rate."""
        part = r - F.floor(r)
        u = (F.shiftrightunsigned(key, 11) + 1) / F.lit(float(1 << 53))
        return F.when(part > 0, F.least(F.floor(u / (u + part) * F.lit(float(_PLACES))).cast("long"), F.lit(_PLACES - 1)))

    d = solved.withColumnRenamed("source", "ds")
    rated = slim.join(d, F.col("source").eqNullSafe(F.col("ds"))).withColumn("rate", rate(F.col("size"), F.col("dual"), F.col("scale")))
    rated = sc.write(rated.select("source", "key", (F.col("size") * F.col("rows")).alias("mass"), F.floor("rate").cast("int").alias("whole"), queued(F.col("rate"), F.col("key")).alias("at"), "target"), "rated")
    rest = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("mass") * F.col("whole"))).alias("rest"))
    units = rated.where("at is not null").select("source", "key", "at", "mass")
    limit = sc.write(_cut(units, rest, sc), "limit")
    picked = sc.write(_fill(units, limit).withColumn("more", F.lit(1)), "picked")
    sc.drop(slim, cells, rated)

    facts = solved.join(limit.select(F.col("source").alias("ls"), "last"), F.col("source").eqNullSafe(F.col("ls")))
    facts = facts.select(F.struct(F.col("source"), F.col("total").alias("total"), "target", "scale", "dual", "last").alias(f"{x}_s"))
    facts = F.broadcast(facts) if limit.limit(SOURCES + 1).count() <= SOURCES else facts
    done = rows.join(facts, F.col(f"{x}_source").eqNullSafe(F.col(f"{x}_s.source")))
    few = picked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    p = picked.select(F.struct("source", "key", "more").alias(f"{x}_p"))
    done = done.join(F.broadcast(p) if few else p, F.col(f"{x}_source").eqNullSafe(F.col(f"{x}_p.source")) & (F.col(f"{x}_key") == F.col(f"{x}_p.key")), "left")
    size, key = F.col(f"{x}_size"), F.col(f"{x}_key")
    done = done.withColumn(f"{x}_r", rate(size, F.col(f"{x}_s.dual"), F.col(f"{x}_s.scale")))
    done = done.withColumn(f"{x}_at", queued(F.col(f"{x}_r"), key))
    early = F.struct(F.col(f"{x}_at").alias("at"), key.alias("key")) <= F.col(f"{x}_s.last")
    copies = F.floor(f"{x}_r").cast("int") + F.when(F.col(f"{x}_at").isNotNull() & (early | F.col(f"{x}_p.more").isNotNull()), 1).otherwise(0)
    return done.select(*[F.col(f"`{c}`") for c in base.columns], size.alias(f"{prefix}size"), F.col(f"{x}_s.total").alias(f"{prefix}source_size"), F.col(f"{x}_s.target").alias(f"{prefix}target"), copies.cast("int").alias(f"{prefix}copies"))
