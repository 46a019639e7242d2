"""Sharding by histogram sort (operator 2): built-in functions only.

The sort key of a row is (hash of its text, hash of its id): 128 bits, so copies of a text lie side by side and a
huge group of copies can still be cut between its ids. Splitters are found without a sort: each round counts exact
bytes below 2**STEP candidate boundaries inside the few key intervals that hold an open target, until every target
is met within the tolerance. Then one exchange places the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch

#: Bits of the key that one probing round resolves: 2**STEP counters for each open interval reach the driver.
STEP = 9
#: Key bits of a bin in which slots are numbered: 2**BIN_BITS bins at most, whatever the input.
BIN_BITS = 13
_KEY_BITS = 128


def _bits(hi: Column, lo: Column, start: int, n: int) -> Column:
    """Bits start..start+n of the 128-bit key, most significant first (n <= 62), as a long."""

    def part(x: Column, at: int, k: int) -> Column:
        return F.shiftrightunsigned(x, 64 - at - k).bitwiseAND(F.lit((1 << k) - 1))

    if start + n <= 64:
        return part(hi, start, n)
    if start >= 64:
        return part(lo, start - 64, n)
    return F.shiftleft(part(hi, start, 64 - start), start + n - 64) + part(lo, 0, start + n - 64)


def _is(hi: Column, lo: Column, prefix: int, bits: int) -> Column:
    """The key starts with these bits."""
    out, at = F.lit(True), 0
    while at < bits:
        k = min(62, bits - at)
        out = out & (_bits(hi, lo, at, k) == F.lit((prefix >> (bits - at - k)) & ((1 << k) - 1)))
        at += k
    return out


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[int]:
    """parts - 1 boundaries over (hi, lo, size): boundary i has i / parts of all bytes below it, within tolerance of a part.

    Boundaries are 128-bit numbers; rows below them come first. Rows that share a key stay together.
    """
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    targets = [total * i / parts for i in range(1, parts)]
    slack = tolerance * total / parts
    open_: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0, list(range(len(targets))))}  # (prefix, bits): bytes below it, targets inside
    found = [0] * len(targets)
    hi, lo = F.col("hi"), F.col("lo")
    while open_:
        tags = list(open_)
        which = F.lit(None).cast("int")
        for i, (prefix, bits) in enumerate(tags):
            which = F.coalesce(F.when(_is(hi, lo, prefix, bits), F.lit(i)), which)
        bits = tags[0][1]
        step = min(STEP, _KEY_BITS - bits)
        counts: dict[int, dict[int, int]] = {i: {} for i in range(len(tags))}
        seen = keys.select(which.alias("i"), _bits(hi, lo, bits, step).alias("b"), "size").where("i is not null")
        for r in seen.groupBy("i", "b").agg(F.sum("size").alias("n")).collect():  # at most parts * 2**STEP rows
            counts[r["i"]][r["b"]] = r["n"]
        nxt: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for i, (prefix, _) in enumerate(tags):
            below, mine = open_[prefix, bits]
            for t in mine:
                at, b = below, 0
                for b in sorted(counts[i]):
                    if at + counts[i][b] > targets[t]:
                        break
                    at += counts[i][b]
                else:
                    found[t] = (prefix + 1) << (_KEY_BITS - bits)
                    continue
                left, right = targets[t] - at, at + counts[i][b] - targets[t]
                key = (prefix << step) + b
                if min(left, right) <= slack or bits + step == _KEY_BITS:
                    found[t] = (key + (right < left)) << (_KEY_BITS - bits - step)
                else:
                    nxt.setdefault((key, bits + step), (at, []))[1].append(t)
        open_ = nxt
    return sorted(found)


def _below(hi: Column, lo: Column, bound: int) -> Column:
    """The key is below bound, as unsigned numbers."""
    if bound >= 1 << _KEY_BITS:
        return F.lit(True)
    flip = F.lit(-(1 << 63))

    def signed(x: int) -> Column:
        return F.lit(x - (1 << 63))

    h, low = hi.bitwiseXOR(flip), lo.bitwiseXOR(flip)
    top, rest = signed(bound >> 64), signed(bound & ((1 << 64) - 1))
    return (h < top) | ((h == top) & (low < rest))


def shard(docs: DataFrame, parts: int = 8, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text", target_rows: int = 200_000) -> DataFrame:
    """docs with size, shard and slot (own columns of these names are replaced).

    size is the UTF-8 bytes of the text (null: none) plus 1. Shards 0 to parts - 1 hold near equal sums of size: a
    splitter is off by tolerance of a part, or by one row, at most. Copies of a text lie side by side and meet in one
    shard unless a splitter has to cut their group. slot numbers the rows of a shard from 0 without gaps. Rows with
    equal id and text get neighbouring slots; a null id is a key like any other. An empty table stays empty.
    """
    sc = Scratch(docs.sparkSession, "shards")
    hi = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(text_col).isNull())
    lo = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull())
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    base = docs.drop("size", "shard", "slot")
    # A row goes through as one struct, so its own columns may have any names.
    packed = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    rows = docs.select(packed.alias("__row"), F.col(id_col).alias("__id"), size.alias("size"), hi.alias("__hi"), lo.alias("__lo"))
    keys = sc.write(rows.select(F.col("__hi").alias("hi"), F.col("__lo").alias("lo"), "size"), "keys")
    cuts = splitters(keys, parts, tolerance)

    def place(a: Column, b: Column) -> Column:
        out = F.lit(parts - 1)
        for i in reversed(range(parts - 1)):
            out = F.when(_below(a, b, cuts[i]), F.lit(i)).otherwise(out)
        return out

    # Slots: bins of the key in order; a bin that copies make too large is cut further by the id's hash.
    n = keys.count()
    target = max(16, min(target_rows, n // (1 << (BIN_BITS - 3)) + 1))
    kh, kl = F.col("hi"), F.col("lo")
    bins = keys.select(place(kh, kl).alias("shard"), _bits(kh, kl, 0, BIN_BITS).alias("bin")).groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    hot = sc.write(bins.where(F.col("n") > 4 * target).select("shard", "bin", F.ceil(F.col("n") / target).cast("int").alias("cuts")), "hot")
    small = F.broadcast(hot)  # at most parts * 2**BIN_BITS rows

    def cut(df: DataFrame, low: str) -> DataFrame:
        return df.join(small, ["shard", "bin"], "left").withColumn("__cut", F.floor(F.shiftrightunsigned(F.col(low), 33) * F.coalesce("cuts", F.lit(1)) / F.lit(float(1 << 31))).cast("int")).drop("cuts")

    counted = cut(keys.select(place(kh, kl).alias("shard"), _bits(kh, kl, 0, BIN_BITS).alias("bin"), "lo"), "lo").groupBy("shard", "bin", "__cut").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("bin", "__cut")
    starts = sc.write(counted.withColumn("__start", F.sum("n").over(order) - F.col("n")).drop("n"), "starts")
    bins_n = starts.limit((1 << BIN_BITS) * parts * 4 + 1).count()
    rows = rows.withColumns({"shard": place(F.col("__hi"), F.col("__lo")), "bin": _bits(F.col("__hi"), F.col("__lo"), 0, BIN_BITS)})
    rows = cut(rows, "__lo").join(F.broadcast(starts) if bins_n <= (1 << BIN_BITS) * parts * 4 else starts, ["shard", "bin", "__cut"])
    place_in = Window.partitionBy("shard", "bin", "__cut").orderBy("__hi", "__lo", "__id")
    out = rows.withColumn("slot", F.col("__start") + F.row_number().over(place_in) - 1)
    return out.select("__row.*", "size", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
