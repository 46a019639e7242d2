"""Near-duplicate documents by b-bit MinHash (operator 6).

1. Each text becomes a set of word shingles, 128 minima of it, four low bits of each minimum packed into eight
   longs, and band keys over groups of full minima. Texts with equal sets collapse to one representative.
2. Every band bucket links its members to its smallest member: bit counts of the packed signatures estimate the
   similarity, corrected for chance agreement of four bits, and pairs far below the threshold go. The rest are
   confirmed on full shingle sets.
3. Buckets whose members still lie in different components are searched again, in blocks of members: only pairs
   of different components count, the packed signatures drop what is far off, and full sets confirm. A block
   returns a spanning forest, so a group of thousands of near copies gives a row for each member, not each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, id_join
from .components import components

HASHES, BITS = 128, 4
_LONGS = HASHES * BITS // 64
#: Members of a bucket that meet at once in step 3.
BLOCK = 256
#: Standard deviations by which an estimate may lie below the threshold before a pair is dropped.
SLACK = 4.5

_rng = np.random.Generator(np.random.PCG64(20240607))
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_POS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(w: W.Words, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    h, n = w.hash, len(w.hash)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full += h[j : n - k + 1 + j] * _POS[j]
    full = W.mix(full)
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(full[lo : hi - k + 1])
        elif hi > lo:
            yield W.mix(np.array([(h[lo:hi] * _POS[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(out, (s[at : at + 512, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def _pack(m: np.ndarray) -> np.ndarray:
    low = (W.mix(m) & np.uint64((1 << BITS) - 1)).reshape(_LONGS, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS)), axis=1)


def row_key(ident: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes of id and text, with different seeds; they identify a row up to exact repeats, null ids included."""
    ident, text = ident.cast("long"), text.cast("string")
    return F.xxhash64(ident, text), F.xxhash64(F.lit(7), ident, text)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(doc, k1, k2, n, set_a, set_b, sig array<long>, band array<long>) for every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                n, a, b, sig, band = [], [], [], [], []
                for s in shingle_sets(W.scan(part, "text", W.SPACED), k):
                    n.append(len(s))
                    a.append(int(s.sum()) if len(s) else 0)
                    b.append(int(W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) if len(s) else 0)
                    if len(s):
                        m = minima(s)
                        sig.append(_pack(m).view(np.int64))
                        keys = m[: bands * rows].reshape(bands, rows)
                        band.append(W.mix((keys * _POS[:rows]).sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                    else:
                        sig.append(np.empty(0, np.int64))
                        band.append(np.empty(0, np.int64))
                yield pa.record_batch({
                    "doc": part.column("doc"), "k1": part.column("k1"), "k2": part.column("k2"), "n": pa.array(n, pa.int64()),
                    "set_a": pa.array(np.array(a, np.uint64).view(np.int64)), "set_b": pa.array(np.array(b, np.uint64).view(np.int64)),
                    "sig": pa.array(sig, pa.list_(pa.int64())), "band": pa.array(band, pa.list_(pa.int64())),
                })

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc long, k1 long, k2 long, n long, set_a long, set_b long, sig array<long>, band array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, k: int, nodes: DataFrame) -> DataFrame:
    """(node, shingles array<long>) of the rows that nodes (k1, k2, node) names: the whole sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(W.scan(part, "text", W.SPACED), k)]
                yield pa.record_batch({"node": part.column("node"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    rows = id_join(_rows(docs, id_col, text_col), nodes, ["k1", "k2"], "inner")
    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def agreeing(a: Column, b: Column) -> Column:
    """Equal four-bit minima of two packed signatures, by bit counts."""

    def count(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return HASHES - sum((count(a[i], b[i]) for i in range(1, _LONGS)), count(a[0], b[0]))


def least_agreeing(threshold: float) -> float:
    """The agreement below which a pair is dropped: chance makes 2**-BITS of unequal minima agree."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return HASHES * (p - SLACK * (p * (1 - p) / HASHES) ** 0.5)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach percent."""

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    lo, hi = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = pairs.join(left, "a").join(right, "b").where(lo * 100 >= hi * percent)
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def forest(doc: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the members of a block as its links do; no edge within a label, and no two for one union.

    With cross (a block number for each member), only pairs of different numbers are tried.
    """
    up = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    vocab, ids = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([0, *map(len, sets)])
    order = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(len(sets)), np.diff(cuts))[order]
    posts = np.searchsorted(ids[order], np.arange(len(vocab) + 1))
    least, out = least_agreeing(percent / 100), []
    nib = np.uint64(0x1111111111111111)
    for i in range(1, len(doc)):
        mine = root(int(label[i]))
        other = np.array([root(int(x)) for x in label[:i]]) != mine
        if cross is not None:
            other &= cross[:i] != cross[i]
        other &= (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
        if not other.any():
            continue
        j = np.flatnonzero(other)
        d = sig[j] ^ sig[i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        j = j[HASHES - np.bitwise_count(d & nib).sum(axis=1, dtype=np.int64) >= least]
        if not len(j):
            continue
        mineids = ids[cuts[i] : cuts[i + 1]]
        if len(j) <= 4:
            inter = np.array([len(np.intersect1d(mineids, ids[cuts[x] : cuts[x + 1]], assume_unique=True)) for x in j])
        else:
            hit = np.concatenate([owner[posts[v] : posts[v + 1]] for v in mineids])
            inter = np.bincount(hit, minlength=len(doc))[j]
        for x in j[100 * inter >= percent * (n[i] + n[j] - inter)].tolist():
            if (r := root(int(label[x]))) != (mine := root(mine)):
                up[max(r, mine)] = min(r, mine)
                out.append((int(doc[i]), int(doc[x])))
    return out


def _search(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between members of one bucket that have different labels; a hot bucket is searched in blocks."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "ascending"), ("node", "ascending")])
        doc, label, n, part = (t.column(c).to_numpy() for c in ("node", "label", "n", "part"))
        sig = np.array(t.column("sig").to_pylist(), np.int64).view(np.uint64).reshape(-1, _LONGS)
        sets = [x.values.to_numpy().view(np.uint64) for c in t.column("shingles").chunks for x in c]
        first, second = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        found = forest(doc, label, n, sig, sets, percent, None if first == second else part)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j"))))
    return (
        members.withColumn("blocks", blocks).withColumn("part", part).withColumn("m", met)
        .select("bucket", "node", "label", "n", "sig", "shingles", "part", "m.i", "m.j")
        .groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
    )


def bands_for(threshold: float) -> tuple[int, int]:
    """Bands and rows within HASHES minima that miss a pair at the threshold in under 1 of 1,000 cases."""
    for rows in range(8, 0, -1):
        for bands in range(1, min(24, HASHES // rows) + 1):
            if (1 - threshold**rows) ** bands < 1e-3:
                return bands, rows
    return 24, 1


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, sc: Scratch) -> DataFrame:
    """(doc, k1, k2, n, first), one row for each row of docs; first orders a component's rows by id, null last, and is its least, or null where n is 0.

    Equal sets are one node, whatever their ids; nodes are numbered when they are written, so a number is never made twice.
    """
    bands, rows = bands_for(percent / 100)
    base = sc.write(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "k1", "k2")
    one = base.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min(place).alias("first"), F.any_value("sig").alias("sig"), F.any_value("band").alias("band"))
    reps = sc.write(one.withColumn("node", F.monotonically_increasing_id()), "reps")

    keys = reps.select("node", F.explode("band").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    member = sc.write(keys.join(shared, "bucket"), "members")
    slim = reps.select("node", "n", "sig")
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    pairs = (
        member.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        .join(slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        .join(slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        .where(close & (agreeing(F.col("sa"), F.col("sb")) >= least_agreeing(percent / 100))).select("a", "b")
    )
    pairs = sc.write(pairs, "pairs")
    need = member.where("size > 2").select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    need = sc.write(reps.join(need, "node", "left_semi").select("first.k1", "first.k2", "node"), "need")
    sets = sc.write(full_sets(docs, id_col, text_col, shingle, need), "sets").dropDuplicates(["node"])
    star = sc.write(_confirm(pairs, sets, percent), "star")
    label = components(star, sc)

    open_ = member.where("size > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = open_.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    open_ = sc.write(open_.join(mixed, "bucket").select("bucket", "node", "label", "size"), "open")
    more = _search(open_.join(slim, "node").join(sets, "node"), percent)
    label = components(star.union(more), sc)
    sc.drop(sets, star, open_, need, pairs, member)
    named = reps.select("set_a", "set_b", "n", "node", "first").join(label, "node", "left")
    best = named.where("label is not null").groupBy("label").agg(F.min("first").alias("best"))
    firsts = sc.write(named.join(best, "label", "left").select("set_a", "set_b", "n", F.coalesce("best", "first").alias("first")), "firsts")
    sc.drop(reps)
    some = base.where("n > 0").select("doc", "k1", "k2", "n", "set_a", "set_b").join(firsts, ["set_a", "set_b", "n"]).select("doc", "k1", "k2", "n", "first")
    return some.unionByName(base.where("n = 0").select("doc", "k1", "k2", "n", F.lit(None).cast(firsts.schema["first"].dataType).alias("first")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each row of docs.

    Links join texts with 100 * |A & B| >= percent * |A | B| over shingle-word sets; component_id is the smallest
    id that is reachable. Texts that are null or without words have n_shingles 0 and stand alone. Rows that repeat an
    id are searched by their own texts; all rows of the id component_id are kept. A row with a null id is linked as
    others are and never kept, unless its component has no other ids (then component_id is null) or it stands alone.
    Other columns are not read. An empty table gives no rows. The result reads written tables and does no search of
    its own.
    """
    rows = _grouped(docs, id_col, text_col, shingle, percent, Scratch(docs.sparkSession, "near"))
    own = F.when(F.col("n") > 0, F.col("first.doc")).otherwise(F.col("doc"))
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near_duplicates, all columns as they were.

    It is the row of the smallest id, null last; of rows that repeat this id, the text with the smallest hash, and of
    rows that repeat id and text, the one whose JSON form is smallest. Texts that are null or without words all stay.
    """
    sc = Scratch(docs.sparkSession, "near")
    rows = sc.write(_grouped(docs, id_col, text_col, shingle, percent, sc).where("n > 0").select("k1", "k2", ((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))).alias("best")), "decided")
    gone = rows.where("not best").select("k1", "k2").distinct()
    again = rows.where("best").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
    names = docs.columns
    keys = ["_" * max(map(len, names)) + c for c in ("k1", "k2")]  # longer than any name of docs
    keyed = docs.withColumns(dict(zip(keys, row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), strict=True)))
    kept = id_join(keyed, gone.toDF(*keys), keys, "left_anti")
    if again.limit(1).count():
        again, whole = again.toDF(*keys), F.struct(*[F.col(f"`{c}`") for c in names])
        one = id_join(kept, again, keys).groupBy(*keys).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select(*[F.col(f"row.`{c}`") for c in names])
        kept = id_join(kept, again, keys, "left_anti").drop(*keys).unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in names])
