"""Periodic runs of words (operator 13): the harmonic grid.

A run of period p and length 2p or more holds two neighbouring multiples of p, jp and (j+1)p. For every p and every such
pair the longest common extension forward from it and backward before it gives the whole stretch of that period. Both
extensions are range minima over the common prefixes of neighbours in a suffix array, of the words and of the reversed
words. Suffix arrays are sorted by text first, so one pass in NumPy serves many short texts and no extension leaves its
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import free

#: Positions in a block of the range-minimum table; pairs whose extensions are asked for at once; bytes of text that are searched at once.
BLOCK, PAIRS, BYTES = 16, 1 << 17, 1 << 20


class RangeMin:
    """Minima of ranges: running minima inside blocks, a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        n = max(1, -(-len(values) // BLOCK))
        self.values = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        grid = self.values.reshape(n, BLOCK)
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= n:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of lo to hi, both within, lo <= hi."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi])
        same = np.flatnonzero(a == b)
        if len(same):
            at = np.minimum(lo[same, None] + np.arange(BLOCK), hi[same, None])
            out[same] = self.values[at].min(axis=1)
        far = np.flatnonzero(b - a > 1)
        if len(far):
            lo, width = a[far] + 1, b[far] - a[far] - 1
            level = np.frexp(width.astype(float))[1] - 1
            for k in np.unique(level):
                of = level == k
                row = self.table[k]
                out[far[of]] = np.minimum(out[far[of]], np.minimum(row[lo[of]], row[lo[of] + width[of] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions forward of two positions of one text; 0 for positions of two texts.

    The suffix array is built by prefix doubling; ranks are first places of groups, and only groups of several
    suffixes are sorted again.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        n = len(ids)
        place = np.arange(n)
        key = text * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1

        def put(at: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
            """Ranks of order[at], sorted by a key; the places that are still in groups of several."""
            new = np.ones(len(at), bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            alone = new & np.append(new[1:], True)
            return at[~alone]

        at, step, levels = put(place, key[order]), 1, []
        self.first = rank[:n].copy()  # equal for equal words of one text
        while len(at):
            levels.append(rank.copy())
            of = order[at]
            after = np.minimum(of + step, n)
            second = np.where(text[np.minimum(after, n - 1)] == text[of], rank[after], -1)
            key = rank[of].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(key)
            order[at] = of[by]
            at, step = put(at, key[by]), 2 * step
        shared = np.zeros(n, np.int32)
        if n > 1:
            pair = np.flatnonzero(self.first[order[1:]] == self.first[order[:-1]]) + 1
            a, b = order[pair - 1], order[pair]
            upto = np.zeros(len(pair), np.int64)
            for k in reversed(range(len(levels))):
                upto += (levels[k][a + upto] == levels[k][b + upto]).astype(np.int64) << k
            shared[pair] = upto
        self.rank, self.least = rank[:n], RangeMin(shared)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.least.query(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(first: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(jp, p) of the pairs jp, (j+1)p that hold the same word of one text, for p up to half of the longest text.

    The extension of any other pair is 0. Small periods are taken one by one, for all j at once; for the others it is
    j that is taken one by one, for all p at once, so both loops are short.
    """
    n, most = len(first), longest // 2
    turn = min(most, max(1, int(n**0.5)))
    at: list[np.ndarray] = []
    period: list[np.ndarray] = []
    held = 0

    def found() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(at), np.concatenate(period)

    for p in range(1, turn + 1):
        row = first[::p]
        j = np.flatnonzero(row[1:] == row[:-1])
        at.append(j * p)
        period.append(np.full(len(j), p))
        held += len(j)
        if held > PAIRS:
            yield found()
            at, period, held = [], [], 0
    j = 0
    while turn < most and (j + 1) * (turn + 1) < n:
        p = np.arange(turn + 1, min(most, (n - 1) // (j + 1)) + 1)
        p = p[first[j * p] == first[(j + 1) * p]]
        at.append(j * p)
        period.append(p)
        held += len(p)
        j += 1
        if held > PAIRS:
            yield found()
            at, period, held = [], [], 0
    if held:
        yield found()


def find(ids: np.ndarray, text: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of the words ids, where text numbers the text of each word and does not fall; sorted by start, then period."""
    none = np.empty((0, 3), np.int64)
    if not len(ids):
        return none
    n = len(ids)
    ahead, back = Extensions(ids, text), Extensions(ids[::-1], text[::-1])
    rows = [none]
    for at, p in grid(ahead.first, int(np.bincount(text - text[0]).max())):
        for k in range(0, len(at), PAIRS):
            i, q = at[k : k + PAIRS], p[k : k + PAIRS]
            end = i + q + ahead(i, i + q)
            before = i > 0
            start = i.copy()
            start[before] -= back(n - i[before], n - i[before] - q[before])
            size = end - start
            good = size >= np.maximum(min_length, 2 * q)
            rows.append(np.unique(np.stack([start[good], end[good], q[good]], 1), axis=0))
    runs = np.concatenate(rows)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Multiples of a run's period give the same stretch; the smallest one is the run's.
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_MADE = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
MADE = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _search(texts: list[bytes], min_length: int) -> list[tuple[int, list[dict], str]]:
    """(words, runs, text with each run cut down to its first period) of each text; bytes.split() cuts at 20 and 09 to 0D, as the words are defined."""
    words = [x.split() for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if flat else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    base = np.cumsum(sizes) - sizes
    runs = find(ids, owner, min_length)
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = np.cumsum(depth)[:-1] == 0
    cut = np.searchsorted(owner[runs[:, 0]], np.arange(len(texts) + 1)) if len(runs) else np.zeros(len(texts) + 1, np.int64)
    out = []
    for k, ws in enumerate(words):
        own = runs[cut[k] : cut[k + 1]]
        if len(own):
            ws = [ws[i] for i in np.flatnonzero(kept[base[k] : base[k] + sizes[k]])]
        found = [{"start": a, "length": b, "period": p} for a, b, p in zip((own[:, 0] - base[k]).tolist(), (own[:, 1] - own[:, 0]).tolist(), own[:, 2].tolist(), strict=True)]
        out.append((int(sizes[k]), found, b" ".join(ws).decode()))
    return out


def find_runs(docs: DataFrame, text_col: str = "text", *, min_length: int = 12, out: str = "periodic") -> DataFrame:
    """docs with a struct (MADE) named out, or out and underscores where docs has that column (see common.free).

    runs: every stretch of words with a smallest period of at most half its length, of min_length words or more, that no
    neighbouring word extends; sorted by start, then period. collapsed: the words outside the later periods of all runs,
    joined by one space. A null or empty text has no words, no runs and an empty collapsed text. Each row is searched
    alone, so repeated rows repeat their results, and no row is moved to another task. Memory follows BYTES of text, or
    one longer text, at some 300 bytes a word.
    """
    name, at = free(docs, out), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col, BYTES):
                data, offsets = W.buffers(part.column(at))
                raw, cuts = data.tobytes(), offsets.tolist()
                rows = _search([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], min_length)
                cols = list(zip(*rows, strict=True)) or [()] * 3
                made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MADE, strict=True)], fields=list(_MADE))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DataType.fromDDL(MADE))]))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text by checksum of its id repeats a stretch of its own words to its end.

    With h the CRC-32 of the decimal id, g = h div 10 and n words, h mod 10 = 0: from word a = g mod n on, word i
    becomes word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    marked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    a = F.when(n > 0, (F.col("g") % n).cast("int"))
    sized = marked.select("doc_id", "text", "w", n.alias("n"), a.alias("a"), F.when(n > 0, (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")).alias("p"))
    unit, rest = F.slice("w", F.col("a") + 1, F.col("p")), F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return sized.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the op13 query: the greatest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    made = find_runs(planted(docs)).select("doc_id", "periodic.runs", "periodic.collapsed")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed")
    return best.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
