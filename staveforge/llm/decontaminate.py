"""Benchmark decontamination with a generalised suffix automaton (operator 8).

The automaton holds every normalised item; training words stream through it and the state gives, at each word, the
longest run of words that some item contains. A run that reaches the window length is a leak. Words that cannot take
part, because they and their neighbour stand side by side in no item, are passed over in one vectorised step before
the automaton sees them; matches of two words or more are the same with or without that step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import free, Scratch

#: Item words in one automaton (some 100 MB in Python at most). Larger benchmarks take several passes.
AUTOMATON_WORDS = 200_000

LEAK = "struct<n_words:bigint,n_hit:bigint,longest:bigint,items:array<string>,spans:array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>>"
_SPAN = pa.struct([(x, pa.int64()) for x in ("first", "last", "begin", "end")])
_LEAK = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


class Automaton:
    """Suffix automaton of several word sequences.

    short: for each state the (length, item) of whole items shorter than the window that end there.
    held: for each state the items that contain its strings, for states that hold strings of the window's length.
    An item whose name is None counts for hits, but is named nowhere.
    """

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.window = window
        items = [(name, h) for name, h in items if len(h)]
        self.vocab = np.unique(np.concatenate([h for _, h in items])) if items else np.empty(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [(name, np.searchsorted(self.vocab, h).tolist()) for name, h in items]
        pairs: set[int] = set()
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            pairs.update(a * len(self.vocab) + b for a, b in zip(seq, seq[1:], strict=False))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([window, *(len(s) for _, s in seqs)])
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        held: dict[int, set[str | None]] = {}
        for name, seq in seqs:
            at = 0
            for k, c in enumerate(seq):
                at = self.next[at][c]
                if k + 1 >= window and (q := self._suffix(at, window)) >= 0:
                    held.setdefault(q, set()).add(name)
            if len(seq) < window:
                self.short.setdefault(self._suffix(at, len(seq)), []).append((len(seq), name))
        self.held = {k: tuple(sorted(v - {None})) for k, v in held.items()}

    def _suffix(self, state: int, n: int) -> int:
        """The state of the last n words of a state's strings."""
        while self.length[self.link[state]] >= n if state else False:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocab):
            if not hasattr(self, "_sieve"):
                self._sieve = np.zeros(1 << 16, bool)
                self._sieve[self.vocab >> np.uint64(48)] = True
            at = np.flatnonzero(self._sieve[h >> np.uint64(48)])
            pos = np.searchsorted(self.vocab, h[at])
            pos[pos == len(self.vocab)] = 0
            ok = self.vocab[pos] == h[at]
            out[at[ok]] = pos[ok]
        return out

    def runs(self, ids: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words that may hold a match of self.least words: each neighbour pair stands in some item."""
        if not len(ids) or not len(self.vocab):
            return
        known = ids >= 0
        if self.least > 1:
            near = np.zeros(len(ids), bool)
            at = np.flatnonzero(known[1:] & known[:-1] & (text[1:] == text[:-1])) + 1
            key = ids[at - 1] * len(self.vocab) + ids[at]
            pos = np.searchsorted(self.pairs, key)
            pos[pos == len(self.pairs)] = 0
            near[at] = self.pairs[pos] == key if len(self.pairs) else False
        else:
            near = known.copy()
            near[1:] &= known[:-1] & (text[1:] == text[:-1])
            near[0] = False
        edge = np.diff(np.concatenate([[0], near.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        keep = last - first >= self.least
        yield from zip(first[keep].tolist(), last[keep].tolist(), strict=True)
        if self.least == 1:  # words that stand alone
            alone = known & ~near
            alone[:-1] &= ~near[1:]
            yield from ((i, i + 1) for i in np.flatnonzero(alone).tolist())

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit intervals [first, last) of a run of words, the items with windows there, and the longest match."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = n = longest = 0
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            longest = max(longest, n)
            if n >= window:
                hits.append((i - n + 1, i + 1))
                items.update(self.held[self._suffix(state, window)])
            if self.short:
                q = state
                while q > 0:
                    for m, name in self.short.get(q, ()):
                        if m <= n:
                            hits.append((i - m + 1, i + 1))
                            if name is not None:
                                items.add(name)
                    q = link[q]
        return hits, items, longest


def _merge(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


def _mark(docs: DataFrame, text_col: str, out: str, automaton: Automaton) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    again = out in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = shared.value
        for batch in batches:
            for part in W.slices(batch, text_col):
                w = W.scan(part, text_col, W.ALNUM)
                ids = sam.ids(w.hash)
                rows = part.column(part.schema.get_field_index(out)).to_pylist() if again else [{"longest": 0, "items": [], "spans": []} for _ in range(len(part))]
                found: dict[int, list] = {}
                for a, b in sam.runs(ids, w.text):
                    hits, items, longest = sam.stream(ids[a:b].tolist())
                    row = rows[k := int(w.text[a])]
                    row["longest"] = max(row["longest"], longest)
                    row["items"] = sorted({*row["items"], *items})
                    found.setdefault(k, []).extend((a + x - w.bounds[k], a + y - w.bounds[k], w.start[a + x] - w.offsets[k], w.end[a + y - 1] - w.offsets[k]) for x, y in hits)
                for k, row in enumerate(rows):
                    old = [tuple(s[x] for x in ("first", "last", "begin", "end")) for s in row["spans"]]
                    new = _merge([*old, *(tuple(map(int, s)) for s in found.get(k, ()))])
                    row["spans"] = [dict(zip(("first", "last", "begin", "end"), s, strict=True)) for s in new]
                    row["n_words"], row["n_hit"] = int(w.bounds[k + 1] - w.bounds[k]), sum(s[1] - s[0] for s in new)
                col = pa.array(rows, _LEAK)
                names = [x for x in part.schema.names if x != out]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in names), col], [*names, out])

    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DataType.fromDDL(LEAK))])
    return docs.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leak") -> DataFrame:
    """docs with a struct column out (an own column of that name is replaced).

    n_words and n_hit count words; a word is hit if it stands inside any occurrence of a window, that is, of window
    consecutive words of an item, or of a whole item of fewer words. longest is the longest run of words that one
    item holds, if it reaches the window (or a short item); items are the ids, as strings, of items with occurring
    windows; spans are the hit intervals: words first (from 0) to before last, UTF-8 bytes begin to before end.
    Null texts and texts without words have zeros and empty arrays; items with null or wordless text have no
    windows. Items with a null id count for n_hit, longest and spans, but are not among items. An empty item table
    marks nothing. Rows that repeat stay as they are.
    """
    spark, sc = docs.sparkSession, None
    cut = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    # Spaces bound the number of words from above, so this sizes the automata without a tokeniser.
    total = cut.agg(F.sum(F.length(F.col("text")) / 2 + 1).alias("n")).first()["n"] or 0
    passes = max(1, int(total // AUTOMATON_WORDS) + 1 if total > AUTOMATON_WORDS else 1)
    docs = docs.drop(out)
    for k in range(passes):
        rows = cut.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        batch = pa.record_batch({"text": pa.array([r["text"] for r in rows], pa.string())})
        w = W.scan(batch, "text", W.ALNUM)
        seqs = [(r["item"], w.hash[w.bounds[i] : w.bounds[i + 1]]) for i, r in enumerate(rows)]
        docs = _mark(docs, text_col, out, Automaton(seqs, window))
        if k + 1 < passes:
            sc = sc or Scratch(spark, "leaks")
            docs = sc.write(docs, "marked")
    return docs


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without leaked text, columns as they were.

    A document goes if more than max_coverage of its words are hit; otherwise its hit spans are cut out of the text
    and a space is left in their place. Documents without hits stay byte for byte (null texts stay null).
    """
    out = free(docs, "__leak")
    rows = find_leaks(docs, items, window, text_col, out=out)
    rows = rows.where(f"{out}.n_hit <= {max_coverage} * {out}.n_words")

    # Byte spans are cut on the binary form: pieces between the spans, decoded again.
    raw = F.col(text_col).cast("binary")
    spans = F.col(f"{out}.spans")
    starts = F.concat(F.array(F.lit(0).cast("long")), spans["end"])
    ends = F.concat(spans["begin"], F.array(F.octet_length(F.col(text_col)).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, F.array_join(pieces, " ")).otherwise(F.col(text_col))).drop(out)
